"""URL identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Host in lower case, without user, port and a leading www.; null for null or a text without scheme and host."""
    raw = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    bare = F.regexp_replace(raw, r"^www\.", "")
    return F.when(bare != "", bare)


#: Query keys that only track a visitor (fixed values of the identity rule), besides all that begin with utm_.
TRACKERS = ("fbclid", "gclid", "mc_cid", "mc_eid", "_hsenc", "_hsmi")
_TRACKING = r"(?i)^(?:utm_[^=]*|" + "|".join(TRACKERS) + r")(?:=.*)?$"
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def parts(url: Column) -> dict[str, Column]:
    """Scheme, authority (both in lower case, without a default port), path and query."""
    get = lambda i: F.regexp_extract(url, _PARTS, i)
    scheme, authority = F.lower(get(1)), F.lower(get(2))
    port = F.when(scheme == "http", F.lit(":80")).when(scheme == "https", F.lit(":443")).otherwise(F.lit("\u0000"))
    bare = F.when(authority.endswith(port), F.left(authority, F.length(authority) - F.length(port))).otherwise(authority)
    return {"scheme": scheme, "authority": bare, "path": get(3), "query": get(4)}


def canonical(url: Column) -> Column:
    """One text per resource: no default port, tracking keys and fragment; order of keys and slashes kept."""
    p = parts(url)
    kept = F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~q.rlike(_TRACKING))
    path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(p["scheme"] == "", url).otherwise(F.concat(p["scheme"], F.lit("://"), p["authority"], path, query))


def dedupe_key(url: Column) -> Column:
    """canonical() with sorted query and no trailing slash."""
    p = parts(url)
    kept = F.array_sort(F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~q.rlike(_TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.concat(p["scheme"], F.lit("://"), p["authority"], F.regexp_replace(p["path"], "/+$", ""), query)


def usable(url: Column) -> Column:
    """an http(s) URL with a host, no stand-in for a missing one."""
    text = F.lower(F.trim(url))
    return F.coalesce(text.rlike(r"^https?://[^/?#]+") & ~text.isin("unknown", "none", "null", "n/a", "manual", ""), F.lit(False))
