"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]+"


def clean(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def tokens_a(text: Column) -> Column:
    """X2 T_a: distinct runs of three or more ASCII letters and digits, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), 0))


def tokens_b(text: Column) -> Column:
    """X2 T_b: runs of letters, digits, _ and - that begin with a letter or digit, longer than two, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_-]+"), 0), lambda t: F.length(t) > 2)


def tokens_c(text: Column, stop: list[str]) -> Column:
    """X2 T_c and T_d: distinct T_b-like tokens of three or more characters without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_-]{2,}"), 0))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def tokens_e(text: Column) -> Column:
    """X2 T_e: runs of ASCII word characters, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)


def padded(text: Column) -> Column:
    """The words of a text, each between two blanks, so that a phrase is counted as whole words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def phrase_count(pad: Column, phrase: str) -> Column:
    """Occurrences of a phrase as whole words in padded()."""
    needle = " " + "  ".join(phrase.lower().split()) + " "
    return ((F.length(pad) - F.length(F.replace(pad, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def sentences(text: Column) -> Column:
    """Pieces between sentence ends."""
    return F.filter(F.split(text, r"[.!?]+\s+|\n+"), lambda s: F.trim(s) != "")


def truncated(text: Column, size: int) -> Column:
    """X11: at most size characters, an ellipsis where something was cut."""
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size - 1)), F.lit("…"))).otherwise(text)


def first_filled(*columns: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def headings(text: Column) -> Column:
    """Markdown headings."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,3} +([^\n]+)$"), 1)


def bullets(text: Column) -> Column:
    """Markdown list items."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^[-*] +([^\n]+)$"), 1)


def links(text: Column) -> Column:
    """Http links, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[^\s)>\"]+"), 0))


def numbers(text: Column) -> Column:
    """Numbers in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0), lambda x: x.cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """V1: |a ∩ b| / |a ∪ b| of two token sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def slug(value: Column, blank: str = "item") -> Column:
    """Lower case, everything but ASCII letters and digits as one hyphen, none at the ends; blank where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(blank))


def capitalised(words: Column) -> Column:
    """Each word between blanks with a capital first letter, hyphens and underscores as blanks."""
    return F.initcap(F.trim(F.regexp_replace(words, "[-_]+", " ")))


def title_from_url(url: Column, fallback: Column) -> Column:
    """The last part of a URL's path as a title, else its host, else fallback."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    tail, host = F.substring_index(path, "/", -1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.coalesce(F.nullif(capitalised(F.coalesce(F.nullif(tail, F.lit("")), F.nullif(host, F.lit("")))), F.lit("")), fallback)


def name_from_url(url: Column, fallback: Column) -> Column:
    """The first label of a URL's host, without www., as a name, else fallback."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    return F.coalesce(F.nullif(capitalised(F.substring_index(F.replace(host, F.lit("www."), F.lit("")), ".", 1)), F.lit("")), fallback)


def sanitized(items: Column, most: int = 6) -> Column:
    """Items with white space collapsed, without blanks and repeats in other case, at most so many, the first ones."""
    texts = F.filter(F.transform(items, clean), lambda x: x != "")
    return F.slice(F.filter(texts, lambda x, i: F.array_position(F.transform(texts, F.lower), F.lower(x)) == i + 1), 1, most)


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys, no blanks between, other scripts kept, for hashing; a null is an empty text."""
    return F.to_json(F.struct(*[F.coalesce(fields[k], F.lit("")).alias(k) for k in sorted(fields)]))
