"""Main body of web pages, by wrappers inferred per site.

Method: union-free regular-expression inference. A page is a stream of line tokens (each line with white space, digits
and the site's own name masked). The streams of a bucket of one site are aligned with its wrapper one after the other:
tokens that match in order stay literals; what does not match becomes an optional literal, if it recurs, or lies in a slot
between two literals. Then every page is aligned with the finished wrapper, which gives each literal its support (matches
in order), the places where it repeats or has moved, and what its slot begins with. These numbers are summed over the
buckets of a site and over all sites, so that sites with few pages learn from others. A literal of a fair support is a
frame, unless the html marks it as a heading and its slot begins with prose: that is a section. A literal whose slot holds
titles and never prose opens a repeated group of links. Reading aligns each page once more with the frames of its bucket's
wrapper, in order: the place of a line says whether a literal, a group of links or a body slot holds it. Within slots,
links of the html, bylines, paths and short lines with the site's name are told apart by the line itself.

Defined results: pages without clean_text give no row; null html only costs the link tokens; null final_url falls back
to url; null title costs the protection of the title line; a page whose text is one message keeps it as its body; blank
lines give no row. A site of any size is cut into buckets of about ``BUCKET`` pages, so no task holds a whole site.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import session
from siltstone.functions.urls import host
from siltstone.operators.similarity import let
from siltstone.sources.tables import table

#: Pages of one site that one task aligns.
BUCKET = 256
#: A token is a frame from this share of its site's pages on, and on so many pages; more for lines of prose.
SHARE, PAGES, PROSE_SHARE, PROSE_PAGES = 0.15, 3, 0.3, 4
#: Sites that must share a token before its pooled share counts for sites with few pages.
SITES = 3
#: Share of a heading's followers that are titles, from which on it opens a group of links.
TITLES = 0.75
#: Share of an element's pages on which it stands out of order, from which on it is a group that repeats or moves.
MOVED = 0.05
#: Share of a heading's slots that must begin with prose for a section of the body.
SECTION = 0.8

BLANK, TITLE, PROSE, HEADING, SHORT, MULTI = range(6)
LINK, BRAND, BYLINE, PATH, HEAD = 8, 16, 32, 64, 128
KIND = 7
#: Of an element: pages on which it is met in order, pages on which it stands out of order, places, places whose slot begins
#: with titles or with prose, places that are prose, that are links or have the site's name, that the html marks as headings.
STATS = ("n", "loose", "places", "titles", "prose", "is_prose", "own", "headed")

_SPACE = re.compile(r"[\s  -​ 　﻿]+")
_DIGITS = re.compile(r"\d+")
_SEPARATOR = re.compile(r"\s+[|>»›·•/]\s+|[\s ]{2,}")
_STEP = re.compile(r"\s[>»›/]\s")
_SENTENCE = re.compile(r"[.!?…。！？][)\"'”’»\]]*$")
_ANCHOR = re.compile(r"<a\b[^>]*>([^<]{2,400})</a>\s*(?=[<\n])", re.IGNORECASE)
_HEADS = re.compile(r"<h[2-6]\b[^>]*>([^<]{2,400})</h[2-6]>", re.IGNORECASE)
_BEFORE = re.compile(r"[>\n]\s*$")
_ENTITY = {"&amp;": "&", "&gt;": ">", "&lt;": "<", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}
_NAME = r"[^\W\d_][\w.'’-]*"
_BYLINE = re.compile(
    rf"(?:by|von|par|por|words|text|autor|autora|author|written by|story by)\s*:?\s+{_NAME}(?:\s+{_NAME}){{1,3}}"
    rf"|(?:published|updated|posted|veröffentlicht|publié|publicado)\b.{{0,60}}\d.{{0,60}}"
    rf"|{_NAME}(?:\s+{_NAME}){{1,3}}\s*[|·,–-]\s*(?:\d{{1,2}}\.?\s+(?:de\s+)?[^\W\d]+\.?,?\s+(?:de\s+)?\d{{4}}|\d{{4}}-\d\d-\d\d)"
    rf"|{_NAME}(?:\s+{_NAME}){{1,3}},\s+staff writer\b.{{0,40}}"
    rf"|(?:reading time|lesezeit|temps de lecture|tiempo de lectura)\b.{{0,80}}",
    re.IGNORECASE,
)


def token(text: str) -> int:
    """Key of a masked line."""
    return xxhash.xxh64_intdigest(text) >> 1


def brand_of(site: str | None) -> str:
    """The site's own name, as it may stand in its lines: the first part of the label before the top-level domain."""
    labels = (site or "").split(".")
    name = labels[-2] if len(labels) > 1 else labels[0]
    name = name.split("-")[0]
    return name if len(name) > 3 else ""


def _plain(text: str) -> str:
    """Text between tags, in lower case, with entities read and white space collapsed."""
    if "&" in text:
        for k, v in _ENTITY.items():
            text = text.replace(k, v)
    return _SPACE.sub(" ", text).strip().lower()


def links_of(html: str | None) -> Counter:
    """How often each text fills a line of the page as a link: nothing but tags and line breaks beside it."""
    out: Counter = Counter()
    for m in _ANCHOR.finditer(html or ""):
        if _BEFORE.search(html, max(0, m.start() - 40), m.start()):
            out[_plain(m.group(1))] += 1
    return out


def heads_of(html: str | None) -> set[str]:
    """The texts of the page's headings below the first level."""
    return {_plain(x) for x in _HEADS.findall(html or "")}


def stream(text: str, title: str | None, html: str | None, site: str | None) -> tuple[list[int], list[int], dict[int, int], dict[int, list[int]]]:
    """(keys, kinds, {line: key of what stands before its colon}, {line: keys of its parts}) of the lines of a page."""
    brand, links, marked = brand_of(site), links_of(html), heads_of(html)
    full = _SPACE.sub(" ", title or "").strip().lower()
    heads = {full, re.sub(r"\s+[-–|]\s+[^-–|]+$", "", full)} - {""}
    keys, kinds, before, parts = [], [], {}, {}
    for no, raw in enumerate(text.split("\n")):
        bare = raw.strip()
        line = _SPACE.sub(" ", bare)
        low = line.lower()
        if not low:
            keys.append(0)
            kinds.append(BLANK)
            continue
        masked = low.replace(brand, "{b}") if brand else low
        key = token(_DIGITS.sub("#", masked))
        words = low.count(" ") + 1
        pieces = [p for p in _SEPARATOR.split(bare.lower()) if p] if len(low) < 400 else []
        if low in heads:
            kind = TITLE
        elif _SENTENCE.search(line) and words > 5 or len(low) > 240:
            kind = PROSE
        elif len(pieces) > 1:
            kind = MULTI
        else:
            kind = HEADING if words > 3 else SHORT
        if len(pieces) > 1 and kind != TITLE:
            parts[no] = [1 if _SPACE.sub(" ", p) in heads else token(_DIGITS.sub("#", _SPACE.sub(" ", p.replace(brand, "{b}") if brand else p))) for p in pieces]
            kind |= PATH if _STEP.search(bare) else 0
        if links[low] > 0:  # as many lines as links of the text, the first ones
            links[low] -= 1
            kind |= LINK
        if low in marked:
            kind |= HEAD
        if brand and brand in low:
            kind |= BRAND
        if len(low) < 120 and _BYLINE.fullmatch(line):
            kind |= BYLINE
        if 0 < (colon := low.find(":")) < 60:
            before[no] = token(_DIGITS.sub("#", masked.split(":", 1)[0].rstrip()))
        keys.append(key)
        kinds.append(kind)
    return keys, kinds, before, parts


def _streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        packed = [pickle.dumps(stream(*row), 5) for row in zip(f["clean_text"], f["title"], f["html"], f["site"])]
        yield pd.DataFrame({"url": f["url"], "site": f["site"], "stream": packed})


def streams(pages: DataFrame) -> DataFrame:
    """(url, site, stream) of pages with a text; html is read here once and goes no further."""
    pages = pages.where(F.col("clean_text").isNotNull())
    site = F.coalesce(host(F.col("final_url")), host(F.col("url")), F.lit(""))
    return session.spread(pages.select("url", site.alias("site"), "title", "clean_text", "html")).mapInPandas(_streams, "url string, site string, stream binary")


def chain(place: dict[int, int], tokens: list[int]) -> dict[int, int]:
    """{index in tokens: place} of the longest run of matches in order between tokens and a wrapper's places.

    Each token stands once in a wrapper, so this is a longest rising subsequence of places.
    """
    hits = [(place[t], j) for j, t in enumerate(tokens) if t in place]
    tails: list[int] = []
    tail_at: list[int] = []
    back = [-1] * len(hits)
    for h, (p, _) in enumerate(hits):
        k = bisect_left(tails, p)
        back[h] = tail_at[k - 1] if k else -1
        if k == len(tails):
            tails.append(p)
            tail_at.append(h)
        else:
            tails[k], tail_at[k] = p, h
    out, h = {}, tail_at[-1] if tail_at else -1
    while h >= 0:
        out[hits[h][1]] = hits[h][0]
        h = back[h]
    return out


def align(wrapper: list[int], tokens: list[int]) -> list[int]:
    """wrapper, after the stream of tokens was aligned with it: what matches in order stays, new tokens come between, as
    optional ones; tokens that match out of order are repetitions or moved groups and add nothing."""
    place = {t: i for i, t in enumerate(wrapper)}
    met = chain(place, tokens)
    out, done = [], 0
    for j, t in enumerate(tokens):
        if j in met:
            out += wrapper[done : met[j] + 1]
            done = met[j] + 1
        elif t not in place:
            place[t] = -1
            out.append(t)
    return out + wrapper[done:]


def induce(pages: list[tuple]) -> tuple[list[int], dict[int, list[int]], list[int]]:
    """(the wrapper's literals in order, {token: STATS}, the tokens of one page that are no elements) of the streams of a bucket.

    The first pass builds the wrapper; the second aligns every page with it. A match in order is an occurrence of the
    literal, a match out of order a loose one. The lines between a literal and the next one of a fair share are its slot.
    """
    seen: Counter = Counter()
    for keys, kinds, _, parts in pages:
        own = {k for k, c in zip(keys, kinds) if k and c & KIND != TITLE}
        for line in parts.values():
            own.update(line)
        seen.update(own)
    seen.pop(1, None)
    wrapper: list[int] = []
    for keys, kinds, _, _ in pages:
        wrapper = align(wrapper, list(dict.fromkeys(k for k, c in zip(keys, kinds) if k and c & KIND != TITLE and seen[k] > 1)))
    place = {t: i for i, t in enumerate(wrapper)}
    met, support = [], Counter()
    for keys, _, _, _ in pages:
        met.append(chain(place, keys))
        support.update(place_of for place_of in met[-1].values())
    strong = {i for i, n in support.items() if n >= max(2, SHARE * len(pages))}
    stats: dict[int, list[int]] = {}
    for (keys, kinds, _, parts), hits in zip(pages, met):
        full = [i for i, k in enumerate(keys) if k]
        loose, counted = set(), set()
        for at, i in enumerate(full):
            key, kind = keys[i], kinds[i]
            base = kind & KIND
            if base == TITLE or (key not in place and not (base in (SHORT, MULTI) or kind & (BRAND | LINK))):
                continue
            entry = stats.setdefault(key, [0] * len(STATS))
            slot = [kinds[j] & KIND for j in full[at + 1 : at + 3] if hits.get(j) not in strong]
            if len(slot) == 1 and at + 2 < len(full) and hits.get(full[at + 1]) in strong:
                slot = []
            first, second = (*slot, SHORT, SHORT)[:2]
            if i in hits or key not in place:
                entry[0] += key not in counted
                counted.add(key)
            else:
                entry[1] += key not in loose
                loose.add(key)
            entry[2] += 1
            entry[3] += first == HEADING and second != PROSE  # one title before prose is a section
            entry[4] += first == PROSE
            entry[5] += base == PROSE
            entry[6] += bool(kind & (BRAND | LINK))
            entry[7] += bool(kind & HEAD)
        for line in parts.values():
            for key in line:
                if key != 1 and key not in counted and seen[key] > 1:
                    counted.add(key)
                    stats.setdefault(key, [0] * len(STATS))[0] += 1
    return wrapper, stats, [k for k in seen if k not in stats]


_BUCKETS = f"site string, bucket int, pages int, urls array<string>, streams array<binary>, wrapper array<bigint>, element array<struct<key:bigint,{','.join(f'{n}:int' for n in STATS)}>>, single array<bigint>"


def _induce(frame: pd.DataFrame) -> pd.DataFrame:
    wrapper, stats, single = induce([pickle.loads(s) for s in frame["stream"]])
    rows = [{"key": k, **dict(zip(STATS, v))} for k, v in stats.items()]
    first = frame.iloc[0]
    return pd.DataFrame([{"site": first["site"], "bucket": int(first["bucket"]), "pages": len(frame), "urls": frame["url"].tolist(), "streams": frame["stream"].tolist(), "wrapper": wrapper, "element": rows, "single": single}])


def buckets(pages: DataFrame) -> DataFrame:
    """One row per bucket of a site: its streams, and the wrapper inferred from them with its elements' statistics."""
    rows = streams(pages)
    counts = pages.where(F.col("clean_text").isNotNull()).select(F.coalesce(host(F.col("final_url")), host(F.col("url")), F.lit("")).alias("site"))
    counts = counts.groupBy("site").agg(F.ceil(F.count("*") / BUCKET).alias("parts"))
    rows = rows.join(counts, "site").withColumn("bucket", F.pmod(F.xxhash64("url"), F.col("parts")).cast("int"))
    return session.cut(rows.groupBy("site", "bucket").applyInPandas(_induce, _BUCKETS))


def frames(parts: DataFrame) -> DataFrame:
    """(site, bucket, frame array<struct<key, opener, moved>>): the literals of each bucket's wrapper that are frames.

    The statistics of a site's buckets are summed, and those of all sites; what is decided for a site and token goes back
    to the buckets that have the token. So no row holds more than the tokens of one bucket, however large the site.
    """
    sizes = parts.groupBy("site").agg(F.sum("pages").alias("total"))
    element = parts.select("site", "bucket", F.inline("element"))
    one = element.groupBy("site", "key").agg(*[F.sum(c).alias(c) for c in STATS]).join(sizes, "site")
    # A literal that stands out of order on a share of its pages is a group that repeats or moves, and counts there too.
    moves = lambda n, loose: (F.col(loose) >= 2) & (F.col(loose) >= MOVED * (F.col(n) + F.col(loose)))
    one = one.withColumn("moved", moves("n", "loose")).withColumn("n", F.col("n") + F.when(F.col("moved"), F.least("loose", F.col("total") - F.col("n"))).otherwise(0))
    pool = one.groupBy("key").agg(F.count("*").alias("sites"), *[F.sum(c).alias(f"all_{c}") for c in (*STATS, "total")])
    row = one.join(pool, "key")
    prose = F.col("all_is_prose") * 2 > F.col("all_places")
    named = F.col("all_own") * 2 > F.col("all_places")
    # What the html marks as a heading and prose follows is a section of the body, however many pages have it.
    section = (F.col("all_headed") * 2 > F.col("all_places")) & (F.col("all_prose") >= SECTION * F.col("all_places"))
    share, pooled = F.col("n") / F.col("total"), F.col("all_n") / F.col("all_total")
    frame = (
        (named & (F.col("all_places") > 0))
        | (~prose & (((share >= SHARE) & (F.col("n") >= PAGES)) | ((pooled >= SHARE) & (F.col("sites") >= SITES))))
        | (prose & (((share >= PROSE_SHARE) & (F.col("n") >= PROSE_PAGES)) | ((pooled >= PROSE_SHARE) & (F.col("sites") >= SITES))))
    ) & ~section
    opener = (F.col("all_titles") >= TITLES * F.col("all_places")) & (F.col("all_places") > 0) & (F.col("all_prose") <= 0.1 * F.col("all_places"))
    # A line that one page of a bucket has is no element and adds nothing to the pool, but takes its role from there: else a
    # site of one page would not know the notices of all others.
    lent = pool.where((F.col("sites") >= SITES) & (pooled >= F.when(prose, PROSE_SHARE).otherwise(SHARE)) & ~section).select("key", opener.alias("opener"))
    single = parts.select("site", "bucket", F.explode("single").alias("key")).join(lent, "key").select("site", "bucket", "key", "opener", F.lit(True).alias("moved"))
    moved = F.col("moved") | ((F.col("sites") >= SITES) & moves("all_n", "all_loose"))
    decided = row.where(frame).select("site", "key", opener.alias("opener"), moved.alias("moved"))
    back = element.select("site", "bucket", "key").join(decided, ["site", "key"]).select("site", "bucket", "key", "opener", "moved").unionByName(single)
    return back.groupBy("site", "bucket").agg(F.collect_list(F.struct("key", "opener", "moved")).alias("frame"))


def outside(page: tuple, wrapper: list[int], frame: dict[int, tuple[bool, bool]]) -> list[int]:
    """Line numbers of a page outside the main body, read with the wrapper of its bucket.

    frame is {key: (opener, moved)}; the literals of wrapper that are in it are aligned with the page. A line that the
    alignment matches is a literal; the same text elsewhere is one only if the site repeats or moves it, or if it has the
    site's name, else it lies in a slot. The slot after an opener is a group of links until prose or another literal ends it.
    """
    keys, kinds, before, parts = page
    bases = [k & KIND for k in kinds]
    place = {k: i for i, k in enumerate(k for k in wrapper if k in frame)}
    met = chain(place, keys)
    known_at = [k in frame and (i in met or frame[k][1] or k not in place or kinds[i] & BRAND) for i, k in enumerate(keys)]
    opens = lambda k: k in frame and frame[k][0]
    out, links, head = [], False, next((i for i, b in enumerate(bases) if b == TITLE), -1)
    if head > 0 and any(b == PROSE and not known_at[i] and not kinds[i] & BRAND for i, b in enumerate(bases[:head])):
        head = -1  # prose stands before it: it is no heading of the page
    for i, (key, kind, base) in enumerate(zip(keys, kinds, bases)):
        if base == BLANK:
            continue
        if i == head or (head < 0 and base == TITLE and not links):
            links = False
            continue
        inside = False
        if i < head:
            pass
        elif known_at[i]:
            links = opens(key) or (links and base != PROSE)
        elif kind & (LINK | BYLINE) or opens(before.get(i)):
            pass
        elif i in parts and sum(p == 1 or p in frame for p in parts[i]) >= 0.75 * len(parts[i]):
            pass
        elif kind & PATH and all(p in frame for p in parts[i][:-1]):
            pass  # a path may end in a title that is not known
        elif kind & BRAND and base != PROSE:
            pass
        elif links and base in (HEADING, SHORT, MULTI, TITLE):
            pass
        else:
            inside, links = True, False
        if not inside:
            out.append(i)
    return out


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        urls, lines, body, heads = [], [], [], []
        for names, packed, wrapper, frame in zip(f["urls"], f["streams"], f["wrapper"], f["frame"]):
            roles = {x["key"]: (x["opener"], x["moved"]) for x in frame} if frame is not None else {}
            literals = [k for k in wrapper.tolist() if k in roles]
            # A repeated row lies in the same bucket; pages of one url are read once per different stream.
            for url, raw in dict.fromkeys(zip(names, packed)):
                page = pickle.loads(raw)
                out = outside(page, literals, roles)
                gone = set(out)
                urls.append(url)
                lines.append(out)
                body.append([i for i, k in enumerate(page[1]) if k & KIND != BLANK and i not in gone])
                heads.append([i for i, k in enumerate(page[1]) if k & KIND == TITLE and i not in gone])
        yield pd.DataFrame({"url": urls, "outside": lines, "body": body, "heads": heads})


def segmented(pages: DataFrame) -> DataFrame:
    """(url, outside, body, heads): the non-blank lines of each page outside and inside its main body, and its title lines."""
    parts = buckets(pages)
    rows = parts.select("site", "bucket", "urls", "streams", "wrapper").join(frames(parts), ["site", "bucket"], "left")
    return rows.drop("site", "bucket").mapInPandas(_read, "url string, outside array<bigint>, body array<bigint>, heads array<bigint>")


def crawl(spark: SparkSession, folder: str) -> DataFrame:
    """The pages' columns that segmentation needs."""
    return table(spark, folder, "crawl_cache", "url", "final_url", "title", "html", "clean_text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each non-blank line of a clean_text outside the main body."""
    return segmented(crawl(spark, folder)).select("url", F.explode("outside").alias("line_no"))


def p1_body(spark: SparkSession, folder: str) -> DataFrame:
    """Per page: lines and characters of the main body, and its hash."""
    pages = crawl(spark, folder).select("url", "clean_text")
    body = segmented(crawl(spark, folder)).select("url", "body").join(pages, "url")
    text = let(F.split("clean_text", "\n"), lambda lines: F.array_join(F.transform("body", lambda i: F.get(lines, i.cast("int"))), "\n"))
    return body.select("url", F.size("body").cast("bigint").alias("lines"), F.length(text).cast("bigint").alias("chars"), F.sha2(text, 256).alias("body_hash"))
