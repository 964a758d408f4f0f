"""Robots policy as a predicate by RFC 9309 (S19), and a crawl frontier."""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import session

#: Characters that RFC 3986 calls unreserved, and those that paths and patterns keep as they are.
_UNRESERVED = re.compile(r"[A-Za-z0-9._~-]")
_KEPT = "/%:@!$&'()*+,;=?#[]-._~"


def encoded(text: str) -> str:
    """text with other characters percent-encoded as UTF-8, escapes in capitals, and unreserved characters decoded."""

    def one(m: re.Match) -> str:
        char = chr(int(m.group(1), 16))
        return char if _UNRESERVED.fullmatch(char) else "%" + m.group(1).upper()

    return re.sub("%([0-9A-Fa-f]{2})", one, quote(text, safe=_KEPT))


def parse(text: str, agent: str = "*") -> tuple[list[tuple[str, bool]], float, list[str]]:
    """(rules as (encoded pattern, allowed), crawl delay, sitemaps) of a robots text for an agent.

    All groups that name the agent's product token, in whatever case, hold together; without one those of * do. Lines of user
    agents follow each other until a rule; a rule before any of them, a line without a colon and an empty rule say nothing.
    """
    token = (agent.strip() or "*").split("/")[0].split()[0].lower()
    held: dict[str, list] = {}
    names: list[str] = []
    sitemaps, ruled = [], False
    for raw in text.splitlines():
        field, colon, value = (x.strip() for x in raw.split("#", 1)[0].partition(":"))
        field = field.lower()
        if not colon:
            continue
        if field == "user-agent":
            if value == "*" or re.fullmatch("[A-Za-z_-]+", value):
                names = [value.lower()] if ruled else [*names, value.lower()]
                ruled = False
                for n in names:
                    held.setdefault(n, [])
        elif field in ("allow", "disallow", "crawl-delay"):
            ruled = ruled or bool(names)
            for n in names:
                held[n].append((field, value))
        elif field == "sitemap" and re.match(r"https?://[^/@\s]+(?:/|$)", value):
            sitemaps.append(value)
    mine = held[token] if token != "*" and token in held else held.get("*", [])
    rules = [(encoded(v), f == "allow") for f, v in mine if f != "crawl-delay" and v]
    delays = [float(v) for f, v in mine if f == "crawl-delay" and re.fullmatch(r"\d+(?:\.\d+)?", v)]
    return rules, max(delays, default=0.0), list(dict.fromkeys(sitemaps))


def parse_robots(text: str, agent: str = "*") -> list[tuple[str, bool]]:
    """The rules of parse()."""
    return parse(text, agent)[0]


def rules_of(texts: DataFrame, agent: str = "*") -> DataFrame:
    """(site, pattern, allow) of robots texts (site, text), in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("allow", T.BooleanType())])))
    def parsed(column: pd.Series) -> pd.Series:
        return column.map(lambda t: [{"pattern": p, "allow": a} for p, a in parse_robots(t or "", agent)])

    return texts.select("site", F.inline(parsed("text")))


def rule_regex(pattern: Column) -> Column:
    """An encoded pattern as a regular expression on an encoded path: * is any run, one final $ the end."""
    body = F.regexp_replace(pattern, r"\$$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"([\\.+?^${}()|\[\]])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), body, F.when(pattern.endswith("$"), "$").otherwise(""))


@F.pandas_udf(T.StringType())
def _encoded(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: encoded(p) if p is not None else None)


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (site, path, …) with allowed: of rules (site, pattern, allow) that match, the one of most bytes decides, allow on a tie.

    path is what follows the host, query included. Rules join by site; a URL without a matching rule, and /robots.txt itself,
    is allowed.
    """
    n = F.octet_length("pattern") - F.endswith("pattern", F.lit("$")).cast("int")
    r = rules.select("site", "allow", n.alias("n"), rule_regex(F.col("pattern")).alias("rx")).distinct()
    paths = urls.select("site", "path").distinct().withColumn("p", _encoded(F.when(F.col("path") == "", "/").otherwise(F.col("path"))))
    hits = paths.join(r, "site").where(F.expr("p rlike rx")).groupBy("site", "path").agg(F.max(F.struct("n", "allow")).alias("_best"))
    free = F.regexp_replace("path", r"\?.*$", "") == "/robots.txt"
    return urls.join(hits, ["site", "path"], "left").withColumn("allowed", free | F.coalesce("_best.allow", F.lit(True))).drop("_best")


def frontier(seeds: DataFrame, links: DataFrame, depth: int, per_source: int | None = None) -> DataFrame:
    """(url, depth) reached from seeds (url) over links (source, target, score) in at most so many steps.

    Each step is a join with the links and an anti-join with what is known; per_source keeps the best-scored targets of a
    page (a budget of the crawl, on request only). Every step is cut, so lineage stays short.
    """
    from siltstone.operators.similarity import top_k

    seen = session.cut(seeds.select("url", F.lit(0).alias("depth")).distinct())
    edge = 0
    while edge < depth:
        front = seen.where(F.col("depth") == edge).select(F.col("url").alias("source"))
        out = links.join(front, "source")
        if per_source:
            out = top_k(out, "source", per_source, F.desc("score"), F.col("target"))
        fresh = out.select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(edge + 1))
        new = session.cut(seen.unionByName(fresh))
        edge += 1
        if new.count() == seen.count():
            break
        seen = new
    return seen
