"""Queries over files of several formats that are written from the tables first (S5-S7, S12, S13, K1, K3), robots policy
and the refresh by a manifest of content hashes (Z2)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import session
from siltstone.functions import urls
from siltstone.plans.merges import HOST, evidence
from siltstone.sources import files, robots
from siltstone.sources.tables import table


def _folder(spark: SparkSession) -> str:
    return f"{session.work_dir(spark)}/{uuid.uuid4().hex}"


def source_json(spark: SparkSession, folder: str) -> DataFrame:
    """The funding calls, as JSON lines under an explicit schema; lines that are no record are dropped."""
    path = _folder(spark)
    rows = table(spark, folder, "funding_data", F.to_json(F.struct("id", "title", "year", "status")).alias("value"))
    rows.unionByName(spark.range(1).select(F.lit("{broken").alias("value"))).write.text(path)
    return files.json_table(spark, path, "id bigint, title string, year int, status string", lines=True)


SOURCE_JSON = "SELECT id, title, year, status FROM funding_data"


def source_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The hackathon challenges, as items of a feed; markup of summaries is taken out."""
    path = _folder(spark)
    rows = table(spark, folder, "hackathon_data", F.trim("challenge_name").alias("title"), F.col("url").alias("link"), F.col("last_checked").alias("pubDate"), F.concat(F.lit("<p>"), F.trim("problem_signature"), F.lit("</p>")).alias("description"))
    rows.where("title <> '' AND link IS NOT NULL").write.format("xml").option("rowTag", "item").option("rootTag", "rss").save(path)
    return files.feed(spark, path).withColumn("summary", F.trim("summary"))


SOURCE_FEED = "SELECT trim(challenge_name) AS title, url AS link, last_checked AS published, trim(problem_signature) AS summary FROM hackathon_data WHERE trim(challenge_name) <> '' AND url IS NOT NULL"


def source_sqlite(spark: SparkSession, folder: str) -> DataFrame:
    """The zones of the sites (a table of fixed size), through a SQLite file; the file must lie on a disk that all see."""
    import os
    import sqlite3

    path = f"{_folder(spark)}.db".removeprefix("file:")
    path = os.path.normpath(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE zones (site TEXT, zone TEXT, date_order TEXT)")
        db.executemany("INSERT INTO zones VALUES (?, ?, ?)", [tuple(r) for r in table(spark, folder, "site_zones", "site", "zone", "date_order").collect()])
    return files.sqlite_table(spark, path, "zones", "site string, zone string, date_order string")


SOURCE_SQLITE = "SELECT site, zone, date_order FROM site_zones"


def publish_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """K1, K3, K7: the latest row of each evidence id, staged, checked and published by layer, and read back: rows per layer."""
    path = _folder(spark)
    latest = evidence(spark, folder, "evidence_id", "layer", "updated_at").where("evidence_id IS NOT NULL").groupBy("evidence_id").agg(F.max(F.struct("updated_at", "layer")).alias("r"))
    files.publish(latest.select("evidence_id", "r.*"), path, ["evidence_id"], "layer")
    return spark.read.parquet(path).groupBy("layer").agg(F.count("*").alias("n"), F.max("updated_at").alias("newest"))


PUBLISH_EVIDENCE = """SELECT layer, count(*) AS n, max(updated_at) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY updated_at DESC NULLS LAST, layer DESC NULLS LAST) AS r FROM canonical_evidence WHERE evidence_id IS NOT NULL) WHERE r = 1 GROUP BY layer"""


def manifest_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """What a second run has to do again, by the manifest of content hashes that the first one left.

    The first run saw the pages fetched before 2025, the second all pages; of a page's rows the last one counts. A page is
    reused if its hash is that of the manifest, else changed or new.
    """
    rows = table(spark, folder, "crawl_cache", "url", "content_hash", "fetched_at", urls.host(F.coalesce("final_url", "url")).alias("site")).where("url IS NOT NULL")
    last = lambda df: df.groupBy("url").agg(F.max(F.struct("fetched_at", "content_hash", "site")).alias("r")).select("url", "r.*")
    manifest = session.cut(last(rows.where(F.col("fetched_at") < "2025")).select("url", F.col("content_hash").alias("known"), F.lit(True).alias("seen")))
    both = last(rows).join(manifest, "url", "left")
    state = F.when(F.col("seen").isNull(), "new").when(F.col("known").eqNullSafe(F.col("content_hash")), "reused").otherwise("changed")
    return both.groupBy("site", state.alias("state")).agg(F.count("*").alias("pages"))


MANIFEST_REFRESH = f"""WITH r AS (SELECT url, content_hash, fetched_at, {HOST.format("coalesce(final_url, url)")} AS site FROM crawl_cache WHERE url IS NOT NULL),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, content_hash DESC NULLS LAST) AS k FROM r) WHERE k = 1),
    o AS (SELECT url, content_hash AS known FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, content_hash DESC NULLS LAST) AS k FROM r WHERE fetched_at < '2025') WHERE k = 1)
    SELECT site, CASE WHEN o.url IS NULL THEN 'new' WHEN known IS NOT DISTINCT FROM content_hash THEN 'reused' ELSE 'changed' END AS state, count(*) AS pages FROM n LEFT JOIN o ON n.url = o.url GROUP BY ALL"""

#: A policy as sites have it; every site of the crawl is taken to have this one.
ROBOTS = """User-agent: *
Disallow: /news/
Allow: /news/how
Disallow: /*-3
Disallow: /p/*-1$
Crawl-delay: 2

User-agent: Reader
Disallow: /calls
"""


def robots_allowed(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of the crawl that a policy lets any agent fetch, per site."""
    rows = table(spark, folder, "crawl_cache", urls.host(F.col("url")).alias("site"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^#]*)", 1).alias("path")).where("site IS NOT NULL")
    rules = robots.rules_of(rows.select("site").distinct().withColumn("text", F.lit(ROBOTS)), "crawler/1.0")
    return robots.allowed(rows, rules).groupBy("site").agg(F.count("*").alias("pages"), F.count_if("allowed").alias("allowed"))


ROBOTS_ALLOWED = rf"""WITH r AS (SELECT {HOST.format("url")} AS site, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS path FROM crawl_cache),
    m AS (SELECT site, path, greatest(CASE WHEN path LIKE '/news/how%' THEN 9.5 ELSE 0 END, CASE WHEN path LIKE '/news/%' THEN 6 ELSE 0 END, CASE WHEN path LIKE '/%-3%' THEN 4 ELSE 0 END, CASE WHEN regexp_matches(path, '^/p/.*-1$') THEN 6 ELSE 0 END) AS best FROM r WHERE site IS NOT NULL)
    SELECT site, count(*) AS pages, count(*) FILTER (best = 0 OR best = 9.5) AS allowed FROM m GROUP BY site"""

QUERIES = {
    "source_json": (source_json, SOURCE_JSON), "source_feed": (source_feed, SOURCE_FEED), "source_sqlite": (source_sqlite, SOURCE_SQLITE), "publish_evidence": (publish_evidence, PUBLISH_EVIDENCE),
    "manifest_refresh": (manifest_refresh, MANIFEST_REFRESH), "robots_allowed": (robots_allowed, ROBOTS_ALLOWED),
}
