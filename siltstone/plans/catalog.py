"""Registry of the engine's queries: name -> plan, name -> SQL twin."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import session
from siltstone.operators import money_units, packed_values, timestamps
from siltstone.plans import aggregates, enrichment, files, gates, merges, scalars, similarity
from siltstone.sources.tables import table
from siltstone.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def shipped(plan: Query) -> Query:
    """plan, after the package's code was sent to the executors."""

    @functools.wraps(plan)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        session.ship(spark)
        return plan(spark, folder)

    return run


def register(name: str, plan: Query, sql: str | None = None) -> None:
    """Adds a query; sql is its DuckDB twin, or None where SQL cannot express it."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = shipped(plan)
    if sql:
        SQL[name] = sql


def dedup_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Exact duplicates of documents.text after white-space cleaning: one row per content hash."""
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    clean = F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " "))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "source", F.sha2(clean, 256).alias("content_hash"))
    return rows.groupBy("content_hash").agg(
        F.count("*").alias("observations"),
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
        F.count_distinct("source").alias("sources"),
    )


register(
    "dedup_exact",
    dedup_exact,
    r"""
    SELECT content_hash, count(*) AS observations, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
           count(DISTINCT source) AS sources
    FROM (SELECT doc_id, source, sha256(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS content_hash
          FROM documents WHERE text IS NOT NULL)
    GROUP BY content_hash""",
)
register("p4_found", packed_values.p4_found)
register("p5_found", money_units.p5_found)
register("p5_review", money_units.p5_review)
register("p7_found", timestamps.p7_found)

for _module in (scalars, merges, aggregates, similarity, gates, enrichment, files, streams):
    for _name, (_plan, _sql) in _module.QUERIES.items():
        register(_name, _plan, _sql)
