"""Event streams: windows, watermarks, deduplication, state and interval joins.

A stream reads the events table as files and is run to its end; what it writes lies in the shared folder. Each query has
a batch twin as its oracle, as all rows are on time under the watermark (Z4).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone import session

#: How late an event may be. The table is one file of unordered months, so the mark is wide.
LATE = "60 days"


def source(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns what it wrote.

    Rows of an append stream come out when the watermark passes them; update and complete results are kept per batch by
    an idempotent writer (the batch number is in the path), and the last batch of a key holds.
    """
    spark = stream.sparkSession
    base = f"{session.work_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")


def tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Events and value per type and day, by a watermarked tumbling window."""
    e = source(spark, folder).withWatermark("ts", LATE)
    out = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    rows = run(out, "update").groupBy("window", "event_type").agg(F.max(F.struct("batch", "n", "v")).alias("l"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", F.col("l.n").alias("n"), F.round("l.v", 4).alias("total"))


TUMBLING = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Events per six hours, every three hours."""
    e = source(spark, folder).withWatermark("ts", LATE)
    rows = run(e.groupBy(F.window("ts", "6 hours", "3 hours")).agg(F.count("*").alias("n")), "update")
    return rows.groupBy("window").agg(F.max_by("n", "batch").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


SLIDING = """WITH w AS (SELECT time_bucket(INTERVAL 3 HOUR, ts) - o AS s FROM events, (VALUES (INTERVAL 0 HOUR), (INTERVAL 3 HOUR)) t(o)) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM w GROUP BY 1"""


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of a user that end after an hour of silence."""
    e = source(spark, folder).withWatermark("ts", LATE)
    rows = run(e.groupBy(F.session_window("ts", "1 hour"), "user_id").agg(F.count("*").alias("n")), "complete")
    rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar())  # the last batch has all
    return rows.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


def sessions_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The same sessions in one batch."""
    e = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.groupBy(F.session_window("ts", "1 hour"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


SESSIONS = """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 1 HOUR OR ts = lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY user_id, k"""


def deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Z3: the first event of each user and type within the watermark, counted per type."""
    e = source(spark, folder).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return run(e).groupBy("event_type").agg(F.count("*").alias("users"))


DEDUPLICATED = "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"
_PROFILE = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("errors", T.LongType()), T.StructField("top", T.DoubleType())])
_STATE = T.StructType(_PROFILE.fields[1:])


def _profile(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, errors, top = state.get if state.exists else (0, 0, float("-inf"))
    for f in batches:
        n, errors, top = n + len(f), errors + int((f["event_type"] == "error").sum()), max(top, float(f["value"].max()))
    state.update((n, errors, top))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "errors": [errors], "top": [top]})


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """A running profile of each user, kept as state of its own."""
    e = source(spark, folder).where("user_id IS NOT NULL AND value IS NOT NULL")
    rows = run(e.groupBy("user_id").applyInPandasWithState(_profile, _PROFILE, _STATE, "update", GroupStateTimeout.NoTimeout), "update")
    last = rows.groupBy("user_id").agg(F.max(F.struct("batch", "n", "errors", "top")).alias("l"))
    return last.select("user_id", "l.n", "l.errors", F.round("l.top", 4).alias("top"))


PROFILES = "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(max(value), 4) AS top FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY user_id"


def interval_join(spark: SparkSession, folder: str) -> DataFrame:
    """Stream-stream join: purchases of a user within one hour after a click."""
    e = source(spark, folder)
    c = e.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("ts").alias("tc"), F.col("event_id").alias("click_id")).withWatermark("tc", LATE)
    p = source(spark, folder).where("event_type = 'purchase'").select("user_id", F.col("ts").alias("tp"), F.col("event_id").alias("purchase_id")).withWatermark("tp", LATE)
    joined = c.join(p, F.expr("u = user_id AND tp > tc AND tp <= tc + interval 1 hour"))
    return run(joined).select("click_id", "purchase_id").distinct()


INTERVAL_JOIN = "SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'"
QUERIES = {
    "stream_tumbling": (tumbling, TUMBLING), "stream_sliding": (sliding, SLIDING), "batch_sessions": (sessions_batch, SESSIONS), "stream_sessions": (sessions, SESSIONS), "stream_dedupe": (deduplicated, DEDUPLICATED), "stream_profiles": (profiles, PROFILES), "stream_interval_join": (interval_join, INTERVAL_JOIN),
}
