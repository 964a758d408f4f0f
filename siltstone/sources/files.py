"""File sources: Markdown artifacts, JSON, JSON lines, feeds, YAML configuration, SQLite tables and pages of an API."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, subsection, body) of all *.md files below a folder; text before a heading has none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    text = F.concat(F.lit("\n"), F.replace("value", F.lit("\r"), F.lit("")))
    h2 = files.select(F.input_file_name().alias("path"), F.posexplode(F.split(text, r"\n {0,3}## +")).alias("i", "piece"))
    head = F.when(F.col("i") > 0, F.trim(F.regexp_extract("piece", r"^([^\n]*)", 1)))
    rest = F.when(F.col("i") > 0, F.regexp_replace("piece", r"^[^\n]*", "")).otherwise(F.col("piece"))
    h3 = h2.select("path", "i", head.alias("section"), F.posexplode(F.split(rest, r"\n {0,3}### +")).alias("j", "part"))
    sub = F.when(F.col("j") > 0, F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)))
    body = F.trim(F.when(F.col("j") > 0, F.regexp_replace("part", r"^[^\n]*", "")).otherwise(F.col("part")), F.lit(" \n\t"))
    return h3.select("path", "i", "j", "section", sub.alias("subsection"), body.alias("body")).where((F.col("body") != "") | F.col("section").isNotNull())


def json_table(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON array (or JSON lines) of records under an explicit schema; broken records are null rows and dropped."""
    full = T.StructType.fromDDL(schema).add("_broken", T.StringType())
    df = spark.read.schema(full).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return df.where(F.col("_broken").isNull()).drop("_broken") if lines else df.where("NOT (" + " AND ".join(f"`{f.name}` IS NULL" for f in full) + ")").drop("_broken")


def feed(spark: SparkSession, path: str, limit: int | None = None, summary: int | None = None) -> DataFrame:
    """(title, link, published, summary) of the items of an RSS file; summary cuts summaries at so many characters."""
    schema = "title string, link string, pubDate string, description string"
    df = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    text = F.regexp_replace("description", "<[^>]+>", " ")
    out = df.select("title", "link", F.col("pubDate").alias("published"), (F.left(text, F.lit(summary)) if summary else text).alias("summary"))
    return out.limit(limit) if limit else out


def atom(spark: SparkSession, path: str) -> DataFrame:
    """The same of the entries of an Atom file."""
    schema = "title string, link struct<_href:string>, published string, updated string, summary string"
    df = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return df.select("title", F.col("link._href").alias("link"), F.coalesce("published", "updated").alias("published"), F.regexp_replace("summary", "<[^>]+>", " ").alias("summary"))


def flatten_sources(node, path: tuple = ()) -> Iterator[dict]:
    """Every mapping with a name and a url below node, with the keys that lead to it."""
    if isinstance(node, dict):
        if node.get("name") and node.get("url"):
            yield {"name": str(node["name"]), "url": str(node["url"]), "source_path": "/".join(path), "trust": float(node.get("trust", 0.6))}
        for key, value in node.items():
            yield from flatten_sources(value, (*path, str(key)))
    elif isinstance(node, list):
        for value in node:
            yield from flatten_sources(value, path)


def yaml_sources(spark: SparkSession, path: str) -> DataFrame:
    """Configured sources of one YAML file (a configuration: read on the driver)."""
    try:
        import yaml
    except ImportError as e:  # YAML is optional
        raise RuntimeError("reading YAML needs the yaml package") from e
    with open(path) as file:
        rows = list(flatten_sources(yaml.safe_load(file)))
    return spark.createDataFrame([tuple(r.values()) for r in rows], "name string, url string, source_path string, trust double")


class SqliteSource(DataSource):
    """A SQLite table, read in ranges of rowid; options path, table, partitions. Its schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_sqlite"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.n = options["path"], options["table"], int(options.get("partitions", 2))
        self.columns = [f.name for f in schema]

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [InputPartition((0, 0))]
        step = max(1, -(-(high - low + 1) // self.n))
        return [InputPartition((a, a + step)) for a in range(low, high + 1, step)]

    def read(self, partition):
        names = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', partition.value)


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A SQLite table as a DataFrame."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format(SqliteSource.name()).schema(schema).option("path", path).option("table", table).load()


def paged_api(spark: SparkSession, pages: int, fetch: Callable[[int], dict], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, completeness) of a paginated API: one task per page; fetch(page) gives {"items": [...], "total": n}.

    completeness has a row per page (page, received, total, error), so that a failed page shows instead of missing.
    """
    kind = T.StructType.fromDDL(schema)

    def run(batches):
        import pandas as pd

        for f in batches:
            for page in f["id"]:
                try:
                    got = fetch(int(page))
                    rows, total, error = got["items"], int(got.get("total", -1)), None
                except Exception as e:  # an error of one page is data
                    rows, total, error = [], -1, str(e)[:200]
                yield pd.DataFrame({"page": [page], "body": [json.dumps(rows)], "received": [len(rows)], "total": [total], "error": [error]})

    raw = spark.range(0, pages, 1, max(1, pages)).mapInPandas(run, "page bigint, body string, received bigint, total bigint, error string")
    from siltstone import session

    raw = session.cut(raw)  # every page is fetched once
    rows = raw.select("page", F.inline(F.from_json("body", T.ArrayType(kind))))
    return rows, raw.drop("body")


def publish(df: DataFrame, path: str, keys: list[str], partition: str | None = None) -> dict:
    """K1, K3, K7: df is staged beside path, checked (key not null, unique), and moved into place; the manifest is last.

    Returns the manifest. A failed check leaves what stood at path untouched. Works on any Hadoop file system.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    stage = f"{path.rstrip('/')}__staging"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(stage)
    back = spark.read.parquet(stage)
    bad = back.groupBy(*keys).count().where(" OR ".join([f"`{k}` IS NULL" for k in keys] + ["count > 1"])).limit(1).count()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    p = jvm.org.apache.hadoop.fs.Path
    if bad:
        fs.delete(p(stage), True)
        raise ValueError("publish: a key is null or occurs twice")
    manifest = {"rows": back.count(), "columns": back.columns, "keys": keys}
    fs.delete(p(path), True)
    fs.rename(p(stage), p(path))
    out = fs.create(p(f"{path.rstrip('/')}/_MANIFEST.json"), True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return manifest
