"""Key merges: latest row per key, upserts, first-wins inserts, observation folds and dimension syncs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that is largest by order; a hash aggregate, so no group is sorted as a whole.

    order must end in something unique, or ties give the row with the largest remaining columns.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*[F.col(c) for c in rest]).alias("r"))).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.r.*").select(*df.columns)


def earliest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that is smallest by order (first writer wins)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(F.struct(*order).alias("o"), F.struct(*[F.col(c) for c in rest]).alias("r"))).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.r.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """K4, K6: old with the rows of new, the latest of each key in new replacing the whole row of old."""
    fresh = latest(new, keys, *order)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """K5: old with those rows of new whose key it lacks, the first of each key."""
    return old.unionByName(earliest(new, keys, *order).join(old.select(*keys), keys, "left_anti"))


def sync(registry: DataFrame, config: DataFrame, key: str) -> DataFrame:
    """Full outer merge of a registry (key, status) with its configuration (key): update, insert or deprecate."""
    both = registry.select(key, F.col("status").alias("old")).join(config.select(key, F.lit(1).alias("_c")), key, "full_outer")
    action = F.when(F.col("_c").isNull(), "deprecate").when(F.col("old").isNull(), "insert").otherwise("update")
    return both.select(key, "old", action.alias("action"))


def stamp(text: Column) -> Column:
    """Parsed ISO stamp; texts that are none sort last (H4)."""
    return F.coalesce(F.try_to_timestamp(text), F.lit("9999-12-31 00:00:00").cast(T.TimestampType()))


def observations(df: DataFrame, key: str, seen: str, first: list[str], last: list[str], sets: list[str]) -> DataFrame:
    """A1: one row per key: count, min and max of the stamp as text, the columns first of the earliest and last of the
    latest observation, and the sorted distinct values of sets."""
    when = stamp(F.col(seen))
    tie = F.struct(*[F.col(c) for c in sorted({*first, *last})])
    early = F.min(F.struct(when, tie.alias("t"), F.struct(*first).alias("v"))).alias("_f")
    late = F.max(F.struct(when, tie.alias("t"), F.struct(*last).alias("v"))).alias("_l")
    unions = [F.array_sort(F.collect_set(c)).alias(f"{c}_variants") for c in sets]
    out = df.groupBy(key).agg(F.count("*").alias("observation_count"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), early, late, *unions)
    return out.select(key, "observation_count", "first_seen", "last_seen", *[F.col(f"_f.v.{c}").alias(f"first_{c}") for c in first], *[F.col(f"_l.v.{c}").alias(f"latest_{c}") for c in last], *[f"{c}_variants" for c in sets])
