"""Dense time series and their direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_months(df: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """(key, month, value) with a zero row for every month between the first and the last one of the whole table."""
    # First and last month are scalar subqueries, so the spine is an expression of each key and no product of tables.
    bound = lambda f: F.to_date(F.concat(df.agg(f(month)).scalar(), F.lit("-01")))
    spine = F.explode(F.sequence(bound(F.min), bound(F.max), F.expr("interval 1 month")))
    grid = df.select(key).distinct().select(key, spine.alias("_d")).select(key, F.date_format("_d", "yyyy-MM").alias(month))
    return grid.join(df, [key, month], "left").select(key, month, F.coalesce(value, F.lit(0)).alias(value))


def direction(series: DataFrame, key: str, month: str, value: str, support: DataFrame | None = None) -> DataFrame:
    """One row per key: growth, the growth before, acceleration, baseline change, direction and confidence of the last month
    (W1, W2). support (key, month, independence, layers) tells the share of independent records and the research layers of a
    month; without it both are 0. The thresholds and weights are fixed values."""
    w = Window.partitionBy(key).orderBy(month)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value).cast("double")
    rows = series.withColumns({"v0": v, "v1": F.lag(v, 1).over(w), "v2": F.lag(v, 2).over(w), "mean": F.avg(v).over(past), "n": F.count("*").over(w)})
    last = rows.groupBy(key).agg(F.max(F.struct(month, "v0", "v1", "v2", "mean", "n")).alias("s")).select(key, "s.*")
    over = lambda c: F.greatest(c, F.lit(1.0))
    g = (F.col("v0") - F.col("v1")) / over(F.col("v1"))
    a = ((F.col("v0") - F.col("v1")) - (F.col("v1") - F.col("v2"))) / over(F.col("v1"))
    b = (F.col("v0") - F.col("mean")) / over(F.col("mean"))
    before = (F.col("v1") - F.col("v2")) / over(F.col("v2"))
    last = last.join(support, [key, month], "left") if support else last.withColumns({"independence": F.lit(0.0), "layers": F.lit(0)})
    out = last.withColumns({"growth": F.round(g, 6), "previous_growth": F.round(before, 6), "acceleration": F.round(a, 6), "baseline": F.round(b, 6)})
    name = (
        F.when(F.col("n") < 3, "insufficient_history").when((g >= 0.5) & (a >= 0.25), "accelerating").when((g >= 0.25) & (b >= 0.25) & (a >= 0.10), "rising")
        .when((g <= -0.25) & (a <= -0.10), "declining").when((F.abs(g) <= 0.15) & (F.abs(b) <= 0.20), "stable").otherwise("ambiguous")
    )
    bonus = F.when(name.isin("accelerating", "rising", "declining", "stable"), 1.0).otherwise(0.35)
    part = lambda c: F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))
    sure = 0.25 * part(F.abs(g)) + 0.20 * part(F.abs(b)) + 0.20 * part(F.col("independence")) + 0.20 * part(F.col("layers") / 3.0) + 0.15 * part(F.col("n") / 8.0)
    sure = F.when(F.col("n") >= 3, bonus * sure)
    return out.select(key, month, "growth", "previous_growth", "acceleration", "baseline", F.col("n").alias("months"), name.alias("direction"), F.round(F.coalesce(sure, F.lit(0.0)), 6).alias("confidence"))
