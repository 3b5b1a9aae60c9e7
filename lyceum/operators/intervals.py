"""Intervals: gaps, classes of gaps, containment, as-of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """key, start, stop: what the spans (key, start, stop) leave free of [0, total), total per key.

    The reach before a span is the largest end before it. A key of totals without spans is one gap.
    """
    order = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.greatest(F.lit(0.0), F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    inner = spans.select("key", reach.alias("from"), F.col("start").alias("to"))
    last = totals.join(spans.groupBy("key").agg(F.max("stop").alias("end")), "key", "left").select("key", F.greatest(F.lit(0.0), F.coalesce("end", F.lit(0.0))).alias("from"), F.col("total").alias("to"))
    return inner.union(last).filter(F.col("to") > F.col("from")).select("key", F.col("from").alias("start"), F.col("to").alias("stop"))


def gap_class(start: Column, stop: Column) -> Column:
    """Set-up time before a pause that means something; dead air from 40 on; else waiting."""
    length = stop - start
    return F.when(start < 20, "setup-time").when(length <= 8, "meaningful-pause").when(length > 40, "dead-air").otherwise("waiting")


def classified_gaps(found: DataFrame, least: float = 3.0) -> DataFrame:
    """Gaps of at least `least`, with reason and whether they are removed."""
    kept = found.filter(F.col("stop") - F.col("start") >= least).withColumn("reason", gap_class(F.col("start"), F.col("stop")))
    return kept.withColumn("removed", F.col("reason") != "meaningful-pause")


def as_of(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left (key, at, id) with the value of the last row of right (key, at, value) at or before it.

    Both sides go into one ordered pass per key; at equal times right comes first.
    """
    rows = left.select("key", "at", F.lit(1).alias("side"), "id", F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(
        right.select("key", "at", F.lit(0).alias("side"), F.lit(None).cast(left.schema["id"].dataType).alias("id"), value)
    )
    order = Window.partitionBy("key").orderBy("at", "side", value).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(order)).filter("side = 1").select("key", "at", "id", value)


def inside(points: DataFrame, spans: DataFrame, width: float) -> DataFrame:
    """points (key, at, id) joined to the spans (key, start, stop) that hold them, start included, stop not.

    Both meet in bins of `width`, so the join is on (key, bin); a span stands in each bin that it touches.
    """
    p = points.withColumn("bin", F.floor(F.col("at") / width))
    s = spans.select(F.col("key").alias("__key"), "start", "stop").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    met = (F.col("key") == F.col("__key")) & (F.col("bin") == F.col("__bin")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop"))
    return p.join(s, met).select("key", "at", "id", "start", "stop")
