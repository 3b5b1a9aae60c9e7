"""Mixing sources to target weights by a time-varying curriculum.

A training run draws words at time t in [0, 1] from each source at a rate that changes linearly: its weight
schedule. Integrated, the schedule gives each source's cumulative demand, whose end is the source's target.
Documents of a source queue in a fixed pseudo-random order, a second time through where the target exceeds
the source; a document trains when the demand reaches its place in the queue. That time is its position, and
a range sort by position gives the training order.

Everything is DataFrame functions. The running sums over a source are taken in two levels (sums of PARTS
parts of the queue, then within a part), so no task sees all of a source, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.llm.shared import WORD, cut, held

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a multiple of all sizes; and the most of one source, as a multiple of its size.
DEMAND, MOST_EPOCHS = 1.5, 2.0
#: How far the rate of a source tilts over the run, by the same cycle: falling, level, rising.
TILTS = (-0.5, 0.0, 0.5)
#: Hexadecimal digits of the queue key that name a part: 16^3 parts per source.
PART_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, tilt from (source, source_size), one row per source.

    Sources in order of code points, null last, take the weights in turn. Shares above MOST_EPOCHS sizes are
    cut there and the excess goes to the others by weight until none is above: sources that are full come
    first in the order of capacity by weight, so one pass finds how many are. Sources of size 0 have target 0.
    The table has a row per source, which bounds the windows over it.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = (F.row_number().over(in_order) - 1) % len(WEIGHTS)
    sources = sizes.withColumn("cycle", cycle).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("cycle") + 1).cast("double"))
    sources = sources.withColumn("cap", MOST_EPOCHS * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, onward = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    demand = DEMAND * F.sum("source_size").over(everything)
    level = (demand - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = sources.withColumn("level", level).withColumn("open", F.col("level") <= F.col("fill"))
    final = F.min(F.when(F.col("open"), F.struct("fill", F.col("source").isNull().alias("n"), "source", "level"))).over(everything)["level"]
    share = F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    tilt = F.element_at(F.array(*map(F.lit, TILTS)), F.col("cycle") + 1)
    return levels.select("source", "source_size", share.alias("target"), tilt.alias("tilt"))


def position_of(share: Column, tilt: Column) -> Column:
    """The time at which the integrated schedule (1 + tilt * (2t - 1)) dt reaches a share of its end.

    The integral is (1 - tilt) t + tilt t^2, a quadratic in t.
    """
    rest = 1 - tilt
    return F.when(tilt == 0, share).otherwise(2 * share / (rest + F.sqrt(F.greatest(F.lit(0.0), rest * rest + 4 * tilt * share))))


def _queued(docs: DataFrame) -> DataFrame:
    """Each row's size and place `at` in the queue of its source, with what is known of the source, and taken."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"))
    rows = cut(rows.withColumn("part", F.substring("key", 1, PART_DIGITS)), "mix-sizes")
    parts = cut(rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "mix-parts")
    queue = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_source = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))).withColumnRenamed("source", "s")
    parts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(queue), F.lit(0)))
    parts = parts.join(of_source, F.col("source").eqNullSafe(F.col("s")))
    parts = parts.select("s", F.col("part").alias("p"), "start", "source_size", "target", "tilt")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("at", F.col("start") + F.col("before"))
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    last = F.greatest(F.lit(0), F.least(F.col("size"), goal - passes * F.col("source_size") - F.col("at")))
    return placed.withColumn("taken", (passes * F.col("size") + last).cast("long"))


def _position(turn: Column) -> Column:
    """When a document trains for the turn-th time, from 0."""
    share = (F.col("at") + turn * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))
    return F.least(F.lit(1.0), position_of(share, F.col("tilt")))


def _turns() -> Column:
    """How often a document trains, in part or whole."""
    return F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, position, second_position for each row of docs, range-sorted by position.

    taken counts the words that the mix takes of the document, repeats included: each whole pass over its
    source takes it whole, the last pass takes the documents at the head of the queue, the last of them in
    part. So a source's taken words are its target, to the word, and no document exceeds twice its size.
    position is when the document first trains, second_position when it trains again (null if it doesn't).
    The queue is ordered by MD5 of the doc_id, then doc_id, size and a hash of the text, so reruns agree. Null
    ids queue under the empty string; rows that repeat an id queue one by one; null and empty texts have size
    0 and are never taken; null is a source of its own; an empty table gives an empty result; only doc_id,
    text and source are read, other columns may have any name.
    """
    found = _queued(docs).withColumn("position", F.when(_turns() > 0, _position(F.lit(0)))).withColumn("second_position", F.when(_turns() > 1, _position(F.lit(1))))
    found = found.select("doc_id", "size", "source", "source_size", "target", "taken", "position", "second_position")
    return found.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def in_training_order(docs: DataFrame) -> DataFrame:
    """docs as the mix trains on them, range-sorted by position: documents it never takes are gone, and those
    of which it takes more than their size stand twice. All columns of docs stay, whatever their names, and no
    others are added.

    A document that the last pass takes in part is kept whole. Rows that share a doc_id are one document and
    are treated alike; so are rows with a null doc_id.
    """
    one = _queued(docs).filter("taken > 0").groupBy("doc_id").agg(F.min(F.struct("at", "size", "taken", "source_size", "target", "tilt")).alias("m")).select("doc_id", "m.*")
    plan = one.select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(0), _turns() - 1)).alias("turn"), "at", "source_size", "target", "tilt")
    plan = cut(plan.select("id", "turn", _position(F.col("turn")).alias("position")), "mix-plan")
    rows = held(docs).join(plan, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")))
    return rows.orderBy("position", "id", "turn").select("row.*")
