"""Comparing the members of groups in blocks, so that no task holds a group whole and no pair becomes a row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block; a task's unit holds one block, or two.
BLOCK = 2_048
#: Rows of a matrix worked on at once.
_STRIP = 512


def in_units(rows: DataFrame, keys: list[str], node: Column, block: int = BLOCK) -> DataFrame:
    """rows with unit_a, unit_b and part: groups of keys, cut into units to compare.

    A group of up to `block` rows is one unit (0, 0). A larger one is dealt into parts by a hash of node, and
    each pair of parts is a unit: its rows stand in as many units as the group has parts. All pairs of a
    group meet, each in one unit. The sizes that decide are joined as a table, which Spark broadcasts only
    if it finds it small.
    """
    large = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > block)
    large = large.select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("__n") / block).cast("int").alias("__parts"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    dealt = rows.join(large, on, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(node), F.col("__parts")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    return dealt.withColumn("unit_a", F.least("part", "__other")).withColumn("unit_b", F.greatest("part", "__other")).drop("__parts", "__other", *[f"__{k}" for k in keys])


def strips(n: int) -> list[slice]:
    """Slices that cover n rows, a strip each."""
    return [slice(i, i + _STRIP) for i in range(0, n, _STRIP)]


def spread_labels(linked: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """For a boolean matrix, the smallest row number that each row reaches.

    columns: the row that each column stands for; without it the matrix is square and symmetric.
    """
    n = len(linked)
    columns = np.arange(n) if columns is None else columns
    labels = np.arange(n, dtype=np.int32)
    while True:
        new = labels.copy()
        for strip in strips(n):
            here = linked[strip]
            if here.any():
                new[strip] = np.minimum(new[strip], np.where(here, new[columns][None, :], n).min(axis=1))
                new[columns] = np.minimum(new[columns], np.where(here, new[strip][:, None], n).min(axis=0))
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new
