"""Cosine neighbours within a scope by blocks, against the plain join of all pairs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lyceum.operators import records as ops


def plain(queries, vectors, k):
    met = queries.join(vectors, "scope").filter("query_id <> id")
    similarity = ops._dot(F.col("q"), F.col("v")) / F.sqrt(ops._dot(F.col("q"), F.col("q")) * ops._dot(F.col("v"), F.col("v")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return met.select("query_id", "id", similarity.alias("similarity")).withColumn("place", place).filter(F.col("place") <= k)


@pytest.mark.parametrize("odd", [False, True])
def test_blocks_equal_all_pairs(spark, monkeypatch, odd):
    monkeypatch.setattr(ops, "QUERY_BLOCK", 16)
    monkeypatch.setattr(ops, "VECTOR_BLOCK", 40)
    rng = random.Random(1)
    vector = lambda n=8: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, rng.choice([1, 2, None]), vector()) for i in range(300)]
    rows += [(1000 + i, 1, rows[7][2]) for i in range(60)]  # a group of copies: ties go by id
    rows += [(2000, 5, vector()), (2020, 5, vector()), (None, 1, vector())]
    if odd:
        rows += [(3000, 1, None), (3020, 2, [1.0, None]), (3040, 5, vector(3)), (3060, 5, [1e-80] * 8), (3080, 2, [float("nan")] * 8)]
    e = spark.createDataFrame(rows, "id long, scope int, v array<float>")
    q = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "scope", F.col("v").alias("q"))
    if odd:
        q, e = q.filter("query_id <> 3060"), e.filter("id is null or id <> 3060")
    show = lambda df: sorted(map(str, df.select("query_id", "id", "similarity", "place").collect()))
    found = ops.nearest(q, e, 5)
    assert show(found) == show(plain(q, e, 5))
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()  # no row for each pair
