"""Targets of quizzes are scored once, by many tasks, and quizzes are planned by many."""

import pyarrow.parquet as pq
from lyceum.operators import exam as ops
from lyceum.plans import exam
from pyspark.sql import functions as F


def test_one_row_group_is_scored_once_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = pq.read_table("/root/testdata/sf0.001/part.parquet")
    pq.write_table(rows, tmp_path / "part.parquet", row_group_size=rows.num_rows)
    dealt = exam.candidates(spark, str(tmp_path), dealt=True)
    assert dealt.select(F.spark_partition_id().alias("task")).distinct().count() >= 8
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, exam.candidates(spark, str(tmp_path)).collect()))
    given = {}
    monkeypatch.setattr(ops, "topped_up", lambda pool, targets, write, *_: given.update(pool=pool, targets=targets, written=write(targets.select("quiz_id", "id"))) or pool)
    exam._topped_up(spark, str(tmp_path))
    assert not any(f.endswith("part.parquet") and str(tmp_path) in f for df in given.values() for f in df.inputFiles())


def test_quizzes_are_planned_by_many_tasks(spark):
    rows = spark.range(400).select(F.floor(F.col("id") / 10).alias("doc_id"), "id", F.concat(F.lit("c"), "id").alias("concept"), F.lit("analysis").alias("skill"), F.lit("").alias("facet"), F.lit(0.5).alias("importance"), F.lit("t").alias("topic"), F.array(F.lit(1)).alias("pages"), F.array(F.lit("short")).alias("writable"))
    found = ops.plan(rows, 4, ["short"]).select("doc_id", F.spark_partition_id().alias("task")).distinct()
    assert found.select("task").distinct().count() >= 8 and found.count() == 40
