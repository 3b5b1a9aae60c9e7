"""Declared aliases: found as by their pattern alone, without reading every sentence by it."""

import time

from pyspark.sql import functions as F

from lyceum.functions import words
from lyceum.operators import concepts as ops

SAID = [
    "The mitotic spindle (MS) forms.", "Deoxyribonucleic acid ( DNA ) copies itself.", "A (B) and (1x) or ().", "An acid, commonly known as vitriol, burns.", "Sodium chloride abbreviated NaCl, dissolves.",
    "The law referred to as inertia.", "It is called osmosis; water moves.", "Well-known facts, called upon here", "Knownly unknown ones.", "The set (see ) of x ( ab )", "Çelik (çe) und Stahl (st)", "plain words without any", "", None,
]


def test_aliases_are_those_of_the_pattern(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(SAID)], "doc_id long, sentence string")
    by_pattern = {r[0] for r in rows.filter(F.col("sentence").rlike("(?U)" + words.ALIAS)).collect()}
    by_guard = {r[0] for r in rows.filter(F.col("sentence").rlike("(?U)" + words.ALIAS_DECLARED)).collect()}
    assert by_pattern <= by_guard and len(by_pattern) >= 6
    assert {r["doc_id"] for r in ops.declared_aliases(rows).collect()} <= by_pattern
    assert ("mitotic spindle", "ms") in {(r["full"].removeprefix("the "), r["alias"]) for r in ops.declared_aliases(rows).collect()}


def test_sentences_that_declare_nothing_cost_little(spark):
    """The pattern alone took most of the time of concepts: it tries sixty ends from each letter."""
    rows = spark.range(8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("water moves through a membrane "), 3_000).alias("sentence")).localCheckpoint()

    def seconds(df):
        start = time.perf_counter()
        assert df.count() == 0
        return time.perf_counter() - start

    by_pattern = rows.filter(F.col("sentence").rlike("(?U)" + words.ALIAS))
    assert min(seconds(ops.declared_aliases(rows)) for _ in range(3)) < min(seconds(by_pattern) for _ in range(2)) / 3
