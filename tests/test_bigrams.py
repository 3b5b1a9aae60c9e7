"""Pairs of tokens are counted where their document lies (F22)."""

from pyspark.sql import functions as F

from lyceum.operators import documents as ops


def test_one_shuffle_and_pages_of_a_document_count_together(spark):
    pages = spark.createDataFrame([(1, "red fox red fox"), (1, "red fox sees"), (2, "red fox"), (None, "a b a b"), (3, ""), (4, None)], "doc_id long, text string")
    found = ops.key_bigrams(pages, F.split("text", " "))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1
    assert sorted((r["doc_id"] or 0, r["term"], r["n"], r["place"]) for r in found.collect()) == [(0, "A B", 2, 1), (1, "Red Fox", 3, 1)]
