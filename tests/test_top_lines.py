"""Scores of sentences are added up where their document lies (F24)."""

from pyspark.sql import functions as F

from lyceum.operators import documents as ops


def test_tokens_are_dealt_once(spark):
    rows = spark.createDataFrame([(1, 0, "a b a"), (1, 1, "a c"), (1, 2, ""), (2, 0, "a"), (None, 0, "a a"), (3, 0, None)], "doc_id long, ord int, sentence string")
    found = ops.scored_sentences(rows, F.filter(F.split("sentence", " "), lambda w: w != ""))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(doc_id" in plan and not [x for x in plan.split("\n") if "Exchange" in x and "token" in x]
    got = {(r["doc_id"], r["ord"]): round(r["score"], 6) for r in found.collect()}
    assert got == {(1, 0): round((3 + 1 + 3) / 3, 6), (1, 1): 2.0, (1, 2): 0.0, (2, 0): 1.0, (None, 0): 0.0, (3, 0): 0.0}
