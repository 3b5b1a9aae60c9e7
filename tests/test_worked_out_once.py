"""Normal forms and cleaned lines are worked out once a row, and say the same as when they were worked out again and again."""

from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.operators import documents


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_furniture_has_one_normal_form(spark):
    """Eleven patterns are held against one normal form (F18)."""
    rows = spark.createDataFrame([("Copyright ISBN, all rights reserved. Page 3",), ("plain",), (None,)], "text string").select(fn.furniture(F.col("text")).alias("kinds"))
    assert plan(rows.repartition(1)).count("translate(") == 1
    assert [r["kinds"] for r in rows.collect()] == [["all-rights-reserved", "copyright", "isbn", "page-folio"], [], []]


def test_lines_are_cleaned_once(spark):
    """The key's filter and the text share one cleaned line (F19)."""
    docs = spark.createDataFrame([(1, "- A line of text\nCopyright 2020. It says more.\n7"), (2, None)], "doc_id long, text string")
    found = documents.cleaned(documents.lines(docs, 4))
    assert plan(found).count("aggregate(") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 1, "A line of text\nIt says more.")]
