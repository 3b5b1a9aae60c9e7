"""Classes of lines for the similarity join."""

from lyceum.plans import text as plans

SMALL = "/root/testdata/sf0.001"


def test_tokens_of_lines_are_worked_out_once(spark, monkeypatch):
    """A filter behind the tokens worked them out twice, and classes were sorted for their text (F8)."""
    seen, real = {}, plans.stored
    monkeypatch.setattr(plans, "stored", lambda df, name: (seen.setdefault(name, df._jdf.queryExecution()), real(df, name))[1])
    plans.c10_similar_lines(spark, SMALL)
    plan = seen["classes"].optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert "SortAggregate" not in seen["classes"].executedPlan().toString()
