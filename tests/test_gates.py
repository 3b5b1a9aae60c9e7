"""The gates of made-up questions look at the quality of their distractors."""

from lyceum.plans import exam as plans

SMALL = "/root/testdata/sf0.001"


def test_distractors_are_gated(spark):
    """An option that no one would choose, or words that the question doesn't know, fail the gate and lower the total (F9)."""
    judged = {r["id"]: r["distractors"] for r in plans.j3_distractors(spark, SMALL).collect()}
    reasons = {r["id"]: r["reasons"] for r in plans.j5_gates(spark, SMALL).collect()}
    low = {i for i, q in judged.items() if q < 0.55}
    assert low and low == {i for i, told in reasons.items() if "distractors " in told}
