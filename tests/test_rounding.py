"""Rounding and sums as the SQL counterparts have them, where decimal text or the order of rows would decide otherwise."""

from pyspark.sql import functions as F

from lyceum.functions import study
from lyceum.operators import activity, courses, exam
from lyceum.operators import study as hub


def test_rate_by_scaled_double(spark):
    """553 of 2,000 are 27.650000000000002 percent, 276.5 when scaled: the even neighbour is 27.6 (F8)."""
    line = spark.range(2000).select(F.col("id").alias("student_id"), F.lit("c").alias("course"), F.lit(1).alias("lesson"), (F.col("id") < 553).alias("completed"))
    row = courses.completion_rate(line.select("student_id", "course"), line.select("course", "lesson").distinct(), line).first()
    assert (row["enrolled"], row["finishers"], row["rate"]) == (2000, 553, 27.6)


def test_size_labels_by_exact_value(spark):
    """Exactly 48.5 KB and 1.25 MB go to the even digit, 49.5 KB up (F9)."""
    sizes = spark.createDataFrame([(49664,), (50688,), (1310720,), (1023,), (None,)], "n long")
    assert [r[0] for r in sizes.select(study.size_label(F.col("n"))).collect()] == ["48 KB", "50 KB", "1.2 MB", "1023 B", None]


def test_gates_tell_the_exact_value(spark):
    """The double 0.615 lies below the half, 0.625 on it: both go down (F10)."""
    columns = ", ".join(f"{n} double" for n, _ in exam.GATES)
    rows = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0, 0.615), (1.0, 0.625, 1.0, 1.0, 1.0, 1.0), (1.0, None, 1.0, 1.0, 1.0, 1.0)], columns)
    assert [r["reasons"] for r in exam.gated(rows).collect()] == ["total 0.61<0.68", "grounding 0.62<0.72", "grounding 0.00<0.72"]


def test_average_of_attempts_at_a_half(spark, tmp_path):
    """Six scores that average 48.5 exactly, in an order that doubles sum to less, round up (F7)."""
    from lyceum.plans import activity as plans

    rows = [(i, 1, "view", v) for i, v in enumerate([50.77, 91.02, 18.98, 28.42, 97.35, 4.46])]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.lit("2024-01-30").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert plans.d11_profile_stats(spark, str(tmp_path)).first()["average"] == 49


def test_points_are_exact_sums(spark):
    """Ten times 0.1 in an order that doubles sum to less than 1 (F11); what no decimal holds is summed plainly."""
    amounts = [(1, 0.1)] * 10 + [(2, float("inf")), (2, 1.0), (3, 1e25), (3, 1e25)]
    ledger = spark.createDataFrame(amounts, "user_id long, amount double").withColumn("ts", F.lit("2024-01-30 12:00:00").cast("timestamp"))
    found = {r["user_id"]: r for r in activity.totals(ledger.coalesce(1), F.lit("2024-01-31").cast("timestamp")).collect()}
    assert (found[1]["xp"], found[1]["today_xp"], found[2]["xp"], found[3]["xp"]) == (1.0, 1.0, float("inf"), 2e25)


def test_recommendation_at_its_bound(spark):
    """Six scores that average 55 exactly, in an order that doubles sum to less, aren't below 55 (F12)."""
    rows = [("f", i, "quiz", v) for i, v in enumerate([67.91, 91.86, 58.59, 81.79, 9.59, 20.26])]
    attempts = spark.createDataFrame(rows, "file_id string, attempt_id long, kind string, score double").withColumn("taken_at", F.lit("2024-01-30").cast("timestamp"))
    row = hub.attempt_summary(attempts.coalesce(1)).select("average", study.recommendation(F.lit(50), F.col("average"), F.lit(0), F.lit("easy"), F.lit(0)).alias("kind")).first()
    assert tuple(row) == (55.0, "ready-for-quiz")
