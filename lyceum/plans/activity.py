"""Experience points, streaks, ranks, badges, challenges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyceum.functions.study import exact_avg, round_half_up
from lyceum.operators import activity as ops
from lyceum.sources import tables as t


def _users(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each user with the name, department and region of the customer of that number."""
    c = t.load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("department"), F.col("c_nationkey").alias("faculty"))
    found = ops.totals(t.ledger(spark, d), t.as_of())
    rounded = {x: F.round(x, 6) for x in ("xp", "today_xp", "weekly_xp", "monthly_xp")}
    return found.withColumns(rounded).join(c, "user_id")


def d8_xp_totals(spark: SparkSession, d: str) -> DataFrame:
    return ops.totals(t.ledger(spark, d), t.as_of()).select("user_id", *[F.round(x, 4).alias(x) for x in ("xp", "today_xp", "weekly_xp", "monthly_xp")])


def h17_levels(spark: SparkSession, d: str) -> DataFrame:
    users = ops.totals(t.ledger(spark, d), t.as_of()).select("user_id", F.floor("xp").cast("double").alias("xp"))
    return ops.levels(users)


def d10_study_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = t.load(spark, d, "events").filter("event_type = 'view'")
    return ops.study_blocks(e.select("user_id", F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("minutes")))


def d11_profile_stats(spark: SparkSession, d: str) -> DataFrame:
    """Attempts, average score and hours, per user; halves up."""
    a = t.attempts(spark, d)
    hours = round_half_up(F.sum(F.floor(F.col("score") * 60)) / 3600 * 10) / 10
    return a.groupBy(F.col("file_id").alias("user_id")).agg(F.count("*").alias("attempts"), round_half_up(exact_avg(F.col("score"))).alias("average"), hours.alias("hours"))


def d14_challenges(spark: SparkSession, d: str) -> DataFrame:
    goals = [("daily", "view", 3), ("daily", "click", 2), ("weekly", "view", 10), ("weekly", "purchase", 5)]
    challenges = spark.createDataFrame(goals, "cadence string, metric string, target long")
    rows = t.load(spark, d, "events").select("user_id", "ts", F.col("event_type").alias("metric"), F.lit(1).cast("long").alias("amount"))
    found = ops.challenge_progress(rows, challenges)
    return found.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


def d20_rows_by_week(spark: SparkSession, d: str) -> DataFrame:
    e = t.load(spark, d, "events")
    week = F.date_trunc("week", "ts")
    return e.groupBy(F.date_format(week, "yyyy-MM-dd").alias("week"), "event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


def d31_favourite_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The four event types that a user has most of; ties go to the type met first."""
    n = t.load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "first"))
    return n.withColumn("place", place).filter("place <= 4").select("user_id", "event_type", "n", "place")


def d32_heat_map(spark: SparkSession, d: str) -> DataFrame:
    return ops.heat_map(t.ledger(spark, d), t.as_of()).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def e1_ranks(spark: SparkSession, d: str) -> DataFrame:
    return ops.ranked(_users(spark, d), "weekly_xp").select("user_id", "name", "weekly_xp", "rank")  # one ranking over all is the feature


def e1_ranks_by_department(spark: SparkSession, d: str) -> DataFrame:
    return ops.ranked(_users(spark, d), "monthly_xp", "department").select("user_id", "department", "monthly_xp", "rank")


def e2_filtered_ranks(spark: SparkSession, d: str) -> DataFrame:
    pool = ops.filtered_pool(_users(spark, d), 7, (F.col("department") == "BUILDING") & F.lower("name").contains("1"))
    return ops.ranked(pool, "xp").select("user_id", "name", "xp", "rank")


def e3_own_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank and size of the pool of each user within their department."""
    found = ops.ranked(_users(spark, d), "xp", "department")
    return found.select("user_id", "rank", F.count("*").over(Window.partitionBy("department")).alias("pool"))


def e5_week_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Weeks in which files came in, numbered from the earliest; the weeks of a library are few."""
    files = t.vault_files(spark, d).groupBy("owner_id", F.date_format(F.date_trunc("week", "uploaded_at"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("files"))
    return files.withColumn("number", F.dense_rank().over(Window.partitionBy("owner_id").orderBy("week")))


def e8_streaks(spark: SparkSession, d: str) -> DataFrame:
    days = t.load(spark, d, "events").filter("event_type <> 'error'").select("user_id", F.to_date("ts").alias("day"))
    return ops.streaks(days).withColumn("last_day", F.date_format("last_day", "yyyy-MM-dd"))


def f2_recent_ledger(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("tx_id")))
    return t.ledger(spark, d).withColumn("place", place).filter("place <= 8").select("user_id", "tx_id", "source", "place")


def f4_next_unlock(spark: SparkSession, d: str) -> DataFrame:
    """The first level above the user's own that unlocks something."""
    unlocks = F.array(*[F.lit(x) for x in (5, 10, 15, 20, 25, 30)])
    users = h17_levels(spark, d)
    return users.select("user_id", "level", F.array_min(F.filter(unlocks, lambda u: u > F.col("level"))).alias("next_unlock"))


def g12_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Four of eight daily challenges for each day of events."""
    periods = t.load(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("period")).distinct()
    return ops.rotation(periods, size=8, take=4)


def j13_badges(spark: SparkSession, d: str) -> DataFrame:
    users = _users(spark, d)
    over = lambda field, *scope: ops.ranked(users, field, *scope).select("user_id", "rank")
    ranks = over("xp").withColumnRenamed("rank", "rank")
    weekly, monthly = over("weekly_xp").withColumnRenamed("rank", "weekly_rank"), over("monthly_xp").withColumnRenamed("rank", "monthly_rank")
    faculty = over("xp", "faculty").withColumnRenamed("rank", "faculty_rank")
    a = t.attempts(spark, d).groupBy(F.col("file_id").alias("user_id")).agg(
        F.max("score").alias("best_score"), F.max(F.when(F.col("kind") == "exam", F.col("score"))).alias("best_exam"), F.count_if(F.col("kind") == "exam").alias("exams"), F.count_if(F.col("kind") == "quiz").alias("quizzes"))
    used = t.ledger(spark, d).groupBy("user_id").agg(F.bool_or(F.col("source") == "click").alias("used_notes"), F.bool_or(F.col("source") == "purchase").alias("used_bookmarks"))
    facts = users.join(ranks, "user_id").join(weekly, "user_id").join(monthly, "user_id").join(faculty, "user_id").join(a, "user_id", "left").join(used, "user_id").join(e8_streaks(spark, d), "user_id")
    facts = facts.withColumns({
        "streak": F.col("longest"), "courses_completed": F.floor(F.coalesce("exams", F.lit(0)) / 10), "used_quiz": F.coalesce("quizzes", F.lit(0)) > 0, "used_exam": F.coalesce("exams", F.lit(0)) > 0,
        "pool": F.count("*").over(Window.partitionBy()), "engineering": F.col("faculty") < 5,
    })
    return ops.badges(facts).select("user_id", F.array_join("badges", ",").alias("badges"))


def k_study_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Visible time: a view opens an interval that the user's next event closes; kept if longer than 2 seconds, at most an hour."""
    e = t.load(spark, d, "events")
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seconds = F.unix_timestamp("until") - F.unix_timestamp("ts")
    rows = e.withColumn("until", nxt).filter("event_type = 'view' and until is not null").withColumn("seconds", F.least(F.lit(3600), seconds)).filter("seconds > 2")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("seconds").alias("seconds"))


_TOTALS = """
WITH totals AS (SELECT user_id, greatest(0.0::DOUBLE, sum(amount)) AS xp,
  coalesce(sum(amount) FILTER (amount > 0 AND ts >= TIMESTAMP '2024-01-30'), 0.0::DOUBLE) AS today_xp,
  coalesce(sum(amount) FILTER (amount > 0 AND ts >= TIMESTAMP '2024-01-24'), 0.0::DOUBLE) AS weekly_xp,
  coalesce(sum(amount) FILTER (amount > 0 AND ts >= TIMESTAMP '2024-01-01'), 0.0::DOUBLE) AS monthly_xp FROM ledger GROUP BY ALL),
users AS (SELECT user_id, round(xp, 6) AS xp, round(weekly_xp, 6) AS weekly_xp, round(monthly_xp, 6) AS monthly_xp, c_name AS name, c_mktsegment AS department, c_nationkey AS faculty
  FROM totals JOIN customer ON user_id = c_custkey)
"""
_LEVELS = _TOTALS.rstrip() + """,
points AS (SELECT user_id, floor(xp) AS xp FROM totals),
levels AS (SELECT user_id, xp, (SELECT max(n) FROM range(1, 2000) r(n) WHERE CASE WHEN n <= 1 THEN 0 ELSE 250.0::DOUBLE * ((n - 1) * n / 2 + n - 1) END <= xp) AS level FROM points),
curve AS (SELECT *, CASE WHEN level <= 1 THEN 0.0::DOUBLE ELSE 250.0::DOUBLE * ((level - 1) * level / 2 + level - 1) END AS low, 250.0::DOUBLE * (level * (level + 1) / 2 + level) AS high FROM levels)
"""
_DAYS = """
WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type <> 'error'),
runs AS (SELECT user_id, island, count(*) AS n, max(day) AS last FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM days) GROUP BY ALL),
streaks AS (SELECT user_id, max(n) AS longest, arg_max(n, last) AS current, strftime(max(last), '%Y-%m-%d') AS last_day FROM runs GROUP BY ALL)
"""

QUERIES = {
    "d8_xp_totals": (d8_xp_totals, t.sql("ledger", _TOTALS + "SELECT user_id, round(xp, 4) AS xp, round(today_xp, 4) AS today_xp, round(weekly_xp, 4) AS weekly_xp, round(monthly_xp, 4) AS monthly_xp FROM totals")),
    "d10_study_blocks": (d10_study_blocks, """
WITH runs AS (SELECT user_id, event_id AS seq, m, sum(m) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM (SELECT *, CAST(floor(value) AS BIGINT) AS m FROM events WHERE event_type = 'view') WHERE m > 0)
SELECT user_id, seq, CAST(unnest(range(CAST((after - m) // 30 + 1 AS BIGINT), CAST(after // 30 + 1 AS BIGINT))) AS BIGINT) AS block FROM runs"""),
    "d11_profile_stats": (d11_profile_stats, t.sql("attempts", """
SELECT file_id AS user_id, count(*) AS attempts, CAST(floor(avg(score) + 0.5) AS BIGINT) AS average, floor(sum(floor(score * 60)) / 3600 * 10 + 0.5) / 10 AS hours FROM attempts GROUP BY ALL""")),
    "d14_challenges": (d14_challenges, """
WITH goals(cadence, metric, target) AS (VALUES ('daily', 'view', 3), ('daily', 'click', 2), ('weekly', 'view', 10), ('weekly', 'purchase', 5)),
sums AS (SELECT user_id, 'daily' AS cadence, CAST(ts AS DATE) AS period, event_type AS metric, count(*) AS n FROM events GROUP BY ALL
  UNION ALL SELECT user_id, 'weekly', CAST(date_trunc('week', ts) AS DATE), event_type, count(*) FROM events GROUP BY ALL)
SELECT user_id, cadence, strftime(period, '%Y-%m-%d') AS period, metric, CAST(least(target, n) AS BIGINT) AS progress, n >= target AS complete FROM sums JOIN goals USING (cadence, metric)"""),
    "d20_rows_by_week": (d20_rows_by_week, "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ALL"),
    "d31_favourite_subjects": (d31_favourite_subjects, """
SELECT user_id, event_type, n, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS place FROM
  (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)) WHERE place <= 4"""),
    "d32_heat_map": (d32_heat_map, t.sql("ledger", """
WITH active AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM ledger WHERE amount > 0)
SELECT u.user_id, strftime(c.day, '%Y-%m-%d') AS day, a.day IS NOT NULL AS lit FROM (SELECT DISTINCT user_id FROM ledger) u
CROSS JOIN (SELECT DATE '2024-01-31' - CAST(n AS INTEGER) AS day FROM range(28) r(n)) c LEFT JOIN active a ON a.user_id = u.user_id AND a.day = c.day""")),
    "e1_ranks": (e1_ranks, t.sql("ledger", _TOTALS + "SELECT user_id, name, weekly_xp, row_number() OVER (ORDER BY weekly_xp DESC, xp DESC, name, user_id) AS rank FROM users")),
    "e1_ranks_by_department": (e1_ranks_by_department, t.sql("ledger", _TOTALS + "SELECT user_id, department, monthly_xp, row_number() OVER (PARTITION BY department ORDER BY monthly_xp DESC, xp DESC, name, user_id) AS rank FROM users")),
    "e2_filtered_ranks": (e2_filtered_ranks, t.sql("ledger", _TOTALS + """
SELECT user_id, name, xp, row_number() OVER (ORDER BY xp DESC, name, user_id) AS rank FROM users WHERE user_id = 7 OR (department = 'BUILDING' AND contains(lower(name), '1'))""")),
    "e3_own_rank": (e3_own_rank, t.sql("ledger", _TOTALS + "SELECT user_id, row_number() OVER (PARTITION BY department ORDER BY xp DESC, name, user_id) AS rank, count(*) OVER (PARTITION BY department) AS pool FROM users")),
    "e5_week_numbers": (e5_week_numbers, t.sql("vault_files", """
SELECT owner_id, week, files, dense_rank() OVER (PARTITION BY owner_id ORDER BY week) AS number FROM (SELECT owner_id, strftime(date_trunc('week', uploaded_at), '%Y-%m-%d') AS week, count(*) AS files FROM vault_files GROUP BY ALL)""")),
    "e8_streaks": (e8_streaks, _DAYS + "SELECT * FROM streaks"),
    "f2_recent_ledger": (f2_recent_ledger, t.sql("ledger", "SELECT user_id, tx_id, source, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, tx_id DESC) AS place FROM ledger) WHERE place <= 8")),
    "f4_next_unlock": (f4_next_unlock, t.sql("ledger", _LEVELS + "SELECT user_id, level, (SELECT min(u) FROM (VALUES (5), (10), (15), (20), (25), (30)) v(u) WHERE u > level) AS next_unlock FROM curve")),
    "g12_rotation": (g12_rotation, None),
    "h17_levels": (h17_levels, t.sql("ledger", _LEVELS + """
SELECT user_id, xp, level, xp - low AS "into", greatest(0.0::DOUBLE, high - xp) AS to_next, CAST(least(100, floor((xp - low) / (high - low) * 100 + 0.5)) AS BIGINT) AS progress FROM curve""")),
    "j13_badges": (j13_badges, t.sql("ledger attempts", _TOTALS.rstrip() + ", " + _DAYS.strip()[5:] + """,
a AS (SELECT file_id AS user_id, max(score) AS best_score, max(score) FILTER (kind = 'exam') AS best_exam, count(*) FILTER (kind = 'exam') AS exams, count(*) FILTER (kind = 'quiz') AS quizzes FROM attempts GROUP BY ALL),
used AS (SELECT user_id, bool_or(source = 'click') AS notes, bool_or(source = 'purchase') AS bookmarks FROM ledger GROUP BY ALL),
facts AS (SELECT u.*, longest, best_score, best_exam, coalesce(exams, 0) AS exams, coalesce(quizzes, 0) AS quizzes, notes, bookmarks, count(*) OVER () AS pool,
  row_number() OVER (ORDER BY xp DESC, name, u.user_id) AS rank, row_number() OVER (PARTITION BY faculty ORDER BY xp DESC, name, u.user_id) AS faculty_rank,
  row_number() OVER (ORDER BY weekly_xp DESC, xp DESC, name, u.user_id) AS weekly_rank, row_number() OVER (ORDER BY monthly_xp DESC, xp DESC, name, u.user_id) AS monthly_rank
  FROM users u LEFT JOIN a USING (user_id) JOIN used USING (user_id) JOIN streaks USING (user_id))
SELECT user_id, concat_ws(',', CASE WHEN longest >= 30 THEN '30-day-streak' END, CASE WHEN best_score >= 100 THEN 'perfect-quiz' END, CASE WHEN exams // 10 >= 10 THEN 'course-master' END,
  CASE WHEN quizzes > 0 AND exams > 0 AND notes AND bookmarks THEN 'ai-explorer' END, CASE WHEN exams // 10 >= 1 AND best_exam >= 85 THEN 'fast-learner' END,
  CASE WHEN rank <= 10 AND pool >= 10 THEN 'top-10-student' END, CASE WHEN faculty < 5 AND faculty_rank = 1 THEN 'top-engineering-student' END,
  CASE WHEN weekly_rank = 1 THEN 'weekly-champion' END, CASE WHEN monthly_rank = 1 THEN 'monthly-champion' END) AS badges FROM facts""")),
    "k_study_sessions": (k_study_sessions, """
SELECT user_id, count(*) AS sessions, CAST(sum(seconds) AS BIGINT) AS seconds FROM (
  SELECT user_id, event_type, least(3600, CAST(floor(epoch(until)) - floor(epoch(ts)) AS BIGINT)) AS seconds FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events) WHERE until IS NOT NULL)
WHERE event_type = 'view' AND seconds > 2 GROUP BY ALL"""),
}
