"""The study hub."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyceum.functions import study as fn
from lyceum.operators import study as ops
from lyceum.sources import tables as t


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return ops.signals(t.vault_files(spark, d), t.attempts(spark, d), t.as_of())


def h21_priority(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("file_id", "score", "level", F.array_join("reasons", "; ").alias("reasons"), "exam_is_past")


def h22_recommendation(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("file_id", "kind", fn.next_tab(F.col("kind")).alias("tab"))


def h19_readiness(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("file_id", "pct", "ready", "exam_ready", "minutes")


def b16_status(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("file_id", "status", "pct")


def b14_file_search(spark: SparkSession, d: str) -> DataFrame:
    f = t.vault_files(spark, d)
    return f.filter(ops.matches("Le 1", [F.col("title"), F.col("course"), F.lit(None).cast("string")], [F.array("lang", "difficulty")])).select("file_id", "title")


def b15_filtered_files(spark: SparkSession, d: str) -> DataFrame:
    """In-progress favourites in the order of the last view, files never viewed last."""
    rows = _signals(spark, d).filter("status = 'in-progress' and favorite")
    seconds = F.coalesce(F.unix_timestamp("last_viewed_at"), F.lit(0))
    return rows.select("owner_id", "file_id", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc(seconds), "file_id")).alias("place"))


def d12_average_score(spark: SparkSession, d: str) -> DataFrame:
    a = ops.attempt_summary(t.attempts(spark, d))
    return a.select("file_id", "attempts", F.round("average", 4).alias("average"), F.round("latest", 4).alias("latest"))


def d18_library_stats(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).groupBy("owner_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if("favorite").alias("favorites"), F.sum("minutes").alias("minutes"), F.round(F.avg("ready"), 4).alias("ready"))


def e18_attempts_newest_first(spark: SparkSession, d: str) -> DataFrame:
    a = t.attempts(spark, d)
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("taken_at"), F.desc("attempt_id")))
    return a.select("file_id", "attempt_id", "kind", place.alias("place"))


def f3_continue_reading(spark: SparkSession, d: str) -> DataFrame:
    rows = _signals(spark, d).filter("pct > 0 and pct < 100 and last_viewed_at is not null")
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("last_viewed_at"), "file_id"))
    return rows.withColumn("place", place).filter("place <= 6").select("owner_id", "file_id", "place")


def f6_todays_plan(spark: SparkSession, d: str) -> DataFrame:
    return ops.todays_plan(_signals(spark, d))


def f7_insights(spark: SparkSession, d: str) -> DataFrame:
    return ops.insights(_signals(spark, d)).select("owner_id", "file_id", "rule", "text", "place")


def f8_lenses(spark: SparkSession, d: str) -> DataFrame:
    return ops.lenses(_signals(spark, d), t.as_of())


def g6_merged_pages(spark: SparkSession, d: str) -> DataFrame:
    f = t.vault_files(spark, d)
    old = F.filter(F.sequence(F.lit(1), F.col("page_count")), lambda p: p % 3 == 0)
    new = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: k * 2 - 1)
    return f.select("file_id", F.array_join(ops.merged_pages(old, new, F.col("page_count")), ",").alias("pages"))


def h27_labels(spark: SparkSession, d: str) -> DataFrame:
    f = t.vault_files(spark, d)
    seconds = F.unix_timestamp(t.as_of()) - F.unix_timestamp("last_viewed_at") + F.col("file_id") * 7
    return f.select("file_id", fn.size_label(F.col("n_chars") * 97).alias("size"), fn.ago_label(seconds).alias("ago"), fn.time_label(F.col("file_id") * 13).alias("time"), (F.col("page_count") - F.col("read_count")).alias("left"))


def h38_page_window(spark: SparkSession, d: str) -> DataFrame:
    f = t.vault_files(spark, d)
    current = F.greatest(F.lit(1), F.col("read_count"))
    return f.select("file_id", F.array_join(fn.page_window(current, F.col("page_count"), 2), ",").alias("pages"))


def h40_quiz_grading(spark: SparkSession, d: str) -> DataFrame:
    """Answers against keys, equal after trim and lower case; the score in percent, halves up.

    Keys are the replies. Of three answers two are the key in lower case and padded, one is the user's own turn.
    """
    c = t.load(spark, d, "conversations")
    asked = c.filter("turn % 2 = 0").select("conv_id", "turn", F.col("text").alias("own"))
    key = c.filter("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected"))
    rows = asked.join(key, ["conv_id", "turn"])
    given = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("own")).otherwise(F.concat(F.lit("  "), F.lower("expected"), F.lit(" ")))
    right = F.lower(F.trim(given)) == F.lower(F.trim("expected"))
    rows = rows.groupBy("conv_id").agg(F.count_if(right).alias("correct"), F.count("*").alias("questions"))
    pct = fn.round_half_up(F.col("correct") / F.col("questions") * 100)
    return rows.withColumn("pct", pct).withColumn("band", F.when(pct >= 80, "great").when(pct >= 50, "fair").otherwise("weak"))


_SIGNALS = """
WITH a AS (SELECT file_id, count(*) AS attempts, avg(score) AS average, coalesce(arg_max(score, (taken_at, attempt_id)) FILTER (kind = 'quiz'), arg_max(score, (taken_at, attempt_id)) FILTER (kind = 'exam')) AS latest FROM attempts GROUP BY ALL),
base AS (SELECT f.*, attempts, average, latest, CAST(CASE WHEN page_count > 0 THEN floor(read_count / page_count * 100 + 0.5) ELSE 0 END AS BIGINT) AS pct,
  CAST(ceil((epoch(exam_date) - epoch(TIMESTAMP '2024-01-31')) / 86400) AS BIGINT) AS until, CAST(floor((epoch(TIMESTAMP '2024-01-31') - epoch(last_viewed_at)) / 86400) AS BIGINT) AS stale FROM vault_files f LEFT JOIN a USING (file_id)),
scored AS (SELECT *, CASE WHEN pct >= 100 THEN 'completed' WHEN pct > 0 THEN 'in-progress' WHEN read_count > 0 THEN 'viewed' ELSE 'not-started' END AS status,
  CASE WHEN until IS NULL THEN 0 WHEN until <= 1 THEN 45 WHEN until <= 3 THEN 35 WHEN until <= 7 THEN 22 ELSE 8 END + CASE WHEN pct > 0 AND pct < 100 THEN 18 WHEN pct = 0 THEN 6 ELSE 0 END
  + CASE WHEN stale >= 7 THEN 20 WHEN stale >= 3 THEN 10 ELSE 0 END + CASE difficulty WHEN 'hard' THEN 12 WHEN 'medium' THEN 5 ELSE 0 END + CASE WHEN average < 50 THEN 20 WHEN average < 70 THEN 10 ELSE 0 END AS raw FROM base),
leveled AS (SELECT *, greatest(0, least(100, CASE WHEN pct >= 100 AND latest >= 80 THEN least(raw, 15) ELSE raw END)) AS score FROM scored),
signals AS (SELECT *, CASE WHEN score >= 55 THEN 'high' WHEN score >= 28 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN average < 55 THEN 'needs-revision' WHEN pct >= 100 AND (average IS NULL OR average >= 80) THEN 'ready-for-exam' WHEN pct > 0 AND pct < 100 AND stale >= 5 THEN 'review-today'
    WHEN pct >= 40 AND pct < 100 THEN 'ready-for-quiz' WHEN pct > 0 AND pct < 100 THEN 'continue-reading' WHEN difficulty = 'hard' AND pct = 0 THEN 'needs-explanation'
    WHEN difficulty IS NOT NULL AND page_count > 1 AND pct = 0 THEN 'needs-flashcards' ELSE 'start-reading' END AS kind,
  CASE WHEN last_viewed_at IS NULL THEN 0 ELSE greatest(0, 100 - 5 * stale) END AS recency,
  CAST(floor(CASE WHEN average IS NULL THEN pct * 0.6::DOUBLE ELSE pct * 0.35::DOUBLE + average * 0.65::DOUBLE END + 0.5) AS BIGINT) AS exam_ready FROM leveled),
full_signals AS (SELECT *, CAST(floor(CASE WHEN average IS NULL THEN pct * 0.8::DOUBLE + recency * 0.2::DOUBLE ELSE pct * 0.6::DOUBLE + average * 0.3::DOUBLE + recency * 0.1::DOUBLE END + 0.5) AS BIGINT) AS ready,
  greatest(5, CAST(floor(greatest(1, floor(n_chars / 1000 + 0.5)) * greatest(0.0::DOUBLE, 1 - pct / 100) + 0.5) AS BIGINT)) AS minutes0 FROM signals),
done AS (SELECT *, CASE level WHEN 'high' THEN greatest(minutes0, 20) WHEN 'medium' THEN greatest(minutes0, 10) ELSE least(minutes0, 15) END AS minutes FROM full_signals)
"""
_V = "vault_files attempts"


def _q(query: str) -> str:
    return t.sql(_V, _SIGNALS + query)


_PICK = ""
for _k, (_name, _cond) in enumerate([("continue", "pct > 0 AND pct < 100"), ("review", "status <> 'not-started' AND stale >= 3"), ("practice", "pct >= 40"), ("read", "pct = 0"), ("exam", "until >= 0")]):
    _used = " AND ".join(f"NOT EXISTS (SELECT 1 FROM pick{j} p WHERE p.owner_id = d.owner_id AND p.file_id = d.file_id)" for j in range(_k)) or "true"
    _PICK += f", pick{_k} AS (SELECT owner_id, '{_name}' AS category, file_id FROM done d WHERE {_cond} AND {_used} QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, file_id) = 1)"

QUERIES = {
    "b14_file_search": (b14_file_search, t.sql("vault_files", "SELECT file_id, title FROM vault_files WHERE contains(lower(title), 'le 1') OR contains(lower(course), 'le 1')")),
    "b15_filtered_files": (b15_filtered_files, _q("SELECT owner_id, file_id, row_number() OVER (PARTITION BY owner_id ORDER BY coalesce(epoch(last_viewed_at), 0) DESC, file_id) AS place FROM done WHERE status = 'in-progress' AND favorite")),
    "b16_status": (b16_status, _q("SELECT file_id, status, pct FROM done")),
    "d12_average_score": (d12_average_score, _q("SELECT file_id, attempts, round(average, 4) AS average, round(latest, 4) AS latest FROM a")),
    "d18_library_stats": (d18_library_stats, _q("""
SELECT owner_id, count(*) AS files, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (favorite) AS favorites, CAST(sum(minutes) AS BIGINT) AS minutes, round(avg(ready), 4) AS ready FROM done GROUP BY ALL""")),
    "e18_attempts_newest_first": (e18_attempts_newest_first, t.sql("attempts", "SELECT file_id, attempt_id, kind, row_number() OVER (PARTITION BY file_id ORDER BY taken_at DESC, attempt_id DESC) AS place FROM attempts")),
    "f3_continue_reading": (f3_continue_reading, _q("""
SELECT owner_id, file_id, place FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY last_viewed_at DESC, file_id) AS place FROM done WHERE pct > 0 AND pct < 100 AND last_viewed_at IS NOT NULL) WHERE place <= 6""")),
    "f6_todays_plan": (f6_todays_plan, _q(_PICK + " SELECT * FROM pick0 UNION ALL SELECT * FROM pick1 UNION ALL SELECT * FROM pick2 UNION ALL SELECT * FROM pick3 UNION ALL SELECT * FROM pick4")),
    "f7_insights": (f7_insights, _q(""",
found AS (SELECT owner_id, file_id, 1 AS rule, 'exam ' || exam_ready AS text FROM done WHERE until BETWEEN 0 AND 7
  UNION ALL SELECT owner_id, file_id, 2, 'stale ' || stale FROM done WHERE status NOT IN ('not-started', 'completed') AND stale >= 4
  UNION ALL SELECT owner_id, file_id, 3, 'lowest' FROM (SELECT * FROM done WHERE average IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY average, file_id) = 1)
  UNION ALL SELECT owner_id, file_id, 4, 'progress ' || pct FROM (SELECT * FROM done WHERE status = 'in-progress' QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY file_id) = 1)),
both_ AS (SELECT * FROM found UNION ALL SELECT owner_id, file_id, 5, 'start' FROM (SELECT * FROM done WHERE owner_id NOT IN (SELECT owner_id FROM found) QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY ready, file_id) = 1))
SELECT owner_id, file_id, rule, text, row_number() OVER (PARTITION BY owner_id ORDER BY rule, file_id) AS place FROM both_ QUALIFY place <= 5""")),
    "f8_lenses": (f8_lenses, _q("""
SELECT owner_id, file_id, 'thisWeek' AS lens FROM done WHERE epoch(TIMESTAMP '2024-01-31') - epoch(uploaded_at) <= 604800
UNION ALL SELECT owner_id, file_id, 'nextWeek' FROM done WHERE until > 7 AND until <= 14 UNION ALL SELECT owner_id, file_id, 'completed' FROM done WHERE status = 'completed'
UNION ALL SELECT owner_id, file_id, 'needsRevision' FROM done WHERE kind = 'needs-revision'
UNION ALL SELECT owner_id, file_id, 'recentlyViewed' FROM (SELECT * FROM done WHERE last_viewed_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY last_viewed_at DESC, file_id) <= 6)
UNION ALL SELECT owner_id, file_id, 'favorites' FROM done WHERE favorite UNION ALL SELECT owner_id, file_id, 'upcomingExams' FROM done WHERE until >= 0""")),
    "g6_merged_pages": (g6_merged_pages, t.sql("vault_files", """
SELECT file_id, (SELECT coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p), '') FROM range(1, 1000000) r(p) WHERE p <= page_count AND (p % 3 = 0 OR (p % 2 = 1 AND p <= 11))) AS pages FROM vault_files""".replace("1000000", "2000"))),
    "h19_readiness": (h19_readiness, _q("SELECT file_id, pct, ready, exam_ready, minutes FROM done")),
    "h21_priority": (h21_priority, _q("""
SELECT file_id, score, level, array_to_string(list_filter([CASE WHEN until <= 1 THEN 'Exam is imminent' WHEN until > 1 THEN 'Exam in ' || until || ' days' END,
  CASE WHEN pct > 0 AND pct < 100 THEN 'Reading in progress' END, CASE WHEN stale >= 3 THEN 'Not reviewed in ' || stale || ' days' END, CASE WHEN difficulty = 'hard' THEN 'High difficulty content' END,
  CASE WHEN average < 50 THEN 'Low quiz performance' WHEN average < 70 THEN 'Room to improve quiz scores' END], lambda x: x IS NOT NULL)[1:3], '; ') AS reasons, coalesce(until < 0, false) AS exam_is_past FROM done""")),
    "h22_recommendation": (h22_recommendation, _q("""
SELECT file_id, kind, CASE kind WHEN 'ready-for-exam' THEN 'exam' WHEN 'ready-for-quiz' THEN 'quiz' WHEN 'needs-flashcards' THEN 'flashcards' ELSE 'viewer' END AS tab FROM done""")),
    "h27_labels": (h27_labels, t.sql("vault_files", """
WITH x AS (SELECT *, n_chars * 97 AS b, epoch(TIMESTAMP '2024-01-31') - epoch(last_viewed_at) + file_id * 7 AS s, file_id * 13 AS z FROM vault_files),
y AS (SELECT *, CAST(floor(s / 60) AS BIGINT) AS mi, CAST(floor(s / 3600) AS BIGINT) AS h, CAST(floor(s / 86400) AS BIGINT) AS dd, CAST(floor(z / 60 + 0.5) AS BIGINT) AS zm FROM x)
SELECT file_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.0f KB', b / 1024.0::DOUBLE) ELSE printf('%.1f MB', b / 1048576.0::DOUBLE) END AS size,
  CASE WHEN s IS NULL THEN 'Never' WHEN mi < 1 THEN 'Just now' WHEN mi < 60 THEN mi || 'm ago' WHEN h < 24 THEN h || 'h ago' WHEN dd < 7 THEN dd || 'd ago' WHEN dd // 7 < 5 THEN (dd // 7) || 'w ago' ELSE (dd // 30) || 'mo ago' END AS ago,
  CASE WHEN z < 60 THEN z || 's' WHEN zm < 60 THEN zm || 'm' WHEN zm % 60 > 0 THEN (zm // 60) || 'h ' || (zm % 60) || 'm' ELSE (zm // 60) || 'h' END AS time, page_count - read_count AS left FROM y""")),
    "h38_page_window": (h38_page_window, t.sql("vault_files", """
SELECT file_id, array_to_string(range(greatest(1, greatest(1, read_count) - 2), greatest(least(page_count, greatest(1, read_count) + 2), 1) + 1), ',') AS pages FROM vault_files""")),
    "h40_quiz_grading": (h40_quiz_grading, """
WITH r AS (SELECT q.conv_id, k.text AS expected, CASE WHEN (q.conv_id + q.turn) % 3 = 0 THEN q.text ELSE '  ' || lower(k.text) || ' ' END AS given FROM conversations q JOIN conversations k ON q.conv_id = k.conv_id AND k.turn = q.turn + 1 WHERE q.turn % 2 = 0),
g AS (SELECT conv_id, count(*) FILTER (lower(trim(given)) = lower(trim(expected))) AS correct, count(*) AS questions FROM r GROUP BY ALL)
SELECT *, CAST(floor(correct / questions * 100 + 0.5) AS BIGINT) AS pct, CASE WHEN floor(correct / questions * 100 + 0.5) >= 80 THEN 'great' WHEN floor(correct / questions * 100 + 0.5) >= 50 THEN 'fair' ELSE 'weak' END AS band FROM g"""),
}
