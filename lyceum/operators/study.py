"""The study hub over vault files: signals, plans, insights, lenses, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions import study as fn


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """file_id, attempts, average, latest: the latest quiz, or where there is none the latest exam."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("score")), F.when(F.col("kind") == kind, F.struct("taken_at", "attempt_id")))
    return attempts.groupBy("file_id").agg(F.count("*").alias("attempts"), fn.exact_avg(F.col("score")).alias("average"), F.coalesce(last("quiz"), last("exam")).alias("latest"))


def signals(files: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """files with pct, status, until, stale, attempts, average, latest, score, level, reasons, kind, ready, exam_ready, minutes."""
    rows = files.join(attempt_summary(attempts), "file_id", "left")
    rows = rows.withColumn("pct", fn.reading_percent(F.col("read_count"), F.col("page_count")))
    rows = rows.withColumns({"status": fn.status(F.col("pct"), F.col("read_count")), "until": fn.days_until(F.col("exam_date"), now), "stale": fn.days_since(F.col("last_viewed_at"), now)})
    c = {x: F.col(x) for x in ("until", "pct", "stale", "difficulty", "average", "latest")}
    rows = rows.withColumn("score", fn.priority_score(**c))
    c.pop("latest")
    rows = rows.withColumns({
        "level": fn.priority_level(F.col("score")), "reasons": fn.priority_reasons(**c),
        "kind": fn.recommendation(F.col("pct"), F.col("average"), F.col("stale"), F.col("difficulty"), F.when(F.col("difficulty").isNotNull(), F.col("page_count") - 1).otherwise(F.lit(0))),
        "ready": fn.readiness(F.col("pct"), F.col("average"), F.col("last_viewed_at"), now), "exam_ready": fn.exam_readiness(F.col("pct"), F.col("average")),
        "exam_is_past": F.coalesce(F.col("until") < 0, F.lit(False)),
    })
    return rows.withColumn("minutes", fn.study_minutes(F.greatest(F.lit(1), fn.round_half_up(F.col("n_chars") / 1000)), F.col("pct"), F.col("level")))


def todays_plan(rows: DataFrame) -> DataFrame:
    """One file per category and owner, the most urgent that no earlier category of the owner took.

    Category k can lose at most k files to those before it, so each file's place within each category bounds the
    search to k + 1 candidates; the five picks are made in order over those few, in array functions.
    """
    categories = [
        ("continue", (F.col("pct") > 0) & (F.col("pct") < 100)),
        ("review", (F.col("status") != "not-started") & (F.col("stale") >= 3)),
        ("practice", F.col("pct") >= 40),
        ("read", F.col("pct") == 0),
        ("exam", F.col("until") >= 0),
    ]
    fits = F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, (_, cond) in enumerate(categories)]))
    near = rows.select("owner_id", "file_id", "score", F.explode(fits).alias("k"))
    place = F.row_number().over(Window.partitionBy("owner_id", "k").orderBy(F.desc("score"), "file_id"))
    near = near.withColumn("place", place).filter(F.col("place") <= F.col("k") + 1)
    lists = near.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("k", "place", "file_id"))).alias("near"))  # 15 entries at most
    first = F.array().cast("array<struct<k:int,file_id:bigint>>")

    def step(taken: Column, k: Column) -> Column:
        free = F.filter(F.col("near"), lambda c: (c["k"] == k) & ~F.exists(taken, lambda t: t["file_id"] == c["file_id"]))
        return F.when(F.size(free) > 0, F.array_append(taken, F.struct(k.alias("k"), F.get(free, F.lit(0))["file_id"].alias("file_id")))).otherwise(taken)

    picks = F.aggregate(F.sequence(F.lit(0), F.lit(len(categories) - 1)), first, step)
    found = lists.select("owner_id", F.explode(picks).alias("p"))
    names = F.array(*[F.lit(name) for name, _ in categories])
    return found.select("owner_id", F.element_at(names, F.col("p.k") + 1).alias("category"), "p.file_id")


def insights(rows: DataFrame, most: int = 5) -> DataFrame:
    """Up to five observations per owner by four rules in order; if none holds, the least ready file."""
    lowest = Window.partitionBy("owner_id").orderBy("average", "file_id")
    first = Window.partitionBy("owner_id").orderBy("file_id")
    keep = ["owner_id", "file_id"]
    exam = rows.filter("until between 0 and 7").select(*keep, F.lit(1).alias("rule"), F.concat(F.lit("exam "), F.col("exam_ready").cast("string")).alias("text"))
    stale = rows.filter("status not in ('not-started', 'completed') and stale >= 4").select(*keep, F.lit(2).alias("rule"), F.concat(F.lit("stale "), F.col("stale").cast("string")).alias("text"))
    worst = rows.filter("average is not null").withColumn("n", F.row_number().over(lowest)).filter("n = 1").select(*keep, F.lit(3).alias("rule"), F.lit("lowest").alias("text"))
    going = rows.filter("status = 'in-progress'").withColumn("n", F.row_number().over(first)).filter("n = 1").select(*keep, F.lit(4).alias("rule"), F.concat(F.lit("progress "), F.col("pct").cast("string")).alias("text"))
    found = reduce(DataFrame.union, [exam, stale, worst, going])
    least = Window.partitionBy("owner_id").orderBy("ready", "file_id")
    none = rows.join(found.select("owner_id").distinct(), "owner_id", "left_anti").withColumn("n", F.row_number().over(least)).filter("n = 1")
    found = found.union(none.select(*keep, F.lit(5).alias("rule"), F.lit("start").alias("text")))
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy("rule", "file_id"))
    return found.withColumn("place", place).filter(F.col("place") <= most)


def lenses(rows: DataFrame, now: Column) -> DataFrame:
    """owner_id, file_id, lens: overlapping views of a library."""
    recent = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.col("last_viewed_at").desc_nulls_last(), "file_id"))
    rows = rows.withColumn("recent", F.when(F.col("last_viewed_at").isNotNull(), recent))
    week = F.unix_timestamp(now) - F.unix_timestamp("uploaded_at") <= 7 * fn.DAY
    found = F.array_compact(F.array(
        F.when(week, F.lit("thisWeek")), F.when((F.col("until") > 7) & (F.col("until") <= 14), F.lit("nextWeek")), F.when(F.col("status") == "completed", F.lit("completed")),
        F.when(F.col("kind") == "needs-revision", F.lit("needsRevision")), F.when(F.col("recent") <= 6, F.lit("recentlyViewed")), F.when(F.col("favorite"), F.lit("favorites")), F.when(F.col("until") >= 0, F.lit("upcomingExams")),
    ))
    return rows.select("owner_id", "file_id", F.explode(found).alias("lens"))


def matches(query: str, scalars: list[Column], arrays: list[Column]) -> Column:
    """Whether any of the values contains the query, whatever the case; a blank query meets everything."""
    if not query.strip():
        return F.lit(True)
    hay = F.concat(F.array(*scalars), *[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.exists(hay, lambda h: F.coalesce(F.contains(F.lower(h), F.lit(query.lower())), F.lit(False)))


def merged_pages(old: Column, new: Column, pages: Column) -> Column:
    """Distinct pages within the document, in order."""
    return F.array_sort(F.array_union(old, F.filter(new, lambda p: (p >= 1) & (p <= pages))))
