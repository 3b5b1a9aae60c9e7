"""Ledgers, streaks, rankings, badges, challenges and heat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.sources.shared import stored
from lyceum.functions.study import exact_sum, level_of, round_half_up, xp_for_level


def totals(ledger: DataFrame, as_of: Column) -> DataFrame:
    """user_id, xp (never below 0) and the points of the last 24 hours, 7 and 30 days, spending left out; sums are exact."""
    gained = lambda days: F.coalesce(exact_sum(F.when((F.col("amount") > 0) & (F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS")), F.col("amount"))), F.lit(0.0))
    return ledger.groupBy("user_id").agg(
        F.greatest(F.lit(0.0), exact_sum(F.col("amount"))).alias("xp"), gained(1).alias("today_xp"), gained(7).alias("weekly_xp"), gained(30).alias("monthly_xp")
    )


def levels(users: DataFrame) -> DataFrame:
    """Level, points into it, points to the next and progress in percent, from xp."""
    found = users.withColumn("level", level_of(F.col("xp")))
    low, high = xp_for_level(F.col("level")), xp_for_level(F.col("level") + 1)
    points = F.greatest(F.lit(0.0), F.floor("xp").cast("double"))
    return found.withColumns({"into": points - low, "to_next": F.greatest(F.lit(0.0), high - points), "progress": F.least(F.lit(100), round_half_up((points - low) / (high - low) * 100))})


def streaks(days: DataFrame) -> DataFrame:
    """user_id, longest, current: runs of consecutive days, by day less its number in the row of distinct days."""
    distinct = days.select("user_id", "day").distinct()
    island = F.date_sub(F.col("day"), F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = distinct.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), F.max_by("n", "last").alias("current"), F.max("last").alias("last_day"))


def study_blocks(rows: DataFrame, minutes: int = 30) -> DataFrame:
    """One award for each boundary of `minutes` that the running total of study time crosses: user_id, seq, block."""
    total = F.sum("minutes").over(Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.filter("minutes > 0").withColumn("after", total)
    before, after = F.floor((F.col("after") - F.col("minutes")) / minutes), F.floor(F.col("after") / minutes)
    crossed = found.filter(after > before)
    return crossed.select("user_id", "seq", F.explode(F.sequence(before + 1, after)).alias("block"))


def heat_map(ledger: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    """user_id, day, lit: a dense calendar of the last days, a day lit by any positive amount."""
    users = ledger.select("user_id").distinct()
    last = as_of.cast("date")
    calendar = users.withColumn("day", F.explode(F.sequence(F.date_sub(last, days - 1), last)))
    active = ledger.filter("amount > 0").select("user_id", F.to_date("ts").alias("day")).distinct().withColumn("lit", F.lit(True))
    return calendar.join(active, ["user_id", "day"], "left").withColumn("lit", F.coalesce("lit", F.lit(False)))


def ranked(entries: DataFrame, field: str, *scope: str) -> DataFrame:
    """Unique ranks from 1 by field, then xp, both falling, then name.

    Within a scope by a window. Over everybody by ranges: rows are dealt out and sorted by the order itself, and a
    row's rank is its place in its part after the rows of the parts before, so no task sees all. The places are
    written as a table first, as both counts must see the same parts.
    """
    order = [F.desc(field), F.desc("xp"), "name", "user_id"]
    if not scope:
        dealt = entries.repartitionByRange(*order).sortWithinPartitions(*order)
        dealt = stored(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")), "ranks")
        sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
        before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row per part
        starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
        return dealt.join(F.broadcast(starts), "__part").withColumn("rank", (F.col("__before") + F.col("__place") + 1).cast("int")).drop("__part", "__place", "__before")
    return entries.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))


def filtered_pool(pool: DataFrame, current_user: int, condition: Column) -> DataFrame:
    """Entries that meet the condition, and the current user whether or not they do."""
    return pool.filter(F.coalesce(condition, F.lit(False)) | (F.col("user_id") == current_user))


def badges(facts: DataFrame) -> DataFrame:
    """facts with the badges earned. Rules in order, each from columns of facts."""
    rules = [
        (F.col("streak") >= 30, "30-day-streak"),
        (F.col("best_score") >= 100, "perfect-quiz"),
        (F.col("courses_completed") >= 10, "course-master"),
        (F.col("used_quiz") & F.col("used_exam") & F.col("used_notes") & F.col("used_bookmarks"), "ai-explorer"),
        ((F.col("courses_completed") >= 1) & (F.col("best_exam") >= 85), "fast-learner"),
        ((F.col("rank") <= 10) & (F.col("pool") >= 10), "top-10-student"),
        (F.col("engineering") & (F.col("faculty_rank") == 1), "top-engineering-student"),
        (F.col("weekly_rank") == 1, "weekly-champion"),
        (F.col("monthly_rank") == 1, "monthly-champion"),
    ]
    return facts.withColumn("badges", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules])))


def challenge_progress(rows: DataFrame, challenges: DataFrame) -> DataFrame:
    """Progress min(target, sum) of each challenge and period, by cadence: a Monday's daily and weekly keys, equal as
    texts, stay apart."""
    daily = rows.select("user_id", F.lit("daily").alias("cadence"), F.to_date("ts").alias("period"), "metric", "amount")
    weekly = rows.select("user_id", F.lit("weekly").alias("cadence"), F.date_trunc("week", "ts").cast("date").alias("period"), "metric", "amount")
    sums = daily.union(weekly).groupBy("user_id", "cadence", "period", "metric").agg(F.sum("amount").alias("sum"))
    found = sums.join(challenges, ["cadence", "metric"])
    return found.select("user_id", "cadence", "period", "metric", F.least(F.col("target"), F.col("sum")).alias("progress"), (F.col("sum") >= F.col("target")).alias("complete"))


def _wrap(x: Column) -> Column:
    """The low 32 bits, as a signed number."""
    low = F.pmod(x, F.lit(1 << 32))
    return F.when(low >= (1 << 31), low - (1 << 32)).otherwise(low)


def _unsigned(x: Column) -> Column:
    return F.pmod(x, F.lit(1 << 32))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, in halves, so that nothing overflows."""
    a, b = _unsigned(a), _unsigned(b)
    high = F.shiftright(a, 16) * b
    return _wrap(F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b)


def text_hash(text: Column) -> Column:
    """31 h + code, in 32 bits with wrap-around (ASCII)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: _wrap(h * 31 + c))


def rotation(periods: DataFrame, size: int, take: int) -> DataFrame:
    """period, place, item: `take` of `size` items, by a Fisher-Yates shuffle from a generator seeded by the period's text.

    The generator is mulberry32. State and array are carried through array functions, one period to a row.
    """
    first = text_hash(F.col("period").cast("string"))
    seed = F.when(_unsigned(first) == 0, F.lit(1).cast("long")).otherwise(first)
    state = F.struct(_wrap(seed).alias("a"), F.sequence(F.lit(0), F.lit(size - 1)).alias("items"), F.lit(0.0).alias("u"))

    def step(s: Column, i: Column) -> Column:
        a = _wrap(s["a"] + 0x6D2B79F5)
        ua = _unsigned(a)
        t = _times(ua.bitwiseXOR(F.shiftright(ua, 15)), ua.bitwiseOR(F.lit(1)))
        ut = _unsigned(t)
        t = _wrap(t + _times(ut.bitwiseXOR(F.shiftright(ut, 7)), ut.bitwiseOR(F.lit(61))))
        ut = ut.bitwiseXOR(_unsigned(t))
        u = _unsigned(ut.bitwiseXOR(F.shiftright(ut, 14))) / F.lit(4294967296.0)
        j = F.floor(u * (i + 1)).cast("int")
        at = lambda k: F.element_at(s["items"], k + 1)
        swapped = F.transform(s["items"], lambda x, k: F.when(k == i, at(j)).when(k == j, at(i)).otherwise(x))
        return F.struct(a.alias("a"), swapped.alias("items"), u.alias("u"))

    items = F.aggregate(F.sequence(F.lit(size - 1), F.lit(1), F.lit(-1)), state, step, lambda s: F.slice(s["items"], 1, take))
    return periods.select("period", F.posexplode(items).alias("place", "item"))


def period_keys(rows: DataFrame) -> DataFrame:
    """rows (ts), each twice: with cadence daily and the day as key, and with cadence weekly and the Monday of the week.

    On a Monday both keys are the same date, so progress belongs to (cadence, key), never to the key alone. A null ts
    has null keys.
    """
    day = F.date_format("ts", "yyyy-MM-dd")
    monday = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    periods = F.array(F.struct(F.lit("daily").alias("cadence"), day.alias("key")), F.struct(F.lit("weekly").alias("cadence"), monday.alias("key")))
    return rows.withColumn("__period", F.explode(periods)).withColumns({"cadence": F.col("__period.cadence"), "key": F.col("__period.key")}).drop("__period")
