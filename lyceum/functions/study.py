"""Scalar rules of the study hub: rounding, dates, levels, readiness, priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def round_half_up(x: Column) -> Column:
    """Halves towards plus infinity."""
    return F.floor(x + 0.5)


def half_even(x: Column, digits: int) -> Column:
    """Rounded to so many digits, halves of the scaled double to the even neighbour; bround decides by the decimal text instead."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def exact_sum(x: Column) -> Column:
    """The sum of an aggregation in decimals of ten digits, so that it doesn't hang on the order of the rows.

    Where a value is no such decimal (18 digits before the point, NaN, infinite), the plain sum.
    """
    exact = x.try_cast("decimal(28,10)")
    return F.when(F.count(exact) == F.count(x), F.sum(exact).cast("double")).otherwise(F.sum(x))


def exact_avg(x: Column) -> Column:
    return exact_sum(x) / F.count(x)


def fixed(x: Column, digits: int) -> Column:
    """A double as text with so many digits, by its exact value, ties to even, as C prints it; format_string goes by its decimal text, halves up."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def days_since(ts: Column, now: Column) -> Column:
    """Whole days past, rounded down; null for null."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / DAY)


def days_until(ts: Column, now: Column) -> Column:
    """Days to come, rounded up."""
    return F.ceil((F.unix_timestamp(ts) - F.unix_timestamp(now)) / DAY)


def week_start(ts: Column) -> Column:
    """The Monday of a timestamp's week, as a date."""
    return F.date_trunc("week", ts).cast("date")


def xp_for_level(level: Column) -> Column:
    """Points that a level begins with: with n = level - 1, 250 (n (n + 1) / 2 + n)."""
    n = level - 1
    return F.when(level <= 1, F.lit(0.0)).otherwise(250.0 * (n * (n + 1) / 2 + n))


def level_of(xp: Column) -> Column:
    """The highest level whose points are reached: the quadratic solved for n, then set right by one either way."""
    points = F.greatest(F.lit(0.0), F.floor(xp).cast("double"))
    guess = F.floor((F.sqrt(9 + 8 * points / 250) - 3) / 2).cast("long") + 1
    up = F.when(xp_for_level(guess + 1) <= points, guess + 1).otherwise(guess)
    return F.when(xp_for_level(up) > points, up - 1).otherwise(up)


def reading_percent(read: Column, pages: Column) -> Column:
    return F.when(pages > 0, round_half_up(read / pages * 100)).otherwise(F.lit(0).cast("long"))


def status(pct: Column, read: Column) -> Column:
    """`viewed` is reached only where pages are read but the percentage rounds to 0."""
    return F.when(pct >= 100, "completed").when(pct > 0, "in-progress").when(read > 0, "viewed").otherwise("not-started")


def readiness(pct: Column, average: Column, viewed: Column, now: Column) -> Column:
    """Reading 60 %, attempts 30 %, recency 10 %; without attempts reading 80 % and recency 20 %."""
    recency = F.when(viewed.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 5 * days_since(viewed, now)))
    return round_half_up(F.when(average.isNull(), pct * 0.8 + recency * 0.2).otherwise(pct * 0.6 + average * 0.3 + recency * 0.1))


def exam_readiness(pct: Column, average: Column) -> Column:
    return round_half_up(F.when(average.isNull(), pct * 0.6).otherwise(pct * 0.35 + average * 0.65))


def _exam_points(until: Column) -> Column:
    return F.when(until.isNull(), 0).when(until <= 1, 45).when(until <= 3, 35).when(until <= 7, 22).otherwise(8)


def priority_score(until: Column, pct: Column, stale: Column, difficulty: Column, average: Column, latest: Column) -> Column:
    """0 to 100. An exam that is over counts as imminent, as the rule has no lower bound."""
    reading = F.when((pct > 0) & (pct < 100), 18).when(pct == 0, 6).otherwise(0)
    review = F.when(stale >= 7, 20).when(stale >= 3, 10).otherwise(0)
    hard = F.when(difficulty == "hard", 12).when(difficulty == "medium", 5).otherwise(0)
    weak = F.when(average < 50, 20).when(average < 70, 10).otherwise(0)
    total = _exam_points(until) + reading + review + hard + weak
    return F.greatest(F.lit(0), F.least(F.lit(100), F.when((pct >= 100) & (latest >= 80), F.least(total, F.lit(15))).otherwise(total)))


def priority_reasons(until: Column, pct: Column, stale: Column, difficulty: Column, average: Column) -> Column:
    """The first three reasons that hold."""
    reasons = F.array_compact(F.array(
        F.when(until <= 1, F.lit("Exam is imminent")).when(until > 1, F.concat(F.lit("Exam in "), until.cast("string"), F.lit(" days"))),
        F.when((pct > 0) & (pct < 100), F.lit("Reading in progress")),
        F.when(stale >= 3, F.concat(F.lit("Not reviewed in "), stale.cast("string"), F.lit(" days"))),
        F.when(difficulty == "hard", F.lit("High difficulty content")),
        F.when(average < 50, F.lit("Low quiz performance")).when(average < 70, F.lit("Room to improve quiz scores")),
    ))
    return F.slice(reasons, 1, 3)


def priority_level(score: Column) -> Column:
    return F.when(score >= 55, "high").when(score >= 28, "medium").otherwise("low")


def recommendation(pct: Column, average: Column, stale: Column, difficulty: Column, flashcards: Column) -> Column:
    """The first rule that holds."""
    full = pct >= 100
    return (
        F.when(average < 55, "needs-revision")
        .when(full & (average.isNull() | (average >= 80)), "ready-for-exam")
        .when((pct > 0) & ~full & (stale >= 5), "review-today")
        .when((pct >= 40) & ~full, "ready-for-quiz")
        .when((pct > 0) & ~full, "continue-reading")
        .when((difficulty == "hard") & (pct == 0), "needs-explanation")
        .when((flashcards > 0) & (pct == 0), "needs-flashcards")
        .otherwise("start-reading")
    )


def next_tab(kind: Column) -> Column:
    return F.when(kind == "ready-for-exam", "exam").when(kind == "ready-for-quiz", "quiz").when(kind == "needs-flashcards", "flashcards").otherwise("viewer")


def study_minutes(estimate: Column, pct: Column, level: Column) -> Column:
    base = F.greatest(F.lit(5), round_half_up(estimate * F.greatest(F.lit(0.0), 1 - pct / 100)))
    return F.when(level == "high", F.greatest(base, F.lit(20))).when(level == "medium", F.greatest(base, F.lit(10))).otherwise(F.least(base, F.lit(15)))


def size_label(size: Column) -> Column:
    kb, mb = F.concat(fixed(size / 1024.0, 0), F.lit(" KB")), F.concat(fixed(size / (1024.0 * 1024), 1), F.lit(" MB"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, kb).otherwise(mb)


def ago_label(seconds: Column) -> Column:
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / DAY)
    weeks, months = F.floor(days / 7), F.floor(days / 30)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(seconds.isNull(), "Never").when(minutes < 1, "Just now").when(minutes < 60, text(minutes, "m"))
        .when(hours < 24, text(hours, "h")).when(days < 7, text(days, "d")).when(weeks < 5, text(weeks, "w")).otherwise(text(months, "mo"))
    )


def time_label(seconds: Column) -> Column:
    minutes = round_half_up(seconds / 60)
    hours, rest = F.floor(minutes / 60), minutes % 60
    long = F.concat(hours.cast("string"), F.lit("h"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit("m"))).otherwise(F.lit("")))
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(long)


def page_window(current: Column, pages: Column, radius: int) -> Column:
    """The pages around the current one, within the document."""
    return F.sequence(F.greatest(F.lit(1), current - radius), F.greatest(F.least(pages, current + radius), F.lit(1)))
