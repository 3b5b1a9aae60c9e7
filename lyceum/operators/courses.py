"""Courses, enrolments, progress and rosters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions.study import half_even


def percent(done: Column, total: Column, digits: int = 0) -> Column:
    """Share in percent, halves to even; 0 for nothing."""
    return F.when(total > 0, half_even(done / total * 100, digits)).otherwise(F.lit(0.0))


def catalogue(courses: DataFrame, doctor_id: int | None = None, published: Column | None = None) -> DataFrame:
    """Courses that meet the filters given; a filter left out doesn't narrow."""
    found = courses if doctor_id is None else courses.filter(F.col("doctor_id") == doctor_id)
    return found if published is None else found.filter(published)


def initials(name: Column) -> Column:
    """First letters of the first two words, in capitals."""
    return F.upper(F.array_join(F.transform(F.slice(F.split(F.trim(name), r"\s+"), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def outline(lessons: DataFrame, progress: DataFrame, student_id: int) -> DataFrame:
    """Every lesson of every course, with whether the student has completed it."""
    done = progress.filter((F.col("student_id") == student_id) & F.col("completed")).select("course", "lesson", F.lit(True).alias("done"))
    return lessons.join(done, ["course", "lesson"], "left").withColumn("completed", F.coalesce("done", F.lit(False))).drop("done")


def course_totals(lessons: DataFrame) -> DataFrame:
    return lessons.groupBy("course").agg(F.count("*").alias("total"))


def roster(students: DataFrame, enrollments: DataFrame, lessons: DataFrame, progress: DataFrame) -> DataFrame:
    """student_id, full_name, course, done, total, pct: one aggregate for progress, left-joined to the enrolments."""
    done = progress.groupBy("student_id", "course").agg(F.count_if("completed").alias("done"))
    rows = enrollments.join(students, "student_id").join(done, ["student_id", "course"], "left").join(course_totals(lessons), "course", "left")
    rows = rows.withColumn("done", F.coalesce("done", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0)))
    return rows.select("student_id", "full_name", "course", "done", "total", percent(F.col("done"), F.col("total")).alias("pct"))


def completion_rate(enrollments: DataFrame, lessons: DataFrame, progress: DataFrame) -> DataFrame:
    """course, enrolled, finishers, rate: students who have every lesson done, against those enrolled, in percent to one digit.

    Finishers need not be enrolled, so a rate may exceed 100; it is null where there is nobody or nothing to finish.
    """
    enrolled = enrollments.groupBy("course").agg(F.count_distinct("student_id").alias("enrolled"))
    done = progress.filter("completed").groupBy("course", "student_id").agg(F.count("*").alias("n"))
    finished = done.join(course_totals(lessons), "course").filter("n = total").groupBy("course").agg(F.count("*").alias("finishers"))
    rows = course_totals(lessons).join(enrolled, "course", "left").join(finished, "course", "left")
    rows = rows.select("course", "total", F.coalesce("enrolled", F.lit(0)).alias("enrolled"), F.coalesce("finishers", F.lit(0)).alias("finishers"))
    rate = F.when((F.col("enrolled") > 0) & (F.col("total") > 0), half_even(F.col("finishers") / F.col("enrolled") * 100, 1))
    return rows.select("course", "enrolled", "finishers", rate.alias("rate"))


def course_state(enrollments: DataFrame, lessons: DataFrame, progress: DataFrame) -> DataFrame:
    """student_id, course, completed lessons in order, pct, and completed_at: the last completion if all are done, else null."""
    done = progress.filter("completed").groupBy("student_id", "course").agg(F.array_sort(F.collect_set("lesson")).alias("lessons"), F.max("completed_at").alias("last"))
    rows = enrollments.join(done, ["student_id", "course"], "left").join(course_totals(lessons), "course")
    n = F.coalesce(F.size("lessons"), F.lit(0))
    pct = percent(n, F.col("total"))
    return rows.select("student_id", "course", F.coalesce(F.array_join("lessons", ","), F.lit("")).alias("lessons"), pct.alias("pct"), F.when(pct >= 100, F.col("last")).alias("completed_at"))


def next_lesson(lessons: DataFrame, progress: DataFrame, enrollments: DataFrame) -> DataFrame:
    """The first lesson that isn't completed, by module and lesson; students who have all have no row."""
    open_ = enrollments.select("student_id", "course").join(lessons, "course")
    done = progress.filter("completed").select("student_id", "course", "lesson")
    left = open_.join(done, ["student_id", "course", "lesson"], "left_anti")
    return left.groupBy("student_id", "course").agg(F.min(F.struct("module", "lesson")).alias("m")).select("student_id", "course", "m.module", "m.lesson")


def study_plan(lessons: DataFrame, progress: DataFrame, enrollments: DataFrame, days: int = 5) -> DataFrame:
    """Open lessons in order, dealt to at most `days` days in chunks of equal size; focus is the module of a day's first lesson."""
    open_ = enrollments.select("student_id", "course").join(lessons, "course")
    left = open_.join(progress.filter("completed").select("student_id", "course", "lesson"), ["student_id", "course", "lesson"], "left_anti")
    one = Window.partitionBy("student_id", "course")
    left = left.withColumn("n", F.count("*").over(one)).withColumn("k", F.row_number().over(one.orderBy("module", "lesson")))
    chunk = F.greatest(F.lit(1), F.ceil(F.col("n") / days))
    left = left.withColumn("day", (F.floor((F.col("k") - 1) / chunk) + 1).cast("int")).filter(F.col("day") <= days)
    return left.groupBy("student_id", "course", "day").agg(F.count("*").alias("lessons"), F.min_by("module", "k").alias("focus"))


def enrollment_log(ops: DataFrame) -> DataFrame:
    """Replays enrol, unenrol and toggle-saved operations (course, student_id, op, seq).

    Per course: members (rows that exist at the end, saved-only ones included), saved, and students_count, the
    counter that rises on a new enrolment only and falls on each unenrolment while above 0, whether a row went
    or not. That counter is a running sum held at 0 from below: the sum less its lowest value so far.
    """
    by_pair, by_course = Window.partitionBy("course", "student_id").orderBy("seq"), Window.partitionBy("course").orderBy("seq")
    before = F.lag("op").over(by_pair)
    exists = before.isNotNull() & (before != "unenroll")
    delta = F.when((F.col("op") == "enroll") & ~exists, 1).when(F.col("op") == "unenroll", -1).otherwise(0)
    rows = ops.withColumn("delta", delta).withColumn("sum", F.sum("delta").over(by_course))
    counter = rows.groupBy("course").agg(F.max_by("sum", "seq").alias("end"), F.least(F.lit(0), F.min("sum")).alias("low"))
    left = F.sum(F.when(F.col("op") == "unenroll", 1).otherwise(0)).over(by_pair)
    lives = ops.withColumn("life", left)
    last = lives.groupBy("course", "student_id", "life").agg(F.count_if(F.col("op") == "toggle").alias("toggles"), F.max_by("op", "seq").alias("last_op"))
    last = last.groupBy("course", "student_id").agg(F.max_by(F.struct("toggles", "last_op"), "life").alias("m"))
    members = last.groupBy("course").agg(
        F.count_if(F.col("m.last_op") != "unenroll").alias("members"), F.count_if((F.col("m.last_op") != "unenroll") & (F.col("m.toggles") % 2 == 1)).alias("saved")
    )
    return members.join(counter, "course").select("course", "members", "saved", (F.col("end") - F.col("low")).alias("students_count"))


def append_with_ordinal(existing: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """New children get the number of those there as order_index, so an index left by a deletion may come again."""
    counts = existing.groupBy(parent).agg(F.count("*").alias("__n"))
    at = F.coalesce("__n", F.lit(0)) + F.row_number().over(Window.partitionBy(parent).orderBy("lesson")) - 1
    added = new.join(counts, parent, "left").withColumn("order_index", at.cast("long")).drop("__n")
    return existing.unionByName(added)


def reorder(children: DataFrame, order: list[int]) -> DataFrame:
    """order_index becomes the place in the list; ids that the list lacks keep theirs, unknown ids count for nothing."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("lesson")) - 1
    return children.withColumn("order_index", F.when(place >= 0, place).otherwise(F.col("order_index")))


def cascade(children: DataFrame, deleted_parents: DataFrame, on: list[str]) -> DataFrame:
    return children.join(deleted_parents, on, "left_anti")


def patched(rows: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Partial update: patches hold `present`, the names of the fields that they set; a present null sets null."""
    new = patches.select(F.col(key).alias("__key"), "present", *[F.col(f).alias(f"__{f}") for f in fields])
    found = rows.join(new, F.col(key) == F.col("__key"), "left")
    changed = {f: F.when(F.coalesce(F.array_contains("present", f), F.lit(False)), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}
    return found.withColumns(changed).select(*rows.columns)


def shelves(rows: DataFrame) -> DataFrame:
    """Which of the shelves each (student, course) stands on: in-progress, completed, saved, not-started."""
    return rows.select(
        "student_id", "course",
        F.explode(F.array_compact(F.array(
            F.when(F.col("pct") >= 100, F.lit("completed")),
            F.when((F.col("pct") > 0) & (F.col("pct") < 100), F.lit("in-progress")),
            F.when(F.col("pct") == 0, F.lit("not-started")),
            F.when(F.col("saved"), F.lit("saved")),
        ))).alias("shelf"),
    )


def redeem(requests: DataFrame) -> DataFrame:
    """user_id, seq, kind (earn, redeem), amount: each redemption succeeds if the balance then covers it.

    A success lowers the balance for those that follow, so a user's rows are read in order; users are dealt
    out by Spark, and a user's rows come as sorted batches of which only the balance is carried on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, balance = None, 0.0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.user_id != user:
                    user, balance = row.user_id, 0.0
                good = row.kind == "earn" or balance >= row.amount
                if good:
                    balance += row.amount if row.kind == "earn" else -row.amount
                out.append((row.user_id, row.seq, row.kind, row.amount, good, balance))
            yield pd.DataFrame(out, columns=["user_id", "seq", "kind", "amount", "accepted", "balance"])

    ordered = requests.select("user_id", "seq", "kind", "amount").repartition("user_id").sortWithinPartitions("user_id", "seq")
    return ordered.mapInPandas(run, "user_id long, seq long, kind string, amount double, accepted boolean, balance double")
