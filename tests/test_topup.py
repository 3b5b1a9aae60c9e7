"""Topping up short quizzes, and quizzes that must be as long as asked."""

import pytest
from lyceum.operators import exam
from pyspark.sql import functions as F

TYPES = ["mcq", "short"]


def made(spark, quizzes):
    """quizzes: for each, (targets, ids in the pool); a target's concept is its tens, its objective itself."""
    rows = [(q, i, f"c{i // 10}", f"o{i}", "understanding" if i % 2 else "analysis", "", 0.5 + i / 200, "t", [1], ["short"], i < 10, i in pool) for q, (targets, pool) in enumerate(quizzes) for i in targets]
    return spark.createDataFrame(rows, "quiz_id long, id long, concept string, objective string, skill string, facet string, importance double, topic string, pages array<int>, writable array<string>, important boolean, held boolean")


def topped(spark, quizzes, bad=lambda c: F.lit(False), count=8):
    targets = made(spark, quizzes)
    calls = []

    def write(slots):
        calls.append(1)
        return slots.join(targets.filter(~bad(F.col("id"))).select("quiz_id", "id", "concept", "objective"), ["quiz_id", "id"])

    return [tuple(r) for r in exam.topped_up(targets.filter("held"), targets, write, count, TYPES).orderBy("quiz_id", "round", "id").collect()], len(calls)


def test_short_quizzes_are_filled_and_full_ones_left_alone(spark):
    found, _ = topped(spark, [(range(40), {1, 2}), (range(20), set(range(8))), (range(30), set())])
    by = {q: [r for r in found if r[0] == q] for q in range(3)}
    assert [r[1] for r in by[1]] == list(range(8)) and all(r[4] == 0 for r in by[1])
    assert all(len(by[q]) >= 8 for q in (0, 2)) and {1, 2} <= {r[1] for r in by[0] if r[4] == 0}
    assert all(len({r[3] for r in rows}) == len(rows) for rows in by.values())


def test_an_important_concept_is_reached_although_the_pool_is_long_enough(spark):
    found, _ = topped(spark, [(range(30), set(range(10, 20)))])
    assert "c0" in {r[2] for r in found}


def test_what_failed_is_not_tried_again_and_rounds_are_bounded(spark):
    found, calls = topped(spark, [(range(100), {99})], bad=lambda i: i % 4 != 3)
    assert calls <= 3 and all(r[1] % 4 == 3 for r in found) and max(r[4] for r in found) <= 3
    nothing, calls = topped(spark, [(range(30), {29})], bad=lambda i: F.lit(True))
    assert [r[1] for r in nothing] == [29] and calls == 1
    assert topped(spark, [])[0] == []


def test_repeated_objectives_count_once(spark):
    targets = made(spark, [(range(20), {3})])
    twice = targets.union(targets.withColumn("id", F.col("id") + 100).withColumn("held", F.lit(False)))
    write = lambda s: s.join(twice.select("quiz_id", "id", "concept", "objective"), ["quiz_id", "id"])
    found = exam.topped_up(twice.filter("held"), twice, write, 12, TYPES).collect()
    assert len({r["objective"] for r in found}) == len(found)


ASKED = "quiz_id long, requested int, planned int, passed int, rejected int, pages_dropped int, image_pages int, provider_errors int"


@pytest.mark.parametrize("counts,available,reason", [((9, 4, 5, None, None, None), 3, "material"), ((9, 4, 5, 2, 1, 1), 3, "pages dropped"), ((9, 4, 5, 0, 1, 1), 3, "image pages"), ((9, 0, 9, 2, 1, 1), 0, "provider"), ((9, 4, 5, 0, 0, 1), 3, "material")])
def test_shortfalls_tell_what_is_to_blame(spark, counts, available, reason):
    asked = spark.createDataFrame([(1, 5, *counts), (2, 1, *counts)], ASKED)
    chosen = spark.createDataFrame([(1, i) for i in range(available)] + [(2, 7)], "quiz_id long, id long")
    assert [(r["quiz_id"], r["requested"], r["available"], r["reason"]) for r in exam.shortfalls(chosen, asked).collect()] == [(1, 5, available, reason)]
    with pytest.raises(exam.MaterialError) as told:
        exam.in_full(chosen, asked)
    assert (told.value.requested, told.value.available, told.value.reason, told.value.quizzes) == (5, available, reason, 1) and told.value.funnel["rejected"] == counts[2]


def test_complete_quizzes_pass(spark):
    chosen = spark.createDataFrame([(1, 7), (1, 8)], "quiz_id long, id long")
    assert exam.in_full(chosen, spark.createDataFrame([(1, 2, 4, 2, 2, 0, 0, 0)], ASKED)).count() == 2


def test_a_null_score_passes_no_gate(spark):
    row = spark.range(1).withColumns({n: F.lit(0.9) for n, _ in exam.GATES}).withColumn("grounding", F.lit(None).cast("double"))
    assert exam.gated(row).first()["reasons"] == "grounding 0.00<0.72"
