"""Headings behind numbers, page citations inside JSON, ranks over everybody, closest concepts, periods."""

import json
import random

from lyceum.operators import activity, documents, extracts
from pyspark.sql import functions as F


def test_headings(spark):
    cases = {
        "3.1 Introduction to Cell Structure The cell is defined as a unit.": ["3.1 Introduction to Cell Structure"],
        "2.4 What is a Process? A program runs. 2.5 Why Threads are Cheap": ["2.4 What is a Process", "2.5 Why Threads"],
        "1.2 Mitosis and Meiosis Mitosis is defined": ["1.2 Mitosis and Meiosis"],
        "1.2  Two Blanks  Here": ["1.2 Two Blanks"],
        "4.4 lower case": [], "no number Here": [], "9.9 ": [], "v10.3.1 Deep Number": ["3.1 Deep Number"],
        "5.1 The": ["5.1 The"], "6.1 One Two Three Four Five Six Seven Eight Nine Ten Eleven": ["6.1 One Two Three Four Five Six Seven Eight Nine Ten"],
        "7.1 Glued A3.2 Next One": ["7.1 Glued", "3.2 Next One"], "8.1 ... Dots": [], "": [],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "n int, text string")
    found = [r["h"] for r in rows.select("n", extracts.numbered_headings(F.col("text")).alias("h")).orderBy("n").collect()]
    assert found == [*cases.values(), []]


def test_citations_at_any_depth(spark):
    rng = random.Random(6)
    keys = ["source_page", "source_pages", "start_page", "end_page", "page", "x"]

    def made(depth):
        k = rng.random()
        if depth == 0 or k < 0.3:
            return rng.choice([0, 3, -2, 12, 2.5, "7", True, None])
        if k < 0.6:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(keys): made(depth - 1) for _ in range(rng.randint(0, 3))}

    def walk(x, key=None):
        if isinstance(x, dict):
            return [y for k, v in x.items() for y in walk(v, k)]
        if isinstance(x, list):
            return [y for v in x for y in walk(v, key)]
        return [(key, x)] if key in keys[:4] and isinstance(x, int) and not isinstance(x, bool) else []

    answers = [made(5) for _ in range(120)]
    rows = spark.createDataFrame([(i, json.dumps(a), 5) for i, a in enumerate(answers)] + [(900, None, 5), (901, "{not json", 5), (902, "", 5)], "id long, answer string, pages int")
    want = sorted((i, k, p) for i, a in enumerate(answers) for k, p in walk(a))
    assert sorted(tuple(r) for r in extracts.cited_pages(rows).collect()) == want
    assert sorted(tuple(r) for r in extracts.false_citations(rows).collect()) == [r for r in want if r[2] < 1 or r[2] > 5]
    assert extracts.cited_pages(rows.limit(0)).count() == 0


def test_ranks_over_everybody_by_ranges(spark):
    rows = spark.range(0, 5000, 1, 16).selectExpr("id AS user_id", "concat('n', id % 40) AS name", "id * 7 % 13 AS xp", "cast(id % 5 AS double) AS week")
    found = {r["user_id"]: r["rank"] for r in activity.ranked(rows, "week").collect()}
    order = sorted(rows.collect(), key=lambda r: (-r["week"], -r["xp"], r["name"], r["user_id"]))
    assert found == {r["user_id"]: i for i, r in enumerate(order, 1)}
    assert activity.ranked(rows.limit(0), "week").count() == 0
    plan = activity.ranked(rows, "week")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # dealt out already; the window in the plan has a row for each part


def test_closest_concepts(spark):
    asked = spark.createDataFrame([(1, 1, "What is Cell-theory?"), (1, 2, "cell cell"), (1, 3, "none of these"), (1, 4, None), (2, 5, "cell"), (1, 6, "")], "scope long, id long, text string")
    names = spark.createDataFrame([(1, 2, "Cell"), (1, 1, "Theory of gas"), (1, 3, "cell theory"), (1, 4, "cell cell"), (1, 5, None)], "scope long, ord long, concept string")
    found = {r["id"]: (r["concept"], r["score"]) for r in documents.closest_concepts(asked, names).collect()}
    assert found == {1: ("cell theory", 2), 2: ("cell cell", 2), 3: ("Theory of gas", 1), 4: (None, 0), 5: (None, 0), 6: (None, 0)}


def test_periods_of_a_monday_stay_apart(spark):
    rows = spark.createDataFrame([("2024-01-29 10:00:00",), ("2024-02-04 23:00:00",), (None,)], "ts string").select(F.col("ts").cast("timestamp").alias("ts"))
    found = sorted(((r["cadence"], r["key"]) for r in activity.period_keys(rows).collect()), key=str)
    assert found == sorted([("daily", "2024-01-29"), ("weekly", "2024-01-29"), ("daily", "2024-02-04"), ("weekly", "2024-01-29"), ("daily", None), ("weekly", None)], key=str)
