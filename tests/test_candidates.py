"""Candidates and audits on rows written for them; the queries are held against SQL in test_parity."""

import pytest
from lyceum.operators import candidates as ops
from pyspark.sql import functions as F

RAW = "kind string, prompt string, answer string, explanation string, options array<string>, pages array<string>, n_pages int, read_pages array<int>, difficulty string, fault string"
GOOD = ("mcq", "What does Osmosis move across a membrane?", "pure water", "Water moves to the saltier side.", ["heat", "light", "pure water", "salt ions"], ["2", " 3 "], 9, None, "Hard", "own")


def raw(**changes):
    return tuple(changes.get(n.split()[0], v) for n, v in zip(RAW.split(", "), GOOD))


CASES = [
    (raw(), None), (raw(kind=None), "kind"), (raw(kind="essay"), "kind"), (raw(kind=" Multiple_Choice "), None), (raw(prompt=None), "shape"), (raw(answer="  "), "shape"), (raw(explanation="too few"), "shape"), (raw(prompt="x " * 400), "shape"),
    (raw(prompt="How many pages are there?"), "trivial"), (raw(prompt="What is moved, according to the text?"), "trivial"), (raw(explanation="Copyright by the author of this."), "furniture"),
    (raw(kind="fill-blank", options=None), "blank"), (raw(kind="fill-blank", prompt="Osmosis moves ____ across membranes.", options=None), None), (raw(pages=None), "pages"), (raw(pages=["x", "10"]), "pages"), (raw(read_pages=[2]), None), (raw(read_pages=[3]), "pages"),
    (raw(kind="true_false", answer="perhaps"), "truth"), (raw(kind="true_false", answer="Yes"), None), (raw(options=None), "options"), (raw(options=["a b", "c d", "e f"]), None), (raw(options=["a b", "A  B!", "pure water", None, "x y"]), "options"), (raw(options=["1 x", "2 x", "3 x", "4 x"]), "options"),
    (raw(options=["heat", "light", "pure water", "see www.example.org"]), "furniture in options"),
]


def test_normal_form(spark):
    rows = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(CASES)], "n int, " + RAW)
    found = ops.normalised(rows).orderBy("n").collect()
    for r, (given, fault) in zip(found, CASES):
        assert r["fault"] == fault, given
    assert found[0]["difficulty"] == "hard" and found[0]["pages"] == [2, 3] and found[0]["options"] == GOOD[4]
    yes = next(r for r, (g, f) in zip(found, CASES) if g[0] == "true_false" and f is None)
    assert (yes["answer"], yes["options"]) == ("True", ["True", "False"])
    three = next(r for r, (g, f) in zip(found, CASES) if g[4] == ["a b", "c d", "e f"])
    assert three["options"] == ["a b", "c d", "e f", "pure water"]
    assert ops.normalised(rows.limit(0)).count() == 0
    assert ops.normalised(rows, allowed=["true-false"]).filter("fault is null").count() == 1


EVIDENCE = "Osmosis moves 25 litres of pure water through a thin membrane into salty cells every day."
BACKED = [
    # kind, prompt, answer, skill, facet, knowledge, basis: answer, blank, statement, shape
    (("short-answer", "How does Osmosis move water?", "through a thin membrane", "comparison", "", "fact", ""), (True, False, False, False)),
    (("short-answer", "Why is it needed?", "membrane helps salty cells", "cause_effect", "", "fact", ""), (True, False, False, True)),
    (("short-answer", "What?", "26 litres of pure water", "analysis", "cause", "fact", ""), (False, False, False, True)),
    (("short-answer", "What?", "gold coins", "application", "", "fact", ""), (False, False, False, False)),
    (("fill-blank", "Osmosis moves pure water through a thin ____ into cells.", "membrane", "factual_recall", "", "process", ""), (True, True, False, True)),
    (("fill-blank", "Osmosis moves pure water through a thin ____ into cells.", "membrane", "factual_recall", "", "fact", ""), (True, False, False, True)),
    (("true-false", "Osmosis moves pure water through a thin membrane.", "True", "understanding", "", "fact", ""), (True, False, True, True)),
    (("true-false", "Osmosis moves pure water through a thin membrane.", "True", "factual_recall", "", "fact", ""), (True, False, False, True)),
    (("true-false", "Diffusion moves pure water through a thin membrane.", "False", "misconception", "", "fact", "Osmosis moves pure water through a membrane"), (True, False, True, True)),
    (("true-false", "Diffusion moves pure water through a thin membrane.", "False", "misconception", "", "fact", "short"), (True, False, False, True)),
    ((None, None, None, None, None, None, None), (False, False, False, True)),
]


def test_support(spark):
    rows = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(BACKED)], "n int, kind string, prompt string, answer string, skill string, facet string, knowledge string, basis string")
    rows = rows.withColumns({"evidence": F.lit(EVIDENCE), "concept": F.lit("Osmosis"), "target": F.lit(""), "vocabulary": F.lit(None).cast("array<string>")})
    for r, (given, want) in zip(ops.backed(rows).orderBy("n").collect(), BACKED):
        assert (r["answer_backed"], r["blank_sound"], r["statement_sound"], r["shape_sound"]) == want, given


def test_arabic_words_may_differ_in_a_letter(spark):
    rows = spark.createDataFrame([("short-answer", "x", "الميتوكوندريات", "تنتج الميتوكوندريا الطاقة"), ("short-answer", "x", "البرازيل", "تنتج الميتوكوندريا الطاقة")], "kind string, prompt string, answer string, evidence string")
    rows = rows.withColumns({n: F.lit("") for n in ("concept", "target", "skill", "facet", "knowledge", "basis")}).withColumn("vocabulary", F.array().cast("array<string>"))
    assert [r["answer_backed"] for r in ops.backed(rows).collect()] == [True, False]


@pytest.mark.parametrize("reason,kind", [("Answer IS NOT SUPPORTED by the evidence", "unsupported_by_pdf"), ("shares no content with it", "unsupported_by_pdf"), ("no usable blank", "validator_false_negative"), (None, "validator_false_negative")])
def test_grounding_classes(spark, reason, kind):
    assert spark.range(1).select(ops.grounding_class(F.lit(reason).cast("string")).alias("k")).first()["k"] == kind


def test_final_rejections(spark):
    good = ("mcq", "P ____?", "b", ["a", "b"], [1], [1, 2], True, True)
    at = {"kind": 0, "prompt": 1, "answer": 2, "options": 3, "pages": 4, "read": 5, "traced": 6, "known": 7}
    change = lambda **c: tuple(c.get(n, good[k]) for n, k in at.items())
    cases = [
        (good, None), (change(traced=None), "no provenance"), (change(known=False), "concept not in study map"), (change(kind="short-answer"), "type not requested"), (change(kind=None), "type not requested"), (change(pages=None), "no source page"), (change(pages=[3]), "page not extracted"), (change(answer=None), "empty answer"),
        (change(options=["b", " "]), "too few options"), (change(options=["b", "B!"]), "duplicate options"), (change(options=["a", "c"]), "answer not among options"), (change(kind="fill-blank", prompt="no blank"), "no usable blank"), (change(kind="fill-blank"), None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "n int, kind string, prompt string, answer string, options array<string>, pages array<int>, read_pages array<int>, traced boolean, known boolean")
    assert [r["reason"] for r in ops.finally_rejected(rows, ["mcq", "fill-blank"]).orderBy("n").collect()] == [w for _, w in cases]


def test_findings(spark):
    kind = "quiz_id long, id long, kind string, prompt string, answer string, explanation string, options array<string>, evidence string, concept string, skill string, target string, facet string"
    rows = [
        (1, 1, "mcq", "What does the the law of", "pure water", "It", ["pure water", "pure  Water", "a = b", "one two three four five six"], EVIDENCE, "law of osmosis", "understanding", "t1", ""),
        (1, 2, "true-false", EVIDENCE, "False", "The original relationship is correct.", ["True", "False"], EVIDENCE, "", "understanding", "t1", ""),
        (1, 3, "true-false", "Salt moves.", "false", "So it goes.", ["True", "False"], EVIDENCE, "", "understanding", "t2", ""),
        (1, 4, "short-answer", "Why is that?", "gold, silver, iron", "Because.", None, EVIDENCE, "", "factual_recall", "t3", ""),
        (2, 5, None, None, None, None, None, None, None, None, None, None),
    ]
    found = {tuple(r)[:2] + (r["message"],) for r in ops.findings(spark.createDataFrame(rows, kind)).collect()}
    want = {(1, 1, m) for m in ("article collision", "prompt ends mid-phrase", "prompt has no terminal punctuation", "explanation is not a complete sentence", "duplicate options", "length giveaway", "near-equal options")}
    want |= {(1, 2, "false answer explained as correct"), (1, 2, "prompt copies the source"), (1, 3, "falsehood not explained"), (1, 4, "reason answered by a bare list"), (1, 4, "answer largely absent from evidence"), (1, 4, "tier 3"), (2, 5, "tier 3")}
    want |= {(1, None, "uniform truth of statements"), (1, None, "duplicate knowledge target"), (1, None, "skill concentration")}
    assert found == want
    totals = {(r["severity"], r["message"]): (r["findings"], r["quizzes"]) for r in ops.totals(ops.findings(spark.createDataFrame(rows, kind))).collect()}
    assert totals[None, None] == (len(want), 2) and totals["DEFECT", "tier 3"] == (2, 2)
