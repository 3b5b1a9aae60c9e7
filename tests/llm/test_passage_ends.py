"""Repeated passages inside longer paragraphs are reported from their first word to their last."""

import random

from lyceum.llm import passages


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]


def span(before, passage):
    """The code points of a passage after other words."""
    start = len(" ".join(before)) + 1 if before else 0
    return start, start + len(" ".join(passage))


def test_start_and_stop_are_the_planted_ends(spark):
    rng = random.Random(8)
    rows, planted, clean = [], {}, {}
    for k, n in enumerate((51, 60, 77, 100, 200, 51, 64, 90)):
        passage = words(rng, n)
        for doc in (2 * k, 2 * k + 1):
            before, after = words(rng, rng.randrange(30, 90)), words(rng, rng.randrange(30, 90))
            rows.append((doc, " ".join(before + passage + after)))
            planted[doc] = [(*span(before, passage), 2 * k, doc == 2 * k)]
            clean[doc] = rows[-1][1] if doc == 2 * k else " ".join(before) + "  " + " ".join(after)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in passages.repeats(df).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["stop"], r["first_doc_id"], r["kept"]))
    assert found == planted
    assert {r["doc_id"]: r["text"] for r in passages.without_repeats(df).collect()} == clean


def test_longer_passages_of_later_documents_and_repeats_within(spark):
    """Documents 2 and 3 share more than what they have of 1; 4 repeats itself."""
    rng = random.Random(9)
    passage, own = words(rng, 120), words(rng, 70)
    pads = [words(rng, 40) for _ in range(9)]
    docs = {1: pads[0] + passage[30:90] + pads[1], 2: pads[2] + passage + pads[3], 3: pads[4] + passage + pads[5], 4: pads[6] + own + pads[7] + own + pads[8]}
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id long, text string")
    gone, kept = {}, {}
    for r in passages.repeats(df).collect():
        (kept if r["kept"] else gone).setdefault(r["doc_id"], []).append((r["start"], r["stop"], r["first_doc_id"]))
    assert gone[3] == [(*span(pads[4], passage), 1)]
    assert gone[2] == [(*span(pads[2] + passage[:30], passage[30:90]), 1)]
    assert gone[4] == [(*span(pads[6] + own + pads[7], own), 4)]
    assert kept[1] == [(*span(pads[0], passage[30:90]), 1)] and set(gone) == {2, 3, 4}
    ends = [p for s, e, _ in kept[2] for p in (s, e)]
    assert (min(ends), max(ends)) == span(pads[2], passage)


def test_edited_passages_in_short_lines(spark):
    """Hard-wrapped copies with a changed word in 29 share too little for windows; their lines are joined to paragraphs."""
    rng = random.Random(10)
    passage = words(rng, 130)
    edited = [w if k % 29 else "new" for k, w in enumerate(passage)]
    wrap = lambda ws, n: "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))
    first = f"{' '.join(words(rng, 60))}\n{wrap(passage, 11)}\n\n{' '.join(words(rng, 60))}"
    second = f"{wrap(words(rng, 40), 8)}\n\n{wrap(edited, 13)}\n\n{wrap(words(rng, 30), 9)}"
    df = spark.createDataFrame([(1, first), (2, second), (3, wrap(words(rng, 90), 10)), (4, "a b\n\nc d\n")], "doc_id long, text string")
    found = {(r["doc_id"], r["start"], r["stop"], r["first_doc_id"], r["kept"]) for r in passages.repeats(df, similarity=0.6).collect()}
    at, to = first.index(passage[0]), first.index(passage[-1]) + len(passage[-1])
    other, end = second.index(wrap(edited, 13)), second.index(wrap(edited, 13)) + len(wrap(edited, 13))
    assert found == {(1, at, to, 1, True), (2, other, end, 1, False)}


def test_runs_too_short_for_sure_windows_are_left_out(spark):
    """Whether 24 to 49 words inside longer paragraphs hold an entry is up to their hashes, so none is reported."""
    rng = random.Random(11)
    rows = []
    for k, n in enumerate((24, 30, 36, 42, 48, 49)):
        passage = words(rng, n)
        rows += [(2 * k + d, " ".join(words(rng, 70) + passage + words(rng, 70))) for d in (0, 1)]
    assert passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
