"""Looking for repeated passages leaves little on disk: shuffle files go with their step, and repeats within a text aren't sent word by word."""

import random

from lyceum.llm import passages
from lyceum.llm.shared import cut
from pyspark.sql import functions as F


def shuffled(spark):
    return sum(1 for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()) if b.isShuffle())


def test_a_tidy_step_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    rows = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(tuple(r) for r in cut(rows, "tidy", tidy=True).collect()) == [(k, 143 - (k == 6)) for k in range(7)]
    assert shuffled(spark) <= before


def test_repeats_within_a_text_come_united(spark):
    """Two documents repeat a passage of 90 words forty times; each sends the places that differ, and the others as spans."""
    rng = random.Random(4)
    passage = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(90)]
    pads = [[f"{x}{k}" for k in range(60)] for x in "xy"]
    texts = {d + 1: " ".join([*pads[d], *passage * 40, "end"]) for d in (0, 1)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    entries = passages._read(docs, 2, 3).filter("kind in (0, 3)").select("doc_id", "start", "a", "b", F.lit(True).alias("left"), F.lit(True).alias("right"))
    rows = passages._surroundings(docs, entries).collect()
    assert len(rows) < entries.count() and all(not r["words"] for r in rows if r["end"] is not None)
    for r in rows:
        ws, at = texts[r["doc_id"]].split(" "), len(" ".join(texts[r["doc_id"]].split(" ")[: r["word"]]))
        assert r["at"] == at + 1 and (r["end"] is None or r["to"] == len(" ".join(ws[: r["end"]])))
    found = {(r["doc_id"], r["kept"], r["start"], r["stop"], r["first_doc_id"]) for r in passages.repeats(docs).collect()}
    start, again = len(" ".join(pads[0])) + 1, len(" ".join(pads[0] + passage)) + 1
    assert found == {(1, True, start, 1447, 1), (1, False, again, len(texts[1]) - 4, 1), (2, False, start, len(texts[2]), 1)}
