"""Proposals against pages written for them, and the merge of two sources."""

from lyceum.operators import concepts as ops
from lyceum.operators import provider
from pyspark.sql import functions as F

PAGES = [
    (1, 1, "Osmosis is the movement of pure water through a thin membrane in living cells."),
    (1, 2, "Diffusion is the spreading of particles from crowded regions into empty regions nearby."),
    (1, 3, "Osmosis is the movement of pure water through a thin membrane in living cells."),
    (2, 1, None),
]
PROPOSED = [
    # doc_id, place, name, type, quotes, pages: what is found
    ((1, 1, " Osmosis: ", "Core Concept", ["Osmosis is the movement of pure  water through a thin membrane in living cells."], ["3"]), (None, "Osmosis", "definition", [3])),
    ((1, 2, "osmosis", "law", ["Osmosis is the movement of pure water through a thin membrane in living cells."], ["9", "x", None]), (None, "osmosis", "principle", [1])),
    ((1, 3, "Diffusion", None, ["Diffusion heals all the broken bones of people who believe in strange magic."], ["2"]), (None, "Diffusion", "fact", [2])),
    ((1, 4, "Photosynthesis", None, None, None), ("no evidence on any page", "Photosynthesis", None, None)),
    ((1, 5, "ab", None, None, None), ("length of name", "ab", None, None)), ((1, 6, None, None, None, None), ("length of name", "", None, None)),
    ((1, 7, "Chapter Summary", None, None, None), ("generic label or furniture", "Chapter Summary", None, None)), ((1, 8, "All rights reserved", None, None, None), ("generic label or furniture", "All rights reserved", None, None)),
    ((1, 9, "Membrane", None, ["Osmosis is the movement of pure water through a thin membrane in living cells."] * 2, ["2", "1"]), (None, "Membrane", "fact", [1])),
    ((2, 1, "Osmosis", None, ["Osmosis is the movement of pure water through a thin membrane in living cells."], ["1"]), ("no evidence on any page", "Osmosis", None, None)),
]


def tables(spark):
    pages = spark.createDataFrame(PAGES, "doc_id long, page int, text string")
    rows = pages.filter("text is not null").select("doc_id", "page", (F.col("page") * 1_000_000).cast("long").alias("ord"), (F.col("page") - 1).alias("number"), F.col("text").alias("sentence"))
    said = spark.createDataFrame([p for p, _ in PROPOSED], "doc_id long, place long, name string, type string, quotes array<string>, pages array<string>")
    return said, pages, rows


def test_verified(spark):
    said, pages, rows = tables(spark)
    found = {(r["doc_id"], r["place"]): r for r in provider.verified(said, pages, ops.taught(rows)).collect()}
    assert len(found) == len(PROPOSED)
    for p, want in PROPOSED:
        r = found[p[:2]]
        assert (r["fault"], r["concept"], r["type"], r["pages"]) == want, p
    assert len(found[1, 9]["evidence"]) == 1
    many = said.limit(1).withColumn("place", F.explode(F.expr("sequence(1L, 65L)")))
    assert provider.verified(many, pages, ops.taught(rows)).filter("fault = 'over the limit of a document'").count() == 5
    assert provider.verified(said.limit(0), pages, ops.taught(rows)).count() == 0


def test_merge(spark):
    said, pages, rows = tables(spark)
    proposed = provider.verified(said, pages, ops.taught(rows))
    own = spark.createDataFrame([(1, "osmosis", "Osmosis", "fact"), (1, "new thing", "New Thing", "process"), (1, "diffusion!", "diffusion", "fact"), (2, "osmosis", "Osmosis", "fact")], "doc_id long, key string, concept string, type string")
    found = {tuple(r) for r in provider.merged(proposed, own).collect()}
    assert found == {
        (1, "osmosis", "Osmosis", "definition", "provider"), (1, "diffusion", "Diffusion", "fact", "provider"), (1, "membrane", "Membrane", "fact", "provider"),
        (1, "new thing", "New Thing", "process", "document"), (2, "osmosis", "Osmosis", "fact", "document"),
    }
    edges = spark.createDataFrame([(1, "Osmosis", "New thing", 1), (1, "Osmosis", "Gone", 2), (2, "osmosis", "membrane", 3)], "doc_id long, source string, target string, __x int")
    assert [r["__x"] for r in provider.edges_kept(edges, provider.merged(proposed, own)).collect()] == [1]


def test_equivalent_quotes(spark):
    pairs = [("pure water moves through membranes", "Pure water moves, through membranes!", True), ("pure water moves through thin membranes", "water moves thin membranes", False), ("salty water moves through cell membranes daily", "water moves through cell membranes", True), ("water", "pure water", False), ("", "", False), (None, "x", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert [r["got"] for r in rows.select(provider.quotes_equivalent(F.col("a"), F.col("b")).alias("got")).collect()] == [p[2] for p in pairs]
