"""Extracts and readers on literal frames."""

from pyspark.sql import functions as F

from lyceum import catalog
from lyceum.operators import extracts
from lyceum.sources import readers

DATA = "/root/testdata/sf0.001"


def test_sentences_over_pages(spark):
    lines = [(1, 1, 0, "3.2 Cells", True), (1, 1, 1, "Cells are small. Each one is", False), (1, 2, 0, "alive and", False), (1, 3, 0, "well. New thought", False), (1, 3, 1, "ENZYMES", True), (1, 3, 2, "They speed things up", False)]
    df = spark.createDataFrame(lines, "doc_id long, page int, line_no int, line string, heading boolean")
    found = [(r["page"], r["section"], r["sentence"]) for r in extracts.sentences_over_pages(df).orderBy("ord").collect()]
    assert found == [(1, "3.2 Cells", "Cells are small."), (1, "", "Each one is alive and well."), (3, "", "New thought"), (3, "", "They speed things up")]


def test_definitions_and_formulas(spark):
    pages = spark.createDataFrame([(1, 1, "The Cell is defined as the unit of life. Osmosis refers to water flow here. We say F = m * a; y is equal"), (1, 2, "Cell is defined as something else entirely. E = mc^2, yes")], "doc_id long, page int, text string")
    found = [(r["term"], r["definition"], r["page"]) for r in extracts.definitions(pages).orderBy("place").collect()]
    assert found == [("Cell", "the unit of life.", 1), ("Osmosis", "water flow here.", 1)]
    assert [r["formula"] for r in extracts.formulas(pages).orderBy("place").collect()] == ["F = m * a", "E = mc^2"]


def test_relations_and_evidence(spark):
    concepts = spark.createDataFrame([(1, "Heat", 0.9, ["heat"]), (1, "Steam", 0.5, ["steam"]), (1, "Cold ice", 0.4, ["cold", "ice"])], "doc_id long, concept string, importance double, tokens array<string>")
    sentences = spark.createDataFrame([(1, 0, "Heat causes steam."), (1, 1, "Steam, unlike cold ice, is hot; heat helps."), (1, 2, "Heat is defined as energy in motion.")], "doc_id long, ord int, sentence string")
    found = sorted((r["source"], r["target"], r["kind"], r["ord"]) for r in extracts.relations(concepts, sentences).collect())
    assert found == [("Heat", "Steam", "cause", 0), ("Heat", "Steam", "contrast", 1), ("Steam", "Cold ice", "contrast", 1)]
    best = {r["concept"]: r["ord"] for r in extracts.evidence(concepts, sentences).filter("place = 1").collect()}
    assert best == {"Heat": 2, "Steam": 1, "Cold ice": 1}


def test_trimming(spark):
    texts = ["short", "One sentence here. Another that is long", "no end at all in this line of text", "A question? And more words to come"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    found = [r["x"] for r in df.select(readers.trimmed_at_boundary(F.col("text"), 24).alias("x")).collect()]
    assert found == ["short", "One sentence here.", "no end at all in this li", "A question? And more wor"]


def test_json_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a"], None), (2, None, 3.5)], "id long, tags array<string>, x double")
    rows.write.json(str(tmp_path / "out"))
    back = spark.read.schema(rows.schema).json(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_they_run(spark):
    for name in ("f13_evidence", "g2_sentences", "i17_relations", "i21_definitions", "i22_formulas", "i24_difficulty", "i25_flashcards"):
        assert catalog.queries()[name](spark, DATA).count() > 0, name
