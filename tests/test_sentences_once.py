"""What is said of a sentence is worked out once for it, and names meet sentences once for all that asks."""

from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.functions import words
from lyceum.operators import concepts as ops
from lyceum.operators import extracts, study_map

SAID = [
    ("d", 1, 1, "An important ionic bond is defined as a strong attraction between charged atoms."),
    ("d", 1, 2, "The covalent bond differs from the ionic bond because electrons are shared."),
    ("d", 1, 3, "A covalent bond produces stable molecules from atoms."),
    ("e", 1, 1, "Atoms form nothing here."),
]
NAMES = [("d", "ionic bond", "ionic bond", 0.9), ("d", "covalent bond", "covalent bond", 0.8), ("d", "atoms", "atoms", 0.7), ("e", "atoms", "atoms", 0.7)]


def _tables(spark):
    taught = spark.createDataFrame(SAID, "doc_id string, page int, ord long, sentence string")
    return spark.createDataFrame(NAMES, "doc_id string, key string, concept string, importance double"), taught


def test_sentences_are_weighed_before_their_tokens_are_told_apart(spark):
    """Behind the generator the patterns of weight ran once for each token of a sentence (F1, F3, F4)."""
    names, taught = _tables(spark)
    lines = study_map.related(names, taught)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    weighed = [k for k, line in enumerate(lines) if "most frequently tested" in line]
    told_apart = next(k for k, line in enumerate(lines) if "Generate explode(array_intersect" in line)
    assert weighed and min(weighed) > told_apart


def test_relations_of_complete_pairs(spark):
    """Sentences with all tokens of two names give the relations that joining both again gives (F3)."""
    names, taught = _tables(spark)
    present = study_map.spoken(names, taught).filter("complete").join(names, ["doc_id", "key"])
    found = extracts.next_to_each_other(present, taught.select("doc_id", "ord", extracts.relation_kind(F.col("sentence")).alias("kind")))
    plain = extracts.relations(names.withColumn("tokens", fn.content_tokens(F.col("concept"))), taught)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "source", "target", "kind", "ord").collect()))
    assert rows(found) == rows(plain) and len(rows(found)) == 3


def test_references_in_one_sentence_or_several(spark):
    """A name is needed where its words stand in the evidence of another, in one sentence or over several (F4)."""
    _, taught = _tables(spark)
    proofs = [("d", "ionic bond", "ionic bond", [1, 2]), ("d", "covalent bond", "covalent bond", [2]), ("d", "atoms", "atoms", [3]), ("d", "shared attraction", "shared attraction", [3, 3])]
    names = spark.createDataFrame([(d, k, c, [(o,) for o in ords]) for d, k, c, ords in proofs], "doc_id string, key string, concept string, evidence array<struct<ord:long>>")
    found = {r["key"]: r["n"] for r in study_map.references(names, taught, study_map.spoken(names, taught)).collect()}
    # ionic bond stands in 2, atoms in 1, the words of the last name only in 1 and 2 together; covalent bond in 2 and 3.
    assert found == {"ionic bond": 1, "atoms": 2, "shared attraction": 1, "covalent bond": 3}


def test_ascii_texts_are_asked_for_what_they_can_match(spark):
    """Alternatives in Arabic are left out for texts of ASCII, with the same answer (F7)."""
    patterns = ["(?i)" + p for _, p in words.KNOWLEDGE] + [words.EMPHASIS, words.OBJECTIVE, "(?iU)" + words.KNOWLEDGE[0][1]]
    texts = ["It is called x.", "NOTE THAT y", "مهم جدا", "يعرف بأنه", "a = b", "Learning objectives", "café means that", "", None, "nothing", "Key"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    for p in patterns:
        assert fn.latin(p).isascii()
        assert [r["t"] for r in rows.select("t", fn.found(F.col("t"), p).alias("a"), F.col("t").rlike(p).alias("b")).collect() if r["a"] != r["b"]] == []


def test_stems_of_names_are_worked_out_once(spark):
    """Names are cut into stems for one table that all joins of prefixes read (F7)."""
    entries = spark.createDataFrame([("d", "ionic bonds weakened", "ionic bonds weakened", 2), ("d", "ionic bond", "ionic bond", 1), ("d", "cell theory", "cell theory", 3), ("d", "cell", "cell", 4)], "doc_id string, key string, name string, first int")
    found = ops.prefix_targets(entries)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    assert sorted((r["key"], r["target"]) for r in found.collect()) == [("ionic bonds weakened", "ionic bond")]
