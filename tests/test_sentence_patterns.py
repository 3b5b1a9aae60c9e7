"""Patterns over whole sentences are asked once, and behind cheaper ones that lose nothing."""

from functools import reduce

from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.functions import words
from lyceum.operators import concepts as ops

SAID = """Osmosis is defined as flow|x is  known as y|x is called y|this means that y|x is the study of y|x can be defined|Force refers to push|unlike that|whereas x|while x but y|in contrast x|compared with x
differs from|difference between|similar to|both x and y|rather than|instead of|distinguishes|because|therefore|thus|hence|causes|caused by|leads to|results in|due to|depends on|so that|consequently|if x then y
increases|decrease|affects|enables|prevent|allows|types of|kind of|categories|classified|divided into|consists of|grouped into|forms of|exists in two|process|procedure|mechanism|steps|stage|phases|cycle|sequence
first|then|next|finally|proceeds|converts|synthesis|assembly|produces|generate|transforms|replicates|transcribed|translation|iterates|law of|principle|theorem|rule|axiom|postulate|states that|equation|formula
must always|never|theory states|a = b|for example|for instance|such as|e.g.x|as an example|consider the case|commonly called|mnemonic|يسبب|هو عباره عن|BECAUSE|plain words|bécause|island there|""".replace("\n", "|").split("|")


def test_kinds_are_those_of_the_patterns(spark):
    """Every marker passes the check that comes before the patterns."""
    rows = spark.createDataFrame([(f"Here {x} z",) for x in SAID] + [(x,) for x in SAID], "s string")
    plain = F.lit("fact")
    for name, pattern in reversed(words.KNOWLEDGE):
        plain = F.when(F.col("s").rlike("(?i)" + pattern), name).otherwise(plain)
    found = rows.select("s", fn.knowledge_type(F.col("s")).alias("new"), plain.alias("old")).collect()
    assert [r for r in found if r["new"] != r["old"]] == []
    assert len({r["old"] for r in found}) == 8


def test_normal_forms_with_and_without_arabic(spark):
    texts = ["Ünïcode-Text, 5 €!", "مُحَمَّد أحمد ــ ةى", "a b c _x_", "", "  .. ", "xٰy", "Plain text's end."]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    for strip in (True, False):
        bare = F.regexp_replace("t", "[ً-ٰٟـ]", "") if strip else F.col("t")
        lower = F.lower(F.translate(bare, "أإآىئؤةء", "اااييوه"))
        old = F.trim(F.regexp_replace(F.regexp_replace(lower, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
        assert [tuple(r) for r in rows.select("t", fn.normal(F.col("t"), strip).alias("n"), old.alias("o")).collect() if r["n"] != r["o"]] == []


def test_furniture_and_layout_as_before(spark):
    texts = ["see www.x.org", "WWW.x now", "http://a", "a@b.org", "isbn 123456789", "ISSN 1234-5678", "10.1234/abc", "© x", "Ⓒ", "a 10.5 b", "é plain", "the red warning box", "a box in grey", "top of the page", "left column", "tops", "x"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    raw = reduce(lambda a, b: a | b, [F.col("t").rlike(p) for _, p in words.RAW_FURNITURE])
    found = rows.select("t", (ops._furnished_raw(F.col("t")) == raw).alias("a"), (ops.layout_detail(F.col("t")) == F.col("t").rlike(words.LAYOUT)).alias("b")).collect()
    assert [r["t"] for r in found if not (r["a"] and r["b"])] == []


def test_head_is_matched_once(spark):
    """The pattern of the subject with the rest of the sentence behind it stood twice in the plan."""
    rows = spark.createDataFrame([("The cell divides. It grows.",), ("The",), ("A  big\u00a0cat's-tail sits on 5 mats",), ("5 cats",), (None,)], "sentence string")
    found = ops.with_terms(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(.*)$" not in plan
    assert [r["subject"] for r in found.collect()] == ["cell", "The", "big\u00a0cat's-tail", "", ""]
