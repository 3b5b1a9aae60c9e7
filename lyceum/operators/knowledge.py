"""From sentences to what can be asked: relational claims, knowledge targets, question stems, answers about a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions import text as fn

# Connectives after which a claim of a kind stands, in the order in which kinds are tried.
CLAIMS = [
    ("purpose", r"(?:(?:is|are) used (?:for|in|to|when)|responsible for|(?:important|essential|necessary|critical|crucial|vital|needed|useful) (?:for|to)|so that|in order to)"),
    ("cause", r"(?:because(?: of)?|due to)"),
    ("mechanism", r"(?:(?:states?|asserts?|holds?|establishes?|specifies?) that|by|through|via)"),
    ("condition", r"(?:(?:forms?|occurs?|arises?|happens?|develops?|appears?|emerges?|begins?) (?:when|where|whenever|wherever|if)|if and only if|applies? when|provided that|as long as|relies on|depends on|requires?|needs?)"),
    ("effect", r"(?:leads? to|results? in|causes?|produces?|generates?|ensures?|allows?|enables?|prevents?)"),
    ("category", r"(?:exists? in|divided into|classified into|grouped into|consists? of)"),
    ("contrast", r"(?:differs? from|unlike|in contrast to|compared (?:to|with)|whereas)"),
]
# The skill that each kind of claim lets be asked, and the stem of the question.
ASKED = {
    "purpose": ("understanding", "Why does %s matter?"),
    "cause": ("cause_effect", "What brings about %s?"),
    "effect": ("cause_effect", "What follows from %s?"),
    "mechanism": ("process_order", "How does %s work?"),
    "condition": ("analysis", "What does %s depend on?"),
    "category": ("classification", "What does %s divide into?"),
    "contrast": ("comparison", "How does %s differ from others?"),
}


def claims(concepts: DataFrame, sentences: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, concept, kind, clause, ord: claims that sentences make about the concept that they begin with.

    A sentence is about a concept if it begins with its name, an article apart. `concepts` (doc_id, concept) and
    `sentences` (doc_id, ord, sentence) meet by the first word of both. Negated claims don't count; a clause of a
    kind counts once; at most `most` per concept, in order of the kinds.
    """
    bare = lambda x: F.regexp_replace(fn.normal(x), "^(?:the|a|an) ", "")
    name = concepts.select("doc_id", "concept", bare(F.col("concept")).alias("name")).withColumn("first", F.substring_index("name", " ", 1))
    about = sentences.select("doc_id", "ord", "sentence", bare(F.col("sentence")).alias("plain")).withColumn("first", F.substring_index("plain", " ", 1))
    met = about.join(name, ["doc_id", "first"]).filter(F.startswith("plain", F.concat("name", F.lit(" "))))
    kinds = []
    for k, (kind, connective) in enumerate(CLAIMS):
        clause = F.trim(F.regexp_extract("sentence", rf"(?i)\b{connective}\s+([^.;]{{8,140}})", 1))
        kinds.append(F.when(clause != "", F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), clause.alias("clause"))))
    rows = met.filter(~F.lower("sentence").rlike(r"\b(?:not|never|no longer|cannot)\b")).select("doc_id", "concept", "ord", F.explode(F.array_compact(F.array(*kinds))).alias("c"))
    rows = rows.groupBy("doc_id", "concept", "c.k", "c.kind", F.col("c.clause").alias("clause")).agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("doc_id", "concept").orderBy("k", "ord", "clause"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("doc_id", "concept", "kind", "clause", "ord")


def targets(found: DataFrame, concepts: DataFrame) -> DataFrame:
    """doc_id, concept, skill, kind, clause, prompt: one target per skill of a concept.

    The first claim of a skill (by kind, then sentence) is asked by its stem. A purpose or effect gives an
    application besides, any of purpose, effect, mechanism and cause a check of misconceptions; each concept can
    be asked for its understanding, and recalled by name.
    """
    order = F.array(*[F.lit(kind) for kind, _ in CLAIMS])
    skill, stem = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (s, q) in ASKED.items():
        skill, stem = F.when(F.col("kind") == kind, s).otherwise(skill), F.when(F.col("kind") == kind, q).otherwise(stem)
    rows = found.withColumn("k", F.array_position(order, F.col("kind")))
    said = rows.select("doc_id", "concept", skill.alias("skill"), "kind", "clause", "k", "ord", F.replace(stem, F.lit("%s"), F.col("concept")).alias("prompt"))
    ask = lambda kinds, s, before, after: rows.filter(F.col("kind").isin(kinds)).select("doc_id", "concept", F.lit(s).alias("skill"), "kind", "clause", "k", "ord", F.concat(F.lit(before), "concept", F.lit(after)).alias("prompt"))
    more = ask(["purpose", "effect"], "application", "What would happen without ", "?").union(ask(["purpose", "effect", "mechanism", "cause"], "misconception", "Is it really ", " of which this is said?"))
    plain = lambda s, k, q: concepts.select("doc_id", "concept", F.lit(s).alias("skill"), F.lit("").alias("kind"), F.lit("").alias("clause"), F.lit(k).cast("long").alias("k"), F.lit(0).alias("ord"), F.concat(F.lit(q), "concept", F.lit(".")).alias("prompt"))
    everything = reduce(DataFrame.union, [said, more, plain("understanding", 90, "Explain "), plain("factual_recall", 91, "Name the term for ")])
    place = F.row_number().over(Window.partitionBy("doc_id", "concept", "skill").orderBy("k", "ord", "clause"))
    return everything.withColumn("n", place).filter("n = 1").select("doc_id", "concept", "skill", "kind", "clause", "prompt")


def distractors(found: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, concept, skill, options: clauses of other concepts of the document, of the same kind first, nearest in length.

    Options too like the answer (Jaccard from 0.6) go. Clauses meet within a document.
    """
    own = found.filter("clause <> ''").select("doc_id", "concept", "skill", "kind", "clause")
    other = own.select("doc_id", F.col("concept").alias("oc"), F.col("kind").alias("ok"), F.col("clause").alias("option")).distinct()
    met = own.join(other, "doc_id").filter((F.col("concept") != F.col("oc")) & (fn.jaccard(F.array_distinct(fn.tokens(F.col("clause"))), F.array_distinct(fn.tokens(F.col("option")))) < 0.6))
    near = F.abs(F.length("clause") - F.length("option"))
    best = met.groupBy("doc_id", "concept", "skill", "option").agg(F.min(F.struct((F.col("kind") != F.col("ok")).cast("int"), near)).alias("rank"))
    place = F.row_number().over(Window.partitionBy("doc_id", "concept", "skill").orderBy("rank", "option"))
    few = best.withColumn("n", place).filter(F.col("n") <= k)
    return few.groupBy("doc_id", "concept", "skill").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "option"))), lambda x: x["option"]).alias("options"))


def intent(question: Column) -> Column:
    """What a question about a file asks for: the first of the intents whose word it holds."""
    low = F.lower(question)
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return (
        F.when(has("summar"), "summary").when(has("explain"), "explanation").when(has("important", "topic"), "topics").when(has("exam", "question"), "exam")
        .when(has("difficult", "hard", "struggle"), "difficulty").when(has("definition", "define"), "definition").when(has("formula"), "formula").otherwise("search")
    )


def content_density(definitions: Column, formulas: Column, concepts: Column, questions: Column, pages: Column) -> Column:
    """0 to 100, by what a document offers."""
    return F.least(F.lit(100), definitions * 8 + formulas * 6 + concepts * 4 + questions * 5 + F.least(pages, F.lit(10)) * 2)
