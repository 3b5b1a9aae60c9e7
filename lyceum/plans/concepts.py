"""What the documents teach: from their sentences to concepts, over whole texts. Pages are runs of four lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.operators import concepts as ops
from lyceum.operators import provider, study_map
from lyceum.sources import tables as t
from lyceum.sources.shared import stored


#: Tasks a core that the texts are dealt to.
_TASKS = 4


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the documents, whose texts are dealt out evenly first: a file of one row group is read by one task, and reading sentences is what costs."""
    texts = t.load(spark, d, "documents").select("doc_id", "text")
    return ops.sentences(texts.repartition(_TASKS * spark.sparkContext.defaultParallelism))


def i10_teaching_sentences(spark: SparkSession, d: str) -> DataFrame:
    return ops.teaching_sentences(_sentences(spark, d)).select("doc_id", "page", "ord", F.size("content").alias("words"))


def i11_subjects(spark: SparkSession, d: str) -> DataFrame:
    return ops.subjects(_sentences(spark, d))


def i15_candidate_terms(spark: SparkSession, d: str) -> DataFrame:
    # Written first: behind a generator Spark would work out all terms twice.
    found = ops.taught(_sentences(spark, d))
    return found.select("doc_id", "page", "ord", F.posexplode("terms").alias("place", "t")).select("doc_id", "page", "ord", "place", "t.term", "t.type")


def i16_concepts(spark: SparkSession, d: str) -> DataFrame:
    found = ops.concepts(_sentences(spark, d))
    return found.select("doc_id", "concept", "type", F.size("types").alias("mentions"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.array_join(F.transform("evidence", lambda e: e["ord"].cast("string")), ",").alias("evidence"))


def g3_alias_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = _sentences(spark, d)
    known = ops.taught(rows)
    return ops.alias_targets(stored(ops.candidates(known), "names"), ops.declared_aliases(rows), known)


def g4_prefix_targets(spark: SparkSession, d: str) -> DataFrame:
    return ops.prefix_targets(stored(ops.candidates(ops.taught(_sentences(spark, d))), "names"))


def _map(spark: SparkSession, d: str) -> study_map.StudyMap:
    return study_map.study_map(_sentences(spark, d))


def i18_study_map(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of the documents with their signals and importance."""
    signals = ["depth", "centrality", "richness", "emphasis", "spread"]
    return _map(spark, d).concepts.select("doc_id", "concept", "type", "tokens", *[F.round(c, 6).alias(c) for c in signals], "degree", "importance", "value")


def e12_leading_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return study_map.leading(_map(spark, d).concepts).select("doc_id", "concept", "type", "importance")


def i17_document_relations(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d).relations


def g13_merged_concepts(spark: SparkSession, d: str) -> DataFrame:
    """What a provider proposes of each document, verified and merged with the document's own concepts.

    Stands in for a provider: the first words of every third teaching sentence as a name, with the sentence as its
    quote, the page before its own as its page, and for every second one a quote that stands nowhere.
    """
    rows = _sentences(spark, d)
    taught = ops.taught(rows, content=True)
    pages = rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    k = F.col("number")
    said = taught.filter(k % 3 == 0).select(
        "doc_id", k.cast("long").alias("place"), F.substring_index("sentence", " ", 3).alias("name"), F.when(k % 2 == 0, "Core Concept").otherwise("odd").alias("type"),
        F.array(F.when(k % 2 == 0, F.col("sentence")).otherwise(F.concat(F.lit("No page says that "), fn.slug(F.col("sentence")), F.lit(" at all here.")))).alias("quotes"),
        F.array(F.when(k % 4 == 0, F.col("page") - 1).otherwise(F.col("page")).cast("string")).alias("pages"),
    )
    return provider.merged(provider.verified(said, pages, taught), ops.concepts(rows, taught))


QUERIES = {
    "e12_leading_of_documents": (e12_leading_of_documents, None),
    "g13_merged_concepts": (g13_merged_concepts, None),
    "g3_alias_targets": (g3_alias_targets, None),
    "g4_prefix_targets": (g4_prefix_targets, None),
    "i10_teaching_sentences": (i10_teaching_sentences, None),
    "i11_subjects": (i11_subjects, None),
    "i15_candidate_terms": (i15_candidate_terms, None),
    "i16_concepts": (i16_concepts, None),
    "i17_document_relations": (i17_document_relations, None),
    "i18_study_map": (i18_study_map, None),
}
