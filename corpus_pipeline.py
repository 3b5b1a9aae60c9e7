"""A corpus pipeline: from the documents of a crawl to the token ids that a training run reads.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns that came
in; the last returns a row per text to train on. A stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.llm import bpe_codec, mixing, pii, simhash, toxicity
from lyceum.llm.shared import cut, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted severity is that of toxic ones go; the model is fitted on the labels table.

    Null and empty texts have no features and stay; rows that repeat a doc_id are judged one by one; without
    labels all stay. All columns come back, whatever their names; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.graded(F.col("toxic"), F.col("quality"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Texts without words are near copies of each other. Rows that repeat a doc_id are one document and stay or
    go together; rows with a null doc_id stay. All columns come back; an empty table stays empty.
    """
    return simhash.keep_one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes the name of its kind; n_chars follows the text.

    Null texts stay null, with n_chars null; texts without spans stay as they are. Every row comes back, with
    all columns.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their targets; rows come back in training order.

    The order of the rows in the files that are written is the order of training. Texts without words are
    never taken; a null source is a source of its own; rows that repeat a doc_id are one document. All columns
    come back.
    """
    return mixing.in_training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position, n_tokens, ids, and the digests of the ids and of what they decode to, for each row.

    position rises in the order of the rows in the files that docs was read from (task, then the files that it
    wrote, then row), which is the training order, and is unique; it is null if docs wasn't read from files. A
    null text has no ids; an empty table gives an empty result; columns other than doc_id and text are not read.
    """
    try:
        place = docs.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "text")
    except AnalysisException:
        place = docs.select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("row"), "doc_id", "text")
    number = lambda pattern: F.coalesce(F.regexp_extract("file", pattern, 1).try_cast("long"), F.lit(0))
    position = number(r"^part-(\d+)") * (1 << 44) + number(r"-c(\d+)[.]") * (1 << 34) + F.col("row")
    return bpe_codec.round_trip(place.select("doc_id", "text", position.alias("position")), carry=["position"], with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("pii_redaction", redact_personal_data),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: SQL expresses neither the fitted models nor BPE; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
