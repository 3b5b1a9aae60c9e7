"""Claims, targets, distractors and answers, on frames between the benchmark's sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.operators import knowledge as ops
from lyceum.sources import tables as t

FRAMES = [
    "The {n} is used to carry water uphill number {k}.",
    "{n} occurs when heat reaches degree {k} inside.",
    "{n} leads to growth of order {k} in plants.",
    "{n} is not used to build houses anywhere.",
    "{n} differs from steam in colour {k} only.",
]


def _sentences(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Five sentences for each nation, whose region is the document."""
    n = t.load(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.initcap("n_name").alias("concept"), F.col("n_nationkey").alias("k"))
    frame = F.posexplode(F.array(*map(F.lit, FRAMES))).alias("i", "frame")
    rows = n.select("doc_id", "concept", "k", frame)
    text = F.replace(F.replace("frame", F.lit("{n}"), F.col("concept")), F.lit("{k}"), F.col("k").cast("string"))
    return n.select("doc_id", "concept"), rows.select("doc_id", (F.col("k") * 10 + F.col("i")).cast("int").alias("ord"), text.alias("sentence"))


def i12_claims(spark: SparkSession, d: str) -> DataFrame:
    return ops.claims(*_sentences(spark, d))


def i28_targets(spark: SparkSession, d: str) -> DataFrame:
    concepts, sentences = _sentences(spark, d)
    return ops.targets(ops.claims(concepts, sentences), concepts)


def i32_distractors(spark: SparkSession, d: str) -> DataFrame:
    concepts, sentences = _sentences(spark, d)
    return ops.distractors(ops.targets(ops.claims(concepts, sentences), concepts)).select("doc_id", "concept", "skill", F.size("options").alias("n"), F.array_join("options", " | ").alias("options"))


def i27_intents(spark: SparkSession, d: str) -> DataFrame:
    asked = F.array(*[F.lit(x) for x in ("", "Please summarise ", "Explain this: ", "Which TOPICS? ", "What is hard? ", "Define ", "any formula ")])
    c = t.load(spark, d, "conversations").filter("role = 'user'")
    text = F.concat(F.element_at(asked, (F.col("conv_id") % 7).cast("int") + 1), "text")
    return c.select("conv_id", "turn", ops.intent(text).alias("intent"))


def i26_density(spark: SparkSession, d: str) -> DataFrame:
    f = t.vault_files(spark, d)
    i = F.col("file_id")
    return f.select("file_id", ops.content_density(i % 9, i % 4, i % 11, i % 5, F.col("page_count")).alias("density"))


_CLAIMED = """
WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, upper(n_name[1]) || lower(n_name[2:]) AS low, n_nationkey AS k, n_name FROM nation),
c AS (SELECT doc_id, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS concept, k FROM n),
claims AS (
  SELECT doc_id, concept, 'purpose' AS kind, 'carry water uphill number ' || k AS clause, CAST(k * 10 AS INTEGER) AS ord FROM c
  UNION ALL SELECT doc_id, concept, 'condition', 'heat reaches degree ' || k || ' inside', CAST(k * 10 + 1 AS INTEGER) FROM c
  UNION ALL SELECT doc_id, concept, 'effect', 'growth of order ' || k || ' in plants', CAST(k * 10 + 2 AS INTEGER) FROM c
  UNION ALL SELECT doc_id, concept, 'contrast', 'steam in colour ' || k || ' only', CAST(k * 10 + 4 AS INTEGER) FROM c)
"""
_Q = "CASE conv_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'Please summarise ' WHEN 2 THEN 'Explain this: ' WHEN 3 THEN 'Which TOPICS? ' WHEN 4 THEN 'What is hard? ' WHEN 5 THEN 'Define ' ELSE 'any formula ' END || text"

QUERIES = {
    "i12_claims": (i12_claims, _CLAIMED + "SELECT * FROM claims"),
    "i26_density": (i26_density, t.sql("vault_files", "SELECT file_id, CAST(least(100, file_id % 9 * 8 + file_id % 4 * 6 + file_id % 11 * 4 + file_id % 5 * 5 + least(page_count, 10) * 2) AS BIGINT) AS density FROM vault_files")),
    "i27_intents": (i27_intents, f"""
WITH q AS (SELECT conv_id, turn, lower({_Q}) AS q FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN contains(q, 'summar') THEN 'summary' WHEN contains(q, 'explain') THEN 'explanation' WHEN regexp_matches(q, 'important|topic') THEN 'topics' WHEN regexp_matches(q, 'exam|question') THEN 'exam'
  WHEN regexp_matches(q, 'difficult|hard|struggle') THEN 'difficulty' WHEN regexp_matches(q, 'definition|define') THEN 'definition' WHEN contains(q, 'formula') THEN 'formula' ELSE 'search' END AS intent FROM q"""),
    "i28_targets": (i28_targets, _CLAIMED + """
SELECT doc_id, concept, 'understanding' AS skill, kind, clause, 'Why does ' || concept || ' matter?' AS prompt FROM claims WHERE kind = 'purpose'
UNION ALL SELECT doc_id, concept, 'analysis', kind, clause, 'What does ' || concept || ' depend on?' FROM claims WHERE kind = 'condition'
UNION ALL SELECT doc_id, concept, 'cause_effect', kind, clause, 'What follows from ' || concept || '?' FROM claims WHERE kind = 'effect'
UNION ALL SELECT doc_id, concept, 'comparison', kind, clause, 'How does ' || concept || ' differ from others?' FROM claims WHERE kind = 'contrast'
UNION ALL SELECT doc_id, concept, 'application', kind, clause, 'What would happen without ' || concept || '?' FROM claims WHERE kind = 'purpose'
UNION ALL SELECT doc_id, concept, 'misconception', kind, clause, 'Is it really ' || concept || ' of which this is said?' FROM claims WHERE kind = 'purpose'
UNION ALL SELECT doc_id, concept, 'factual_recall', '', '', 'Name the term for ' || concept || '.' FROM c"""),
    "i32_distractors": (i32_distractors, None),
}
