"""The queries of this subpackage: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.llm import ann, bpe_codec, forest, hard_negatives, mixing, passages, phrases, pii, simhash, token_counts, toxicity, warc, winnowing
from lyceum.llm.shared import table


def op1_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.prefix_table(table(spark, sf_dir, "documents"), budgets=[1024])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), F.col("fits")[0].alias("chars_within_limit"))


def op2_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_mixing_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"), F.round("second_position", 6).alias("second_position"))


def op5_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severities(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.graded(F.col("toxic"), F.col("quality"))))


def op6_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), threshold=0.93)


def op8_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"))


def op9_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, words_per_shingle=4, seed=42, segments=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), similarity=0.8)


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("items")


def op12_residual_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, anchors=F.col("vec_id") % 100 == 0)


def op13_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, longest=4, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prefix_token_counts": op1_prefix_token_counts,
    "op2_ivfpq_search": op2_ivfpq_search,
    "op3_warc_normaliser": op3_warc_normaliser,
    "op4_mixing_curriculum": op4_mixing_curriculum,
    "op5_toxicity_ordinal": op5_toxicity_ordinal,
    "op6_pii_boosted_candidates": op6_pii_boosted_candidates,
    "op7_projection_forest": op7_projection_forest,
    "op8_bpe_chunk_reuse": op8_bpe_chunk_reuse,
    "op9_simhash_multi_index": op9_simhash_multi_index,
    "op10_paragraph_minhash": op10_paragraph_minhash,
    "op11_winnowing": op11_winnowing,
    "op12_residual_negatives": op12_residual_negatives,
    "op13_suffix_phrases": op13_suffix_phrases,
}

ORACLES: dict[str, str] = {
    "op3_warc_normaliser": """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
stored AS (SELECT payload_digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN s.first IS NULL OR p.page_id = s.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN s.first IS NULL OR p.page_id = s.first THEN NULL ELSE s.first END AS refers_to
FROM payloads p LEFT JOIN stored s USING (payload_digest)
""",
    "op4_mixing_curriculum": """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS cycle
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE cycle WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CASE cycle WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS tilt, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS fill,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
settled AS (SELECT arg_min(level, struct_pack(f := fill, n := source IS NULL, s := source)) FILTER (WHERE level <= fill) AS final FROM levels),
targets AS (SELECT source, source_size, tilt, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM levels, settled),
queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.tilt,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END AS BIGINT) AS passes FROM queued),
final AS (
  SELECT *, CAST(passes * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - passes * source_size - place)) AS BIGINT) AS taken,
         place / greatest(target, 1.0::DOUBLE) AS share, (place + source_size) / greatest(target, 1.0::DOUBLE) AS again FROM taken)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(least(1.0::DOUBLE, CASE WHEN tilt = 0 THEN share
         ELSE 2 * share / ((1 - tilt) + sqrt(greatest(0.0::DOUBLE, (1 - tilt) * (1 - tilt) + 4 * tilt * share))) END), 6) END AS position,
       CASE WHEN taken > size THEN round(least(1.0::DOUBLE, CASE WHEN tilt = 0 THEN again
         ELSE 2 * again / ((1 - tilt) + sqrt(greatest(0.0::DOUBLE, (1 - tilt) * (1 - tilt) + 4 * tilt * again))) END), 6) END AS second_position
FROM final
""",
    "op7_projection_forest": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = e.vec_id
""",
    "op11_winnowing": """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
wi AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS span
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
wd AS (
  SELECT row, size, s, array_to_string(w[s : s + size - 1], ' ') AS span
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM wi) WHERE len(w) >= size)),
hit AS (SELECT wd.row, wd.s, wd.size, wi.item_id FROM wd JOIN wi USING (size, span)),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT row, s, size FROM hit)) GROUP BY row),
listed AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row, item_id FROM hit) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN listed USING (row)
""",
    "op12_residual_negatives": """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
""",
    "op13_suffix_phrases": """
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, size, array_to_string(w[s : s + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM pieces, range(1, 5) t(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT * FROM f WHERE f >= 30),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE size > 1),
cuts AS (SELECT *, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
lefts AS MATERIALIZED (SELECT c.*, x.f AS l FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.head),
halves AS (
  SELECT c.lang, c.phrase, c.a, c.k, c.l, y.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (CAST(c.l AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM lefts c JOIN often y ON y.lang = c.lang AND y.phrase = c.tail),
best AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS within
  FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS s FROM candidates, range(2, 4) t(m) WHERE m < size) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE within IS NULL OR 100 * CAST(within AS HUGEINT) < 80 * CAST(a AS HUGEINT)
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000
""",
}
