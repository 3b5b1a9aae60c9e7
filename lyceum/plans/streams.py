"""Streams run to their end, and extracts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.functions import words
from lyceum.operators import documents, extracts
from lyceum.plans.activity import QUERIES as ACTIVITY
from lyceum.plans.text import _LINES, STOP, _sql_list
from lyceum.sources import readers
from lyceum.sources import tables as t
from lyceum.streaming import ledger


def _entries(spark: SparkSession, d: str) -> DataFrame:
    e = ledger.stream_of(spark, d, "events")
    key = F.when(F.col("event_id") % 11 != 0, F.get_json_object("props", "$.k"))
    return e.select("user_id", F.col("event_type").alias("source"), key.alias("key"), F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value")).alias("amount"), "ts")


def k_stream_awards(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.run_to_end(ledger.awards_once(_entries(spark, d)), "awards")
    return found.groupBy("user_id", "source").agg(F.count("*").alias("awards"))


def k_stream_daily_totals(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.run_to_end(ledger.daily_totals(_entries(spark, d)), "daily", mode="complete")
    return found.withColumn("gained", F.round("gained", 4))


def k_stream_study_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = ledger.stream_of(spark, d, "events").filter("event_type = 'view'")
    return ledger.run_to_end(ledger.study_blocks(e.select("user_id", F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("minutes"))), "blocks")


def k_stream_newly_read(spark: SparkSession, d: str) -> DataFrame:
    e = ledger.stream_of(spark, d, "events")
    return ledger.run_to_end(ledger.newly_read(e.select(F.col("user_id").alias("file_id"), (F.col("event_id") % 37).cast("int").alias("page"))), "pages")


def a5_clean_text(spark: SparkSession, d: str) -> DataFrame:
    rows = t.load(spark, d, "benchmark")
    return rows.select("item_id", F.md5(readers.clean_text(F.concat(F.lit(" \t x\x00\x00"), F.regexp_replace("text", " ", "  "), F.lit("\n\n\n\n y ")))).alias("digest"))


def a14_latest_writes(spark: SparkSession, d: str) -> DataFrame:
    """The library after a run of writes: the last of each file wins."""
    files = t.vault_files(spark, d).select("file_id", F.lit(0).cast("long").alias("version"), "title")
    changes = t.load(spark, d, "events").select((F.col("user_id") * 2).alias("file_id"), F.col("event_id").alias("version"), F.concat(F.lit("Draft "), F.col("event_id").cast("string")).alias("title"))
    return readers.merged(files, changes, "file_id", "version")


def a18_repaired_rows(spark: SparkSession, d: str) -> DataFrame:
    old = t.vault_files(spark, d).select("file_id", F.when(F.col("file_id") % 2 == 0, F.array("lang")).alias("tags"), F.when(F.col("file_id") % 3 == 0, "soon").otherwise(F.col("n_chars").cast("string")).alias("exam"), F.when(F.col("favorite"), True).alias("favorite"))
    found = readers.repaired(old, {"tags": "array<string>", "notes": "array<string>"}, ["exam", "score"], ["favorite", "pinned"])
    return found.select("file_id", F.size("tags").alias("tags"), F.size("notes").alias("notes"), "exam", "score", "favorite", "pinned")


def _framed(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold sentences of known form between the benchmark's."""
    b = t.load(spark, d, "benchmark")
    i = F.col("item_id").cast("string")
    text = F.concat(F.lit("The Osmosis"), i, F.lit(" is defined as the flow of water number "), i, F.lit(". Force refers to a push or pull. Here F = m * a and x2 = 4"), i, F.lit("; Key exam tip. "), "text")
    return b.select((F.col("item_id") % 10).alias("doc_id"), F.col("item_id").cast("int").alias("page"), text.alias("text"))


def i21_definitions(spark: SparkSession, d: str) -> DataFrame:
    return extracts.definitions(_framed(spark, d))


def i22_formulas(spark: SparkSession, d: str) -> DataFrame:
    return extracts.formulas(_framed(spark, d))


def i24_difficulty(spark: SparkSession, d: str) -> DataFrame:
    found = extracts.difficulty(t.load(spark, d, "documents"), documents.browser_tokens(F.col("text"), STOP), F.lit(0))
    return found.select("doc_id", F.round("words_per_sentence", 6).alias("words_per_sentence"), F.round("density", 6).alias("density"), "difficulty")


def i25_flashcards(spark: SparkSession, d: str) -> DataFrame:
    pages = _framed(spark, d)
    s = pages.select("doc_id", "page", F.posexplode(fn.sentences(F.col("text"))).alias("k", "sentence"))
    s = s.withColumn("ord", F.col("page") * 1000 + F.col("k"))
    top = documents.top_sentences(s, documents.browser_tokens(F.col("sentence"), STOP))
    return extracts.flashcards(extracts.definitions(pages), top)


def g2_sentences(spark: SparkSession, d: str) -> DataFrame:
    lines = documents.lines(t.load(spark, d, "documents"), lines_per_page=4)
    return extracts.sentences_over_pages(lines.withColumn("heading", fn.heading_like(F.col("line"))))


def i17_relations(spark: SparkSession, d: str) -> DataFrame:
    """Concepts are the definitions' terms."""
    pages = _framed(spark, d)
    terms = extracts.definitions(pages).select("doc_id", F.col("term").alias("concept"), (1 - F.col("place") / 10).alias("importance"), fn.content_tokens(F.col("term")).alias("tokens"))
    s = pages.select("doc_id", F.col("page").alias("ord"), F.concat_ws(" ", F.lit("force leads to"), "text").alias("sentence"))
    return extracts.relations(terms, s)


def f13_evidence(spark: SparkSession, d: str) -> DataFrame:
    pages = _framed(spark, d)
    terms = extracts.definitions(pages).select("doc_id", F.col("term").alias("concept"), fn.content_tokens(F.col("term")).alias("tokens"))
    s = pages.select("doc_id", "page", F.posexplode(fn.sentences(F.col("text"))).alias("k", "sentence")).withColumn("ord", F.col("page") * 1000 + F.col("k"))
    return extracts.evidence(terms, s).withColumn("score", F.round("score", 6))


def i20_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of the documents' lines, each behind its page and number."""
    rows = documents.lines(t.load(spark, d, "documents"), lines_per_page=4)
    numbered = F.concat(F.col("page").cast("string"), F.lit("."), F.col("line_no").cast("string"), F.lit(" "), "line")
    return rows.select("doc_id", "line_no", F.posexplode(extracts.numbered_headings(numbered)).alias("place", "heading"))


def h31_false_citations(spark: SparkSession, d: str) -> DataFrame:
    """Answers about the documents that cite pages in nested cards, of which some don't exist."""
    docs = t.load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"), (F.col("n_chars") % 7 + 1).alias("pages"))
    n = F.col("n").cast("string")
    answer = F.concat(
        F.lit('{"cards":[{"front":"x","source_pages":[1,'), (F.col("n") % 10).cast("string"), F.lit(',[3,"4"],2.5]},{"deep":{"page":99,"start_page":'), (F.col("n") % 5).cast("string"),
        F.lit('}}],"end_page":"'), n, F.lit('","source_page":'), F.when(F.col("n") % 3 == 0, "true").otherwise(F.concat(F.lit("-"), (F.col("n") % 2).cast("string"))), F.when(F.col("n") % 11 == 0, ",").otherwise("}"),
    )
    return extracts.false_citations(docs.select("id", answer.alias("answer"), "pages"))


_KEYS = "SELECT user_id, event_type AS source, CASE WHEN event_id % 11 <> 0 THEN json_extract_string(props, '$.k') END AS key FROM events"

QUERIES = {
    "a5_clean_text": (a5_clean_text, r"SELECT item_id, md5(trim(regexp_replace(regexp_replace('  x  ' || replace(text, ' ', '  ') || chr(10) || chr(10) || ' y ', '[ \t]+', ' ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM benchmark"),
    "a14_latest_writes": (a14_latest_writes, """
WITH last AS (SELECT user_id * 2 AS file_id, max(event_id) AS version FROM events GROUP BY ALL)
SELECT file_id, version, 'Draft ' || version AS title FROM last UNION ALL SELECT doc_id, 0, 'File ' || doc_id FROM documents WHERE doc_id NOT IN (SELECT file_id FROM last)"""),
    "a18_repaired_rows": (a18_repaired_rows, """
SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS tags, 0 AS notes, CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars AS DOUBLE) END AS exam, CAST(NULL AS DOUBLE) AS score, doc_id % 10 = 0 AS favorite, false AS pinned FROM documents"""),
    "f13_evidence": (f13_evidence, None),
    "g2_sentences": (g2_sentences, None),
    "h31_false_citations": (h31_false_citations, """
WITH a AS (SELECT doc_id AS id, n_chars % 7 + 1 AS pages, '{"cards":[{"front":"x","source_pages":[1,' || (n_chars % 10) || ',[3,"4"],2.5]},{"deep":{"page":99,"start_page":' || (n_chars % 5) || '}}],"end_page":"' || n_chars || '","source_page":'
  || CASE WHEN n_chars % 3 = 0 THEN 'true' ELSE '-' || (n_chars % 2) END || '}' AS answer FROM documents WHERE n_chars % 11 <> 0),
leaf AS (SELECT a.id, a.pages, regexp_extract(regexp_replace(t.fullkey, '(\\[\\d+\\])+$', ''), '([^.]+)$', 1) AS key, t.type, t.atom FROM a, json_tree(a.answer) t)
SELECT id, key, CAST(atom AS BIGINT) AS page FROM leaf WHERE key IN ('source_page', 'source_pages', 'start_page', 'end_page') AND type IN ('UBIGINT', 'BIGINT') AND (CAST(atom AS BIGINT) < 1 OR CAST(atom AS BIGINT) > pages)"""),
    "i17_relations": (i17_relations, None),
    "i20_headings": (i20_headings, rf"""
WITH RECURSIVE {_LINES}, parts AS (SELECT doc_id, line_no, string_split(regexp_replace(page || '.' || line_no || ' ' || line, '(\d+\.\d+)\s+', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM paged),
cut AS (SELECT doc_id, line_no, i, i < len(p) AS inner_, split_part(p[i], chr(2), 1) AS number, split_part(p[i], chr(2), 2) AS behind FROM (SELECT *, unnest(range(2, len(p) + 1)) AS i FROM parts)),
seg AS (SELECT doc_id, line_no, i, number, regexp_split_to_array(CASE WHEN inner_ AND NOT regexp_matches(behind, '\s$') THEN behind || '0' ELSE behind END, '\s')[1:10] AS raw FROM cut),
walk AS (
  SELECT doc_id, line_no, i, number, raw, 0 AS k, CAST([] AS VARCHAR[]) AS w, false AS asks, false AS named, true AS open FROM seg
  UNION ALL
  SELECT doc_id, line_no, i, number, raw, k + 1, CASE WHEN fits AND NOT again THEN list_append(w, word) ELSE w END, asks OR first, named OR (fits AND title AND NOT first AND (asks OR first)), fits AND NOT again AND NOT regexp_matches(r, '[.!?]$')
  FROM (SELECT *, title OR low IN {_sql_list(words.HEADING_GLUE)} OR first OR (asks AND NOT named AND low IN {_sql_list(words.COPULAS)}) AS fits, title AND list_contains(list_transform(w, lambda x: lower(x)), low) AS again
    FROM (SELECT *, lower(word) AS low, regexp_matches(word, '^[A-Z][a-z''-]*$') OR regexp_matches(word, '^[A-Z]+$') AS title, len(w) = 0 AND lower(word) IN {_sql_list(words.INTERROGATIVES)} AS first
      FROM (SELECT *, raw[k + 1] AS r, regexp_replace(raw[k + 1], '[.,;:!?]+$', '') AS word FROM walk WHERE open AND k < len(raw))))),
last AS (SELECT doc_id, line_no, i, number, arg_max(w, k) AS w FROM walk GROUP BY ALL),
kept AS (SELECT *, greatest(1, coalesce(list_max(list_filter(range(1, len(w) + 1), lambda k: lower(w[k]) NOT IN {_sql_list(words.SENTENCE_STARTERS)})), 1)) AS n FROM last WHERE len(w) > 0)
SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1 AS INTEGER) AS place, number || ' ' || array_to_string(w[1:n], ' ') AS heading FROM kept"""),
    "i21_definitions": (i21_definitions, None),
    "i22_formulas": (i22_formulas, None),
    "i24_difficulty": (i24_difficulty, None),
    "i25_flashcards": (i25_flashcards, None),
    "k_stream_awards": (k_stream_awards, f"SELECT user_id, source, count(DISTINCT key) + count(*) FILTER (key IS NULL) AS awards FROM ({_KEYS}) GROUP BY ALL"),
    "k_stream_daily_totals": (k_stream_daily_totals, "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, round(sum(value), 4) AS gained, count(*) AS entries FROM events WHERE event_type <> 'purchase' AND value > 0 GROUP BY ALL"),
    "k_stream_newly_read": (k_stream_newly_read, "SELECT DISTINCT user_id AS file_id, CAST(event_id % 37 AS INTEGER) AS page FROM events WHERE event_id % 37 >= 1"),
    "k_stream_study_blocks": (k_stream_study_blocks, ACTIVITY["d10_study_blocks"][1]),
}
