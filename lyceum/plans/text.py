"""Text, documents and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.functions import words
from lyceum.operators import documents as ops
from lyceum.operators import intervals
from lyceum.sources import tables as t
from lyceum.sources.shared import stored

STOP = [w for w in words.STOP if len(w) > 2]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return t.load(spark, d, "documents")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return ops.lines(_docs(spark, d), lines_per_page=4)


def h2_normal_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(fn.normal(F.col("text"))).alias("digest"))


def h3_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(fn.tokens(F.col("text"))).alias("tokens"))


def h4_content_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = fn.content_tokens(F.col("text"))
    return t.load(spark, d, "benchmark").select("item_id", F.size(tokens).alias("tokens"), F.array_join(tokens, " ").alias("text"))


def h10_line_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select(fn.line_key(F.col("line")).alias("key"))
    return rows.filter(F.length("key") >= 2).groupBy("key").agg(F.count("*").alias("n"))


def h11_bullets(spark: SparkSession, d: str) -> DataFrame:
    marks = F.array(F.lit("- "), F.lit("•"), F.lit("1. "), F.lit("(3) "), F.lit("a) - "), F.lit("1929. "), F.lit("-"))
    rows = t.load(spark, d, "benchmark").withColumn("mark", F.explode(marks))
    return rows.select("item_id", "mark", F.md5(fn.without_bullet(F.concat("mark", "text"))).alias("digest"))


def h15_slugs(spark: SparkSession, d: str) -> DataFrame:
    return t.load(spark, d, "part").select("p_partkey", fn.slug(F.col("p_name")).alias("slug"))


def h28_reading_minutes(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\f\r]+"), lambda w: w != ""))
    return _docs(spark, d).select("doc_id", n.alias("words"), F.greatest(F.lit(1), F.floor(n / 200 + 0.5)).alias("minutes"))


def h29_languages(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("lang", fn.language(F.col("text")).alias("found")).agg(F.count("*").alias("documents"))


def h30_page_references(spark: SparkSession, d: str) -> DataFrame:
    c = t.load(spark, d, "conversations")
    text = F.concat("text", F.lit(" see page "), F.col("turn").cast("string"), F.lit(", p. 3, Page 3 and page: 99"))
    return c.select("conv_id", "turn", F.array_join(fn.page_references(text, F.lit(50)), ",").alias("pages"))


def i1_furniture(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(fn.furniture(F.col("text")), ",").alias("kinds"))


def i2_furniture_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select("doc_id", fn.furniture_line(F.col("line")).alias("furniture"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("furniture").alias("furniture"))


def i3_cleaned_pages(spark: SparkSession, d: str) -> DataFrame:
    return ops.cleaned(_lines(spark, d))


def i5_headings(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).filter(F.trim("line") != "").select("doc_id", fn.heading_like(F.col("line")).alias("heading"))
    return rows.groupBy("doc_id").agg(F.count_if("heading").alias("headings"))


def i7_knowledge_types(spark: SparkSession, d: str) -> DataFrame:
    frames = F.array(F.lit("x"), F.lit("osmosis is defined as a flow"), F.lit("unlike that"), F.lit("because of heat"), F.lit("types of rock"), F.lit("a = b"), F.lit("such as iron"))
    rows = t.load(spark, d, "benchmark").select("item_id", F.posexplode(frames).alias("k", "frame"), "text")
    return rows.select("item_id", "k", fn.knowledge_type(F.concat_ws(" ", "frame", F.lower("text"))).alias("type"))


def i8_question_classes(spark: SparkSession, d: str) -> DataFrame:
    c = t.load(spark, d, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", fn.classified(F.col("text"), words.SKILLS).alias("skill"), fn.classified(F.col("text"), words.PATTERNS).alias("pattern"), fn.trivial_question(F.col("text")).alias("trivial"))


def d24_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return ops.term_frequencies(_docs(spark, d), ops.browser_tokens(F.col("text"), STOP), "lang")


def d25_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", fn.mentions(F.col("text"), F.lit("tion")).alias("mentions"))


def d26_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return ops.repeated_keys(_lines(spark, d))


def e7_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Headings of a document with the page on which the next one begins; the last runs to the end."""
    rows = _lines(spark, d).withColumn("last", F.max("page").over(Window.partitionBy("doc_id")))
    rows = rows.filter((F.trim("line") != "") & (F.length("line") < 60))
    nxt = F.lead("page").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.select("doc_id", "line_no", "page", F.coalesce(nxt, F.col("last")).alias("end_page"))


def e9_page_budget(spark: SparkSession, d: str) -> DataFrame:
    pages = _lines(spark, d).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return ops.budgeted(pages, 3000)


def f9_key_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return ops.key_bigrams(_docs(spark, d).select("doc_id", "text"), ops.browser_tokens(F.col("text"), STOP)).select("doc_id", "term", "n", "place")


def f10_top_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select("doc_id", F.col("line_no").alias("ord"), F.col("line").alias("sentence")).filter(F.length("sentence") > 12)
    found = ops.top_sentences(rows, ops.browser_tokens(F.col("sentence"), STOP))
    return found.select("doc_id", "ord", F.round("score", 6).alias("score"), "place")


def c8_contained_token_sets(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items whose content words all occur in one document."""
    b = t.load(spark, d, "benchmark").select(F.col("item_id").alias("id"), ops.browser_tokens(F.col("text"), STOP).alias("tokens"))
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), ops.browser_tokens(F.col("text"), STOP).alias("tokens"))
    return ops.contained_sets(b, docs).withColumnsRenamed({"small_id": "item_id", "large_id": "doc_id"})


def c10_similar_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of lines and benchmark items (a class: equal sets of content tokens) with a Jaccard similarity from 0.6 on, and the lines of each."""
    lines = _docs(spark, d).select(F.explode(F.split("text", "\n")).alias("line")).union(t.load(spark, d, "benchmark").select("text"))
    # Tokens are worked out inside a generator: a filter behind it would work them out again. Equal sets are counted by their text, without sorting.
    text = lambda line: F.array_join(F.array_sort(F.array_distinct(ops.browser_tokens(F.trim(line), STOP))), " ")
    texts = lines.select(F.explode(F.filter(F.transform(F.array("line"), text), lambda x: x != "")).alias("text"))
    counted = texts.groupBy("text").agg(F.count("*").alias("lines"))
    classes = stored(counted.select(F.md5("text").alias("id"), "text", "lines"), "classes")
    found = ops.similar_pairs(classes.select("id", F.split("text", " ").alias("tokens")), 0.6).withColumn("similarity", F.round("similarity", 6))
    members = lambda side: classes.select(F.col("id").alias(side), F.col("lines").alias(f"lines_{side}"))
    return found.join(members("a"), "a").join(members("b"), "b").select("a", "b", "similarity", "lines_a", "lines_b")


def c11_grounded_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = t.load(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return ops.grounded(q, _docs(spark, d).select("doc_id", F.lit(1).alias("page"), "text")).select("quote_id", "doc_id")


def c12_first_heading(spark: SparkSession, d: str) -> DataFrame:
    """Each page with its first short line; the document's source where a page has none."""
    rows = _lines(spark, d)
    short = rows.filter((F.trim("line") != "") & (F.length("line") < 60)).groupBy("doc_id", "page").agg(F.min_by("line", "line_no").alias("heading"))
    pages = rows.select("doc_id", "page").distinct().join(short, ["doc_id", "page"], "left").join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    return pages.select("doc_id", "page", F.coalesce("heading", "source").alias("heading"))


def c13_line_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct line of a document with the first page that holds it."""
    return _lines(spark, d).groupBy("doc_id", F.md5("line").alias("line")).agg(F.min("page").alias("page"))


def f11_most_relevant_line(spark: SparkSession, d: str) -> DataFrame:
    """The line of each document that shares most words of four letters and more with a question; the first wins."""
    asked = F.array(*[F.lit(w) for w in ("tion", "with", "that", "ther", "ment")])
    found = F.regexp_extract_all(F.lower("line"), F.lit("[a-z]{4,}"), F.lit(0))
    rows = _lines(spark, d).withColumn("score", F.size(F.array_intersect(found, asked)))
    return rows.groupBy("doc_id").agg(F.max_by("line_no", F.struct("score", -F.col("line_no"))).alias("line_no"), F.max("score").alias("score"))


def g11_first_of_near_copies(spark: SparkSession, d: str) -> DataFrame:
    """Questions of a conversation of which no earlier kept one is much the same."""
    c = t.load(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("group"), F.col("turn").alias("ord"), F.col("turn").alias("id"), F.array_distinct(fn.content_tokens(F.col("text"))).alias("tokens"))
    return ops.first_kept(rows).select(F.col("group").alias("conv_id"), F.col("id").alias("turn"))


def _speech(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = t.load(spark, d, "events")
    at = (F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))).cast("double")
    spans = e.select(F.col("user_id").alias("key"), at.alias("start"), (at + F.floor("value") * 60).alias("stop"), "event_type")
    return spans, spans.select("key").distinct().withColumn("total", F.lit(2_592_000.0))


def e13_gaps(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(*_speech(spark, d))


def j14_classified_gaps(spark: SparkSession, d: str) -> DataFrame:
    return intervals.classified_gaps(e13_gaps(spark, d))


def e14_kept_segments(spark: SparkSession, d: str) -> DataFrame:
    """What stays when the removed gaps are cut out: the same complement, of the removed."""
    spans, totals = _speech(spark, d)
    return intervals.gaps(j14_classified_gaps(spark, d).filter("removed").select("key", "start", "stop"), totals)


def d19_saved_time(spark: SparkSession, d: str) -> DataFrame:
    g = j14_classified_gaps(spark, d)
    length = F.col("stop") - F.col("start")
    return g.groupBy("reason").agg(F.count("*").alias("gaps"), F.sum(length).alias("seconds"), F.round(F.sum(F.when(F.col("removed"), length).otherwise(0)) / 60, 1).alias("minutes_saved"))


def c14_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last view at or before each purchase of a user."""
    e = t.load(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    right = e.filter("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("view_id"))
    return intervals.as_of(left, right, "view_id").select(F.col("key").alias("user_id"), "id", "view_id")


def c14_range(spark: SparkSession, d: str) -> DataFrame:
    """Clicks that fall into the time of a view."""
    spans, _ = _speech(spark, d)
    points = t.load(spark, d, "events").filter("event_type = 'click'").select(F.col("user_id").alias("key"), (F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))).cast("double").alias("at"), F.col("event_id").alias("id"))
    return intervals.inside(points, spans.filter("event_type = 'view'"), 3600.0).select("id", "start", "stop")


def g5_token_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of intersection, union and difference of each benchmark item's words and those of the next."""
    b = t.load(spark, d, "benchmark").select("item_id", F.array_distinct(fn.tokens(F.col("text"))).alias("a"))
    o = b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    rows = b.join(o, "item_id")
    return rows.select("item_id", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("all"), F.size(F.array_except("a", "b")).alias("only"), F.round(fn.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def a9_units(spark: SparkSession, d: str) -> DataFrame:
    """Documents with page marks before each fourth line, cut into pages again."""
    marked = _lines(spark, d).withColumn("line", F.when(F.col("line_no") % 4 == 0, F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]"), "line")).otherwise(F.col("line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    found = ops.units(marked.groupBy("doc_id").agg(text.alias("text")))
    return found.select("doc_id", "page", F.length("text").alias("size"))


def _sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _normal_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _words_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z][a-z''-]{{2,}}'), lambda w: w NOT IN {_sql_list(STOP)})"


def _tokens_sql(x: str) -> str:
    return f"regexp_extract_all({_normal_sql(x)}, '[a-z0-9][a-z0-9'']*')"


def _content_sql(x: str) -> str:
    names = {w: g.split()[0] for g in words.SYNONYMS for w in g.split() if w.isascii()}
    cases = " ".join(f"WHEN '{w}' THEN '{first}'" for w, first in names.items())
    kept = f"list_filter({_tokens_sql(x)}, lambda w: w NOT IN {_sql_list([*words.STOP, *words.SCAFFOLD])})"
    return f"list_transform({kept}, lambda w: CASE w {cases} ELSE w END)"


def _rules_sql(x: str, rules) -> str:
    whens = []
    for name, phrases in rules[:-1]:
        latin = "|".join(p for p in phrases if p.isascii())
        whens.append(rf"WHEN regexp_matches({x}, '(?:^|[^\p{{L}}\p{{N}}_])(?:{latin})(?:$|[^\p{{L}}\p{{N}}_])') THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE '{rules[-1][0]}' END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FURNITURE_SQL = ", ".join([f"CASE WHEN regexp_matches(coalesce(text, ''), {_quoted(p)}) THEN '{k}' END" for k, p in words.RAW_FURNITURE] + [f"CASE WHEN regexp_matches(plain, {_quoted(p)}) THEN '{k}' END" for k, p in words.FURNITURE])
_LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)), paged AS (SELECT *, CAST(line_no // 4 + 1 AS INTEGER) AS page FROM lines)"
_KEY = r"trim(regexp_replace(regexp_replace(lower(trim(line)), '\s+', ' ', 'g'), '\d+', '#', 'g'))"
_SPANS = """spans AS (SELECT user_id AS key, event_id, event_type, CAST(floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-01') AS DOUBLE) AS start, CAST(floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-01') + floor(value) * 60 AS DOUBLE) AS stop FROM events),
gaps AS (SELECT key, f AS start, u AS stop FROM (
  SELECT key, greatest(0.0::DOUBLE, coalesce(max(stop) OVER (PARTITION BY key ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS f, start AS u FROM spans
  UNION ALL SELECT key, greatest(0.0::DOUBLE, max(stop)), 2592000.0::DOUBLE FROM spans GROUP BY key) WHERE u > f),
classed AS (SELECT *, CASE WHEN start < 20 THEN 'setup-time' WHEN stop - start <= 8 THEN 'meaningful-pause' WHEN stop - start > 40 THEN 'dead-air' ELSE 'waiting' END AS reason FROM gaps WHERE stop - start >= 3)"""
_LINE_TESTS = " OR ".join([f"regexp_matches(s, {_quoted(p)})" for _, p in words.RAW_FURNITURE] + [rf"regexp_matches(s, '{p}')" for p in (r"^[^\p{L}\p{N}_]+$", r"^\d{1,5}\s*$")] + [f"regexp_matches(s, {_quoted(words.FOLIO_LINE)})", "plain = ''", "s = ''"] + [f"regexp_matches({x}, {_quoted(p)})" for x in ("s", "plain") for p in (words.STRONG_LINE, words.STARTING_LINE)] + [f"regexp_matches(s, {_quoted(words.PRESS_LINE)})"])

QUERIES = {
    "a9_units": (a9_units, rf"WITH {_LINES} SELECT doc_id, page, CAST(length(regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g')) AS INTEGER) AS size FROM paged GROUP BY doc_id, page HAVING size > 0"),
    "c8_contained_token_sets": (c8_contained_token_sets, f"""
WITH b AS (SELECT item_id, {_words_sql('text')} AS need FROM benchmark), h AS (SELECT doc_id, {_words_sql('text')} AS have FROM documents)
SELECT item_id, doc_id FROM b, h WHERE len(need) > 0 AND list_has_all(have, list_distinct(need))"""),
    "c10_similar_lines": (c10_similar_lines, None),
    "c11_grounded_quotes": (c11_grounded_quotes, f"""
WITH q AS (SELECT item_id AS quote_id, {_content_sql('text')} AS t FROM benchmark), p AS (SELECT doc_id, array_to_string({_content_sql('text')}, ' ') AS hay FROM documents)
SELECT quote_id, doc_id FROM (SELECT quote_id, array_to_string(t, ' ') AS quote FROM q WHERE len(t) >= 4) JOIN p ON contains(hay, quote) WHERE length(quote) >= 6"""),
    "c12_first_heading": (c12_first_heading, f"""
WITH {_LINES}, s AS (SELECT doc_id, page, arg_min(line, line_no) AS heading FROM paged WHERE trim(line) <> '' AND length(line) < 60 GROUP BY ALL)
SELECT p.doc_id, p.page, coalesce(heading, source) AS heading FROM (SELECT DISTINCT doc_id, page FROM paged) p LEFT JOIN s USING (doc_id, page) JOIN documents d ON d.doc_id = p.doc_id"""),
    "c13_line_pages": (c13_line_pages, f"WITH {_LINES} SELECT doc_id, md5(line) AS line, min(page) AS page FROM paged GROUP BY doc_id, md5(line)"),
    "c14_as_of": (c14_as_of, """
SELECT l.user_id, l.event_id AS id, (SELECT arg_max(r.event_id, (r.ts, r.event_id)) FROM events r WHERE r.event_type = 'view' AND r.user_id = l.user_id AND r.ts <= l.ts) AS view_id FROM events l WHERE l.event_type = 'purchase'"""),
    "c14_range": (c14_range, f"WITH {_SPANS} SELECT p.event_id AS id, s.start, s.stop FROM spans p JOIN spans s ON p.key = s.key AND p.start >= s.start AND p.start < s.stop WHERE p.event_type = 'click' AND s.event_type = 'view'"),
    "d19_saved_time": (d19_saved_time, f"WITH {_SPANS} SELECT reason, count(*) AS gaps, sum(stop - start) AS seconds, round(sum(CASE WHEN reason <> 'meaningful-pause' THEN stop - start ELSE 0 END) / 60, 1) AS minutes_saved FROM classed GROUP BY reason"),
    "d24_term_frequency": (d24_term_frequency, f"SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({_words_sql('text')}) AS token FROM documents) GROUP BY ALL"),
    "d25_mentions": (d25_mentions, "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 AS BIGINT) AS mentions FROM documents"),
    "d26_repeated_lines": (d26_repeated_lines, f"WITH {_LINES} SELECT doc_id, {_KEY} AS key, count(DISTINCT page) AS pages FROM paged WHERE length({_KEY}) >= 2 GROUP BY doc_id, {_KEY} HAVING count(DISTINCT page) >= 2"),
    "e7_timeline": (e7_timeline, f"""
WITH {_LINES}, m AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS last FROM paged)
SELECT doc_id, line_no, page, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY line_no), last) AS end_page FROM m WHERE trim(line) <> '' AND length(line) < 60"""),
    "e9_page_budget": (e9_page_budget, f"""
WITH {_LINES}, p AS (SELECT doc_id, page, length(string_agg(line, chr(10) ORDER BY line_no)) AS size FROM paged GROUP BY ALL),
o AS (SELECT *, least(size, greatest(400, 3000 // count(*) OVER (PARTITION BY doc_id))) AS own FROM p)
SELECT doc_id, page, CAST(greatest(0, least(own, 3000 - coalesce(sum(own) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS kept FROM o"""),
    "e13_gaps": (e13_gaps, f"WITH {_SPANS} SELECT * FROM gaps"),
    "e14_kept_segments": (e14_kept_segments, f"""
WITH {_SPANS}, cut AS (SELECT * FROM classed WHERE reason <> 'meaningful-pause')
SELECT key, f AS start, u AS stop FROM (
  SELECT key, greatest(0.0::DOUBLE, coalesce(max(stop) OVER (PARTITION BY key ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS f, start AS u FROM cut
  UNION ALL SELECT k.key, coalesce(max(stop), 0.0::DOUBLE), 2592000.0::DOUBLE FROM (SELECT DISTINCT key FROM spans) k LEFT JOIN cut USING (key) GROUP BY k.key) WHERE u > f"""),
    "f9_key_bigrams": (f9_key_bigrams, f"""
WITH w AS (SELECT doc_id, {_words_sql('text')} AS t FROM documents), b AS (SELECT doc_id, unnest(list_transform(list_zip(t[1:-2], t[2:]), lambda z: z[1] || ' ' || z[2])) AS term FROM w WHERE len(t) >= 2),
n AS (SELECT doc_id, term, count(*) AS n FROM b GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, array_to_string(list_transform(string_split(term, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, n.term) AS place FROM n QUALIFY place <= 10"""),
    "f10_top_lines": (f10_top_lines, f"""
WITH {_LINES}, r AS (SELECT doc_id, line_no AS ord, {_words_sql('line')} AS t FROM paged WHERE length(line) > 12), w AS (SELECT doc_id, ord, unnest(t) AS token FROM r),
tf AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL), s AS (SELECT doc_id, ord, sum(tf) / count(*) AS score FROM w JOIN tf USING (doc_id, token) GROUP BY ALL)
SELECT doc_id, ord, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0) DESC, ord) AS place FROM r LEFT JOIN s USING (doc_id, ord) QUALIFY place <= 12"""),
    "f11_most_relevant_line": (f11_most_relevant_line, f"""
WITH {_LINES}, s AS (SELECT doc_id, line_no, len(list_intersect(list_distinct(regexp_extract_all(lower(line), '[a-z]{{4,}}')), ['tion', 'with', 'that', 'ther', 'ment'])) AS score FROM paged)
SELECT doc_id, line_no, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) = 1"""),
    "g5_token_sets": (g5_token_sets, f"""
WITH b AS (SELECT item_id, list_distinct({_tokens_sql('text')}) AS t FROM benchmark)
SELECT x.item_id, len(list_intersect(x.t, y.t)) AS common, len(list_distinct(list_concat(x.t, y.t))) AS "all", len(x.t) - len(list_intersect(x.t, y.t)) AS only, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS jaccard FROM b x JOIN b y ON y.item_id = x.item_id + 1"""),
    "g11_first_of_near_copies": (g11_first_of_near_copies, None),
    "h2_normal_text": (h2_normal_text, f"SELECT doc_id, md5({_normal_sql('text')}) AS digest FROM documents"),
    "h3_tokens": (h3_tokens, f"SELECT doc_id, len({_tokens_sql('text')}) AS tokens FROM documents"),
    "h4_content_tokens": (h4_content_tokens, f"SELECT item_id, len(t) AS tokens, array_to_string(t, ' ') AS text FROM (SELECT item_id, {_content_sql('text')} AS t FROM benchmark)"),
    "h10_line_keys": (h10_line_keys, f"WITH {_LINES} SELECT {_KEY} AS key, count(*) AS n FROM paged WHERE length({_KEY}) >= 2 GROUP BY {_KEY}"),
    "h11_bullets": (h11_bullets, None),
    "h15_slugs": (h15_slugs, "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:64] AS slug FROM part"),
    "h28_reading_minutes": (h28_reading_minutes, r"""
SELECT doc_id, n AS words, CAST(greatest(1, floor(n / 200 + 0.5)) AS BIGINT) AS minutes FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\f\r]+')) AS n FROM documents)"""),
    "h29_languages": (h29_languages, "SELECT lang, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'en' END AS found, count(*) AS documents FROM documents GROUP BY ALL"),
    "h30_page_references": (h30_page_references, r"""
WITH c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(text || ' see page ' || turn || ', p. 3, Page 3 and page: 99'), '(?:page|p\.)\s*[:.]?\s*(\d{1,9})', 1), lambda x: CAST(x AS INTEGER)) AS p FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(p, lambda x, i: x BETWEEN 1 AND 50 AND list_position(p, x) = i)[1:10], ',') AS pages FROM c"""),
    "i1_furniture": (i1_furniture, f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{_FURNITURE_SQL}], lambda x: x IS NOT NULL))), ',') AS kinds FROM (SELECT doc_id, text, {_normal_sql('text')} AS plain FROM documents)"),
    "i2_furniture_lines": (i2_furniture_lines, f"WITH {_LINES}, s AS (SELECT doc_id, trim(line) AS s, {_normal_sql('line')} AS plain FROM paged) SELECT doc_id, count(*) AS lines, count(*) FILTER ({_LINE_TESTS}) AS furniture FROM s GROUP BY doc_id"),
    "i3_cleaned_pages": (i3_cleaned_pages, None),
    "i5_headings": (i5_headings, None),
    "i7_knowledge_types": (i7_knowledge_types, """
WITH f(k, frame) AS (VALUES (0, 'x'), (1, 'osmosis is defined as a flow'), (2, 'unlike that'), (3, 'because of heat'), (4, 'types of rock'), (5, 'a = b'), (6, 'such as iron'))
SELECT item_id, k, CASE """ + " ".join(f"WHEN regexp_matches(frame || ' ' || lower(text), {_quoted('(?i)' + p)}) THEN '{n}'" for n, p in words.KNOWLEDGE) + " ELSE 'fact' END AS type FROM benchmark, f"),
    "i8_question_classes": (i8_question_classes, f"""
SELECT conv_id, turn, {_rules_sql('plain', words.SKILLS)} AS skill, {_rules_sql('plain', words.PATTERNS)} AS pattern, regexp_matches(plain, {_quoted(words.TRIVIAL)}) AS trivial
FROM (SELECT conv_id, turn, {_normal_sql('text')} AS plain FROM conversations WHERE role = 'user')"""),
    "j14_classified_gaps": (j14_classified_gaps, f"WITH {_SPANS} SELECT key, start, stop, reason, reason <> 'meaningful-pause' AS removed FROM classed"),
}
