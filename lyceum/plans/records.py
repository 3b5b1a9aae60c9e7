"""Queries on the smaller rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyceum.functions import study as st
from lyceum.functions import text as fn
from lyceum.operators import activity, documents, extracts
from lyceum.operators import records as ops
from lyceum.plans.text import STOP, _normal_sql, _quoted, _words_sql
from lyceum.sources import tables as t


def b18_status_groups(spark: SparkSession, d: str) -> DataFrame:
    """Courses by status (published, draft, archived), and the first four that aren't archived in order of price."""
    status = F.when(F.col("number") % 7 == 0, "archived").when(F.col("number") % 3 == 0, "draft").otherwise("published")
    rows = t.courses(spark, d).withColumn("status", status)
    place = F.row_number().over(Window.partitionBy(F.col("status") == "archived").orderBy(F.desc("price"), "course"))  # a row per course
    return rows.withColumn("place", place).select("course", "status", ((F.col("status") != "archived") & (F.col("place") <= 4)).alias("shown"))


def b19_transcript_search(spark: SparkSession, d: str) -> DataFrame:
    c = t.load(spark, d, "conversations")
    return c.filter(F.contains(F.lower("text"), F.lit("tion"))).select("conv_id", "turn")


def b21_cascading_options(spark: SparkSession, d: str) -> DataFrame:
    """Nations to choose from once a region is chosen, and all of them where none is."""
    n = t.load(spark, d, "nation")
    chosen = t.load(spark, d, "region").select(F.col("r_regionkey").alias("chosen"))
    one = n.join(chosen, F.col("n_regionkey") == F.col("chosen")).select("chosen", "n_name")
    return one.unionByName(n.select(F.lit(None).cast("int").alias("chosen"), "n_name"))


def b22_upcoming(spark: SparkSession, d: str) -> DataFrame:
    """Open exams of today and later."""
    f = t.vault_files(spark, d)
    days = st.days_until(F.col("exam_date"), t.as_of())
    return f.filter((days >= 0) & (F.col("read_count") < F.col("page_count"))).select("file_id", days.alias("days"))


def c6_uncovered_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Brands without a large item in an order of that year."""
    covered = t.load(spark, d, "lineitem").filter("l_quantity >= 50 and l_discount > 0.09").select("l_partkey")
    p = t.load(spark, d, "part")
    brands = p.join(covered, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_brand", "p_size").distinct()
    return p.select("p_brand", "p_size").distinct().join(brands, ["p_brand", "p_size"], "left_anti")


def c9_referenced_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items whose first long word stands in other items as well, by an equi-join on words."""
    b = t.load(spark, d, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w"))
    name = b.filter(F.size("w") > 0).select(F.col("item_id").alias("id"), F.get("w", F.lit(0)).alias("word"))
    have = b.select("item_id", F.explode("w").alias("word"))
    return name.join(have, "word").filter("id <> item_id").groupBy("id").agg(F.count("*").alias("references"))


def c15_plan_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Planned orders with the status of their first line, if they have any."""
    o = t.load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    first = t.load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_linestatus", "l_returnflag"))["l_linestatus"].alias("status"))
    rows = o.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_orderpriority", F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("orders"))


def c18_scoped_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Extension: cosine neighbours within a label, for each vector whose id is divisible by 20."""
    e = t.load(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("q"))
    found = ops.nearest(q, e.select(F.col("vec_id").alias("id"), F.col("label").alias("scope"), F.col("embedding").alias("v")))
    return found.withColumn("similarity", F.round("similarity", 6))


def d3_completion_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Three lessons per course; purchases unmark a lesson, other events mark it."""
    e = t.load(spark, d, "events")
    rows = e.select((F.col("user_id") % 40).alias("student_id"), (F.col("event_id") % 2).alias("course"), (F.floor(F.col("event_id") / 2) % 3).alias("lesson"), (F.col("event_type") != "purchase").alias("done"), F.col("event_id").alias("seq"))
    return ops.completion_stamps(rows, total=3)


def d16_doctor_overview(spark: SparkSession, d: str) -> DataFrame:
    n = t.enrollments(spark, d).groupBy("course").agg(F.count("*").alias("students"))
    rows = t.courses(spark, d).join(n, "course", "left")
    return rows.groupBy("doctor_id").agg(F.count("*").alias("courses"), F.coalesce(F.sum("students"), F.lit(0)).alias("students"), F.count_if(F.col("price") > 1400).alias("premium"))


def d23_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Counters per kind of event; those at zero are left out."""
    counters = t.load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.col("value") > 400).alias("large"), F.count_if(F.col("value") < 0).alias("negative"))
    long = counters.select("event_type", F.explode(F.create_map(F.lit("events"), "events", F.lit("large"), "large", F.lit("negative"), "negative")).alias("counter", "n"))
    return long.filter("n <> 0")


def d30_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    p = t.load(spark, d, "part")
    return p.groupBy("p_size").agg(F.count("*").alias("questions"), F.count_distinct("p_brand").alias("concepts"), F.count_distinct("p_type").alias("targets"), F.count_if(F.col("p_partkey") % 3 == 0).alias("tier_1"))


def d27_leading_types(spark: SparkSession, d: str) -> DataFrame:
    p = t.load(spark, d, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("definition", "process", "fact", "cause_effect")]), (F.col("p_partkey") % 4).cast("int") + 1)
    rows = p.select(F.col("p_size").cast("long").alias("doc_id"), F.col("p_brand").alias("concept"), kind.alias("type"))
    worth = F.when(F.col("type").isin("process", "cause_effect"), 0.95).when(F.col("type") == "definition", 0.9).otherwise(0.4)
    return extracts.leading_type(rows.withColumn("worth", worth))


def f14_ordered_targets(spark: SparkSession, d: str) -> DataFrame:
    p = t.load(spark, d, "part")
    importance = F.round((F.col("p_partkey") * 17 % 101) / 101.0, 4)
    place = F.row_number().over(Window.partitionBy("p_size").orderBy(F.desc(importance), F.col("p_partkey") % 9, F.lower("p_name"), "p_partkey"))
    return p.select("p_partkey", "p_size", place.alias("place"))


def f16_ranked_models(spark: SparkSession, d: str) -> DataFrame:
    """Names such as `model-3.10-pro` by version, as numbers, newest first."""
    n = t.load(spark, d, "nation")
    name = F.concat(F.lit("model-"), (F.col("n_nationkey") % 4 + 1).cast("string"), F.lit("."), (F.col("n_nationkey") * 7 % 13).cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "-pro").otherwise("-mini"))
    rows = n.select(F.concat(name, F.lit("/"), "n_name").alias("name"))
    major, minor = F.regexp_extract("name", r"-(\d+)\.", 1).cast("int"), F.regexp_extract("name", r"\.(\d+)", 1).cast("int")
    return rows.select("name", F.row_number().over(Window.orderBy(F.desc(major), F.desc(minor), F.contains("name", F.lit("-mini")), "name")).alias("place"))  # a row per model


def g1_unions(spark: SparkSession, d: str) -> DataFrame:
    a = t.load(spark, d, "part").select(F.col("p_brand").alias("item"), F.lit("part").alias("origin")).distinct()
    b = t.load(spark, d, "part").filter("p_size > 25").select(F.col("p_brand").alias("item"), F.lit("large").alias("origin")).distinct()
    c = t.load(spark, d, "region").select(F.col("r_name").alias("item"), F.lit("region").alias("origin"))
    first = ops.union_first_wins([a, b, c], "item").select("item", F.col("origin").alias("first"))
    last = ops.union_last_wins([a, b, c], "item").select("item", F.col("origin").alias("last"), "place")
    return first.join(last, "item")


def h6_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each user's turn against the next turn of the conversation."""
    c = t.load(spark, d, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    a, b = fn.normal(F.col("text")), fn.normal(F.col("next"))
    words = lambda x: F.array_distinct(fn.tokens(x))
    score = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(fn.jaccard(words(F.col("text")), words(F.col("next"))))
    return c.select("conv_id", "turn", F.round(score, 6).alias("similarity"), ((a == b) | (score >= 0.6)).alias("duplicate"))


def h8_text_hashes(spark: SparkSession, d: str) -> DataFrame:
    p = t.load(spark, d, "part")
    return p.select("p_partkey", activity.text_hash(F.col("p_name")).alias("hash"))


def h16_name_stems(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("theories", "boxes", "classes", "cells", "mass", "gas", "dishes", "ies", "process")])
    return t.load(spark, d, "region").select("r_regionkey", F.explode(words).alias("word")).select("r_regionkey", "word", ops.name_stem(F.col("word")).alias("stem"))


def h25_period_progress(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user by period, daily and weekly."""
    return activity.period_keys(t.load(spark, d, "events")).groupBy("user_id", "cadence", "key").agg(F.count("*").alias("events"))


def f12_closest_concepts(spark: SparkSession, d: str) -> DataFrame:
    """For each user turn the closest of the names that the benchmark items of its tenth begin with."""
    asked = t.load(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") % 10).alias("scope"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    names = t.load(spark, d, "benchmark").select((F.col("item_id") % 10).alias("scope"), F.col("item_id").alias("ord"), F.substring_index("text", " ", 4).alias("concept"))
    return documents.closest_concepts(asked, names)


def h24_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Week and its label of each day of events."""
    days = t.load(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    start = st.week_start(F.col("day").cast("timestamp"))
    label = F.concat(F.date_format(start, "MMM d"), F.lit(" - "), F.date_format(F.date_add(start, 6), "MMM d"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format(start, "yyyy-MM-dd").alias("week"), label.alias("label"))


def h32_safe_pages(spark: SparkSession, d: str) -> DataFrame:
    f = t.vault_files(spark, d)
    raw = F.array(F.lit("1"), F.lit(" 2 "), F.lit("x"), F.col("page_count").cast("string"), F.lit("1"), (F.col("file_id") % 9).cast("string"), F.lit("-3"), F.lit("99999"))
    return f.select("file_id", F.array_join(ops.safe_pages(raw, F.col("page_count")), ",").alias("pages"))


def h33_json_answers(spark: SparkSession, d: str) -> DataFrame:
    e = t.load(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" - done"))).otherwise("none")
    return e.select("event_id", F.get_json_object(ops.json_object(text), "$.k").alias("k"))


def h35_status_classes(spark: SparkSession, d: str) -> DataFrame:
    e = t.load(spark, d, "events").withColumn("code", F.element_at(F.array(*map(F.lit, (200, 400, 401, 404, 408, 429, 500, 503, 504))), (F.col("event_id") % 9).cast("int") + 1))
    raw = F.when(F.col("event_id") % 4 == 0, "soon").otherwise((F.col("event_id") % 7 - 2).cast("string"))
    return e.groupBy(ops.status_class(F.col("code")).alias("class")).agg(F.count("*").alias("n"), F.sum(ops.retry_after(raw)).alias("wait"))


def h36_uploads(spark: SparkSession, d: str) -> DataFrame:
    f = t.vault_files(spark, d)
    name = F.concat("title", F.when(F.col("file_id") % 3 == 0, ".PDF").when(F.col("file_id") % 3 == 1, ".pdf ").otherwise(".txt"))
    return f.select("file_id", ops.allowed_upload(name, F.col("n_chars") * 1000).alias("allowed"))


def h37_token_digests(spark: SparkSession, d: str) -> DataFrame:
    return t.load(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"))


def i4_teachable_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document has five words of content and four different ones, or is a formula of two."""
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z'-]{2,}"), F.lit(0)), lambda x: ~x.isin(STOP))
    n, distinct = F.size(w), F.size(F.array_distinct(w))
    formula = (distinct >= 2) & F.col("text").rlike("[A-Za-z]") & F.col("text").rlike("[=+*/^]")
    return t.load(spark, d, "documents").select("doc_id", (((n >= 5) & (distinct >= 4)) | formula).alias("teachable"))


def i23_marked_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first five lines of a document that speak of what is hard, counting a few added ones."""
    docs = t.load(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.concat("text", F.lit("\nThis is Difficult.\nexam TIP: read\nStudents struggle.")), "\n")).alias("ord", "sentence"))
    hard = extracts.marked_sentences(docs, extracts.HARD, 5).select("doc_id", "ord", "place", F.lit("hard").alias("kind"))
    return hard.unionByName(extracts.marked_sentences(docs, extracts.TIPS, 6).select("doc_id", "ord", "place", F.lit("tip").alias("kind")))


def j7_first_reasons(spark: SparkSession, d: str) -> DataFrame:
    p = t.load(spark, d, "part")
    gates = [(F.col("p_size") < 5, "too small"), (F.col("p_retailprice") > 1800, "too dear"), (F.length("p_name") < 12, "no name"), (F.col("p_type").rlike("STEEL$"), "of steel")]
    return p.groupBy(F.coalesce(ops.first_reason(gates), F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


def m2_revoke_all(spark: SparkSession, d: str) -> DataFrame:
    """All live tokens of every third user end at once."""
    e = t.load(spark, d, "events")
    live = F.col("event_type") != "error"
    ended = live & (F.col("user_id") % 3 == 0)
    return e.groupBy("user_id").agg(F.count_if(live & ~ended).alias("live"), F.count_if(ended).alias("ended_now"))


_HASH = "SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS hash FROM part"
_PRICES = "CASE WHEN number % 7 = 0 THEN 'archived' WHEN number % 3 = 0 THEN 'draft' ELSE 'published' END"

QUERIES = {
    "b18_status_groups": (b18_status_groups, t.sql("courses", f"SELECT course, {_PRICES} AS status, {_PRICES} <> 'archived' AND row_number() OVER (PARTITION BY {_PRICES} = 'archived' ORDER BY price DESC, course) <= 4 AS shown FROM courses")),
    "b19_transcript_search": (b19_transcript_search, "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'tion')"),
    "b21_cascading_options": (b21_cascading_options, "SELECT n_regionkey AS chosen, n_name FROM nation UNION ALL SELECT NULL, n_name FROM nation"),
    "b22_upcoming": (b22_upcoming, t.sql("vault_files", "SELECT file_id, CAST(ceil((epoch(exam_date) - epoch(TIMESTAMP '2024-01-31')) / 86400) AS BIGINT) AS days FROM vault_files WHERE exam_date >= TIMESTAMP '2024-01-31' AND read_count < page_count")),
    "c6_uncovered_concepts": (c6_uncovered_concepts, "SELECT p_brand, p_size FROM part EXCEPT SELECT p_brand, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50 AND l_discount > 0.09::DOUBLE)"),
    "c9_referenced_elsewhere": (c9_referenced_elsewhere, """
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{6,}') AS w FROM benchmark)
SELECT x.item_id AS id, count(*) AS "references" FROM b x JOIN b y ON x.item_id <> y.item_id AND list_contains(y.w, x.w[1]) WHERE len(x.w) > 0 GROUP BY x.item_id"""),
    "c15_plan_outcomes": (c15_plan_outcomes, """
WITH f AS (SELECT l_orderkey, l_linestatus AS status FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus, l_returnflag) = 1)
SELECT o_orderpriority, coalesce(status, 'none') AS status, count(*) AS orders FROM orders LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY ALL"""),
    "c18_scoped_nearest": (c18_scoped_nearest, """
SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS place
FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 QUALIFY place <= 5"""),
    "d3_completion_stamps": (d3_completion_stamps, """
WITH r AS (SELECT user_id % 40 AS student_id, event_id % 2 AS course, event_id // 2 % 3 AS lesson, event_type <> 'purchase' AS done, event_id AS seq FROM events),
x AS (SELECT *, CAST(done AS INTEGER) - CAST(coalesce(lag(done) OVER (PARTITION BY student_id, course, lesson ORDER BY seq), false) AS INTEGER) AS delta FROM r),
s AS (SELECT *, sum(delta) OVER (PARTITION BY student_id, course ORDER BY seq) AS n FROM x),
o AS (SELECT *, n >= 3 AND NOT coalesce(lag(n) OVER (PARTITION BY student_id, course ORDER BY seq) >= 3, false) AS opens FROM s)
SELECT student_id, course, CAST(arg_max(n, seq) AS BIGINT) AS done, round_even(arg_max(n, seq) / 3 * 100, 0) AS pct, CASE WHEN arg_max(n, seq) >= 3 THEN max(seq) FILTER (opens) END AS completed_seq FROM o GROUP BY student_id, course"""),
    "d16_doctor_overview": (d16_doctor_overview, t.sql("courses enrollments", """
WITH n AS (SELECT course, count(*) AS students FROM enrollments GROUP BY ALL)
SELECT doctor_id, count(*) AS courses, CAST(coalesce(sum(students), 0) AS BIGINT) AS students, count(*) FILTER (price > 1400) AS premium FROM courses LEFT JOIN n USING (course) GROUP BY doctor_id""")),
    "d23_diagnostics": (d23_diagnostics, """
SELECT * FROM (SELECT event_type, 'events' AS counter, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT event_type, 'large', count(*) FILTER (value > 400) FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'negative', count(*) FILTER (value < 0) FROM events GROUP BY event_type) WHERE n <> 0"""),
    "d27_leading_types": (d27_leading_types, """
WITH r AS (SELECT CAST(p_size AS BIGINT) AS doc_id, p_brand AS concept, CASE p_partkey % 4 WHEN 0 THEN 'definition' WHEN 1 THEN 'process' WHEN 2 THEN 'fact' ELSE 'cause_effect' END AS type FROM part),
n AS (SELECT doc_id, concept, type, CASE WHEN type IN ('process', 'cause_effect') THEN 0.95 WHEN type = 'definition' THEN 0.9 ELSE 0.4 END AS worth, count(*) AS n FROM r GROUP BY ALL)
SELECT doc_id, concept, type FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, concept ORDER BY worth DESC, n.n DESC, type DESC) = 1"""),
    "d30_audit_summary": (d30_audit_summary, "SELECT p_size, count(*) AS questions, count(DISTINCT p_brand) AS concepts, count(DISTINCT p_type) AS targets, count(*) FILTER (p_partkey % 3 = 0) AS tier_1 FROM part GROUP BY p_size"),
    "f14_ordered_targets": (f14_ordered_targets, "SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY round((p_partkey * 17 % 101) / 101.0::DOUBLE, 4) DESC, p_partkey % 9, lower(p_name), p_partkey) AS place FROM part"),
    "f16_ranked_models": (f16_ranked_models, """
WITH n AS (SELECT n_nationkey % 4 + 1 AS major, n_nationkey * 7 % 13 AS minor, n_nationkey % 2 = 1 AS mini, n_name FROM nation),
m AS (SELECT *, 'model-' || major || '.' || minor || CASE WHEN mini THEN '-mini' ELSE '-pro' END || '/' || n_name AS name FROM n) SELECT name, row_number() OVER (ORDER BY major DESC, minor DESC, mini, name) AS place FROM m"""),
    "g1_unions": (g1_unions, """
WITH u AS (SELECT DISTINCT p_brand AS item, 'part' AS origin, 0 AS k FROM part UNION ALL SELECT DISTINCT p_brand, 'large', 1 FROM part WHERE p_size > 25 UNION ALL SELECT r_name, 'region', 2 FROM region)
SELECT item, arg_min(origin, k) AS first, arg_max(origin, k) AS last, min(k) AS place FROM u GROUP BY item"""),
    "h6_similarity": (h6_similarity, f"""
WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
s AS (SELECT conv_id, turn, {_normal_sql('text')} AS a, {_normal_sql('nxt')} AS b FROM c WHERE nxt IS NOT NULL),
w AS (SELECT *, list_distinct(regexp_extract_all(a, '[a-z0-9][a-z0-9'']*')) AS x, list_distinct(regexp_extract_all(b, '[a-z0-9][a-z0-9'']*')) AS y FROM s),
j AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN a = b THEN 1.0::DOUBLE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS score FROM w)
SELECT conv_id, turn, round(score, 6) AS similarity, a = b OR score >= 0.6 AS duplicate FROM j"""),
    "h8_text_hashes": (h8_text_hashes, _HASH),
    "h16_name_stems": (h16_name_stems, """
SELECT r_regionkey, word, stem FROM region, (VALUES ('theories', 'theory'), ('boxes', 'box'), ('classes', 'class'), ('cells', 'cell'), ('mass', 'mass'), ('gas', 'gas'), ('dishes', 'dish'), ('ies', 'ies'), ('process', 'process')) v(word, stem)"""),
    "f12_closest_concepts": (f12_closest_concepts, r"""
WITH q AS (SELECT conv_id % 10 AS scope, conv_id * 1000 + turn AS id, unnest(list_distinct(regexp_split_to_array(lower(text), '\W+'))) AS word FROM conversations WHERE role = 'user'),
c AS (SELECT item_id % 10 AS scope, item_id AS ord, array_to_string(string_split(text, ' ')[1:4], ' ') AS concept FROM benchmark), w AS (SELECT scope, ord, concept, unnest(regexp_split_to_array(lower(concept), '\W+')) AS word FROM c),
s AS (SELECT q.scope, q.id, ord, concept, count(*) AS score FROM q JOIN w USING (scope, word) GROUP BY ALL), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY scope, id ORDER BY score DESC, ord) = 1)
SELECT u.conv_id % 10 AS scope, u.conv_id * 1000 + u.turn AS id, b.concept, coalesce(b.score, 0) AS score FROM conversations u LEFT JOIN b ON b.id = u.conv_id * 1000 + u.turn WHERE u.role = 'user'"""),
    "h25_period_progress": (h25_period_progress, """
WITH p AS (SELECT user_id, 'daily' AS cadence, strftime(ts, '%Y-%m-%d') AS key FROM events UNION ALL SELECT user_id, 'weekly', strftime(date_trunc('week', ts), '%Y-%m-%d') FROM events)
SELECT user_id, cadence, key, count(*) AS events FROM p GROUP BY ALL"""),
    "h24_weeks": (h24_weeks, """
WITH x AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), y AS (SELECT day, CAST(date_trunc('week', day) AS DATE) AS w FROM x)
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(w, '%Y-%m-%d') AS week, strftime(w, '%b %-d') || ' - ' || strftime(w + 6, '%b %-d') AS label FROM y"""),
    "h32_safe_pages": (h32_safe_pages, t.sql("vault_files", """
SELECT file_id, array_to_string(list_filter([1, 2, page_count, file_id % 9], lambda p, i: p BETWEEN 1 AND page_count AND list_position([1, 2, page_count, file_id % 9], p) = i), ',') AS pages FROM vault_files""")),
    "h33_json_answers": (h33_json_answers, "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k') END AS k FROM events"),
    "h35_status_classes": (h35_status_classes, """
WITH e AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'request' WHEN 2 THEN 'auth' WHEN 3 THEN 'missing' WHEN 4 THEN 'timeout' WHEN 5 THEN 'rate-limit' WHEN 8 THEN 'timeout' ELSE 'server' END AS class FROM events)
SELECT class, count(*) AS n, CAST(sum(CASE WHEN event_id % 4 <> 0 THEN greatest(0, event_id % 7 - 2) END) AS DOUBLE) AS wait FROM e GROUP BY class"""),
    "h36_uploads": (h36_uploads, t.sql("vault_files", "SELECT file_id, file_id % 3 < 2 AND n_chars > 0 AND n_chars * 1000 <= 15728640 AS allowed FROM vault_files")),
    "h37_token_digests": (h37_token_digests, "SELECT c_custkey, sha256(c_name) AS digest FROM customer"),
    "i4_teachable_documents": (i4_teachable_documents, f"""
WITH w AS (SELECT doc_id, text, {_words_sql('text')} AS t FROM documents)
SELECT doc_id, (len(t) >= 5 AND len(list_distinct(t)) >= 4) OR (len(list_distinct(t)) >= 2 AND regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[=+*/^]')) AS teachable FROM w"""),
    "i23_marked_lines": (i23_marked_lines, f"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS ord, unnest(x) AS s FROM (SELECT doc_id, string_split(text || chr(10) || 'This is Difficult.' || chr(10) || 'exam TIP: read' || chr(10) || 'Students struggle.', chr(10)) AS x FROM documents))
SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place, 'hard' AS kind FROM l WHERE regexp_matches(s, {_quoted(extracts.HARD)}) QUALIFY place <= 5
UNION ALL SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place, 'tip' FROM l WHERE regexp_matches(s, {_quoted(extracts.TIPS)}) QUALIFY place <= 6"""),
    "j7_first_reasons": (j7_first_reasons, """
SELECT CASE WHEN p_size < 5 THEN 'too small' WHEN p_retailprice > 1800 THEN 'too dear' WHEN length(p_name) < 12 THEN 'no name' WHEN p_type LIKE '%STEEL' THEN 'of steel' ELSE 'passed' END AS reason, count(*) AS n FROM part GROUP BY ALL"""),
    "m2_revoke_all": (m2_revoke_all, "SELECT user_id, count(*) FILTER (event_type <> 'error' AND user_id % 3 <> 0) AS live, count(*) FILTER (event_type <> 'error' AND user_id % 3 = 0) AS ended_now FROM events GROUP BY user_id"),
}
