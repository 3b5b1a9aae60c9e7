"""The benchmark tables seen as the tables of a learning platform.

students are suppliers; a course is a brand of parts; lesson k of a course is line number k; a line item of a
supplier and a brand is an enrolment and progress in a lesson; events are the ledger, attempts and operations
of users; documents are the files of a vault. AS_OF stands for now everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student_id, full_name, nation_id."""
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("student_id"), F.col("s_name").alias("full_name"), F.col("s_nationkey").alias("nation_id"))


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """course, doctor_id (0 to 4, null for 4), price, parts (published from 70 parts a thousandth on is left to callers)."""
    part = load(spark, sf_dir, "part")
    number = F.split("p_brand", "#")[1].cast("int")
    rows = part.groupBy(F.col("p_brand").alias("course")).agg(F.avg("p_retailprice").alias("price"), F.count("*").alias("parts"), F.max(number).alias("number"))
    doctor = F.when(F.col("number") % 5 < 4, F.col("number") % 5)
    return rows.select("course", doctor.alias("doctor_id"), F.round("price", 6).alias("price"), "parts", "number")


def lesson_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: student_id, course, lesson, status, ts. The part table goes along only with its brand."""
    line = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_linestatus", "l_shipdate")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    found = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return found.select(
        F.col("l_suppkey").alias("student_id"), F.col("p_brand").alias("course"), F.col("l_linenumber").alias("lesson"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("ts")
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student_id, course, lesson, completed, completed_at."""
    rows = lesson_rows(spark, sf_dir)
    return rows.groupBy("student_id", "course", "lesson").agg(F.bool_or(F.col("status") == "F").alias("completed"), F.max("ts").alias("completed_at"))


def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """course, lesson, module (1 for the first three lessons, else 2)."""
    rows = lesson_rows(spark, sf_dir).select("course", "lesson").distinct()
    return rows.withColumn("module", F.when(F.col("lesson") <= 3, 1).otherwise(2))


def enrollments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student_id, course, enrolled_at."""
    return lesson_rows(spark, sf_dir).groupBy("student_id", "course").agg(F.min("ts").alias("enrolled_at"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, user_id, source, amount (purchases are spending), key, ts."""
    e = load(spark, sf_dir, "events")
    amount = F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value"))
    return e.select(F.col("event_id").alias("tx_id"), "user_id", F.col("event_type").alias("source"), amount.alias("amount"), F.get_json_object("props", "$.k").alias("key"), "ts")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, attempt_id, kind (quiz, exam), score, taken_at: views are quizzes and sign-ups are exams of the file that has the user's number."""
    e = load(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "signup"))
    kind = F.when(F.col("event_type") == "view", "quiz").otherwise("exam")
    return e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("attempt_id"), kind.alias("kind"), F.least(F.lit(100.0), F.col("value")).alias("score"), F.col("ts").alias("taken_at"))


def vault_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files: documents with reading state, dates and flags that follow from their ids, and difficulty from labels."""
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = docs.join(labels, docs["doc_id"] == F.col("l_id"), "left")
    i = F.col("doc_id")
    pages = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    read = F.when(i % 5 == 4, F.lit(0)).otherwise(F.floor(pages / (i % 4 + 1))).cast("int")
    day = lambda days: (F.unix_timestamp(as_of()) + days * 86400).cast("timestamp")
    difficulty = F.when(F.col("toxic") == 1, "hard").when(F.col("quality") == 1, "medium").when(F.col("quality") == 0, "easy")
    return d.select(
        i.alias("file_id"),
        (i % 50).alias("owner_id"),
        F.concat(F.lit("File "), i.cast("string")).alias("title"),
        F.col("source").alias("course"),
        F.col("lang"),
        F.col("n_chars"),
        pages.alias("page_count"),
        read.alias("read_count"),
        F.when(i % 7 != 0, day(-(i % 12))).alias("last_viewed_at"),
        F.when(i % 3 != 0, day(i % 21 - 3)).alias("exam_date"),
        day(-(i % 30)).alias("uploaded_at"),
        difficulty.alias("difficulty"),
        (i % 10 == 0).alias("favorite"),
        (i % 15 == 0).alias("pinned"),
    )


#: The same views in DuckDB SQL, for the counterparts.
SQL = {
    "courses": """
SELECT p_brand AS course, CASE WHEN num % 5 < 4 THEN num % 5 END AS doctor_id, round(avg_price, 6) AS price, parts, num AS number FROM (
  SELECT p_brand, avg(p_retailprice) AS avg_price, count(*) AS parts, max(CAST(split_part(p_brand, '#', 2) AS INTEGER)) AS num FROM part GROUP BY p_brand)""",
    "lesson_rows": """
SELECT l_suppkey AS student_id, p_brand AS course, l_linenumber AS lesson, l_linestatus AS status, l_shipdate AS ts
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "progress": """
SELECT student_id, course, lesson, bool_or(status = 'F') AS completed, max(ts) AS completed_at FROM lesson_rows GROUP BY ALL""",
    "lessons": """
SELECT DISTINCT course, lesson, CASE WHEN lesson <= 3 THEN 1 ELSE 2 END AS module FROM lesson_rows""",
    "enrollments": """
SELECT student_id, course, min(ts) AS enrolled_at FROM lesson_rows GROUP BY ALL""",
    "students": """
SELECT s_suppkey AS student_id, s_name AS full_name, s_nationkey AS nation_id FROM supplier""",
    "ledger": """
SELECT event_id AS tx_id, user_id, event_type AS source, CASE WHEN event_type = 'purchase' THEN -value ELSE value END AS amount,
       json_extract_string(props, '$.k') AS key, ts FROM events""",
    "attempts": """
SELECT user_id AS file_id, event_id AS attempt_id, CASE WHEN event_type = 'view' THEN 'quiz' ELSE 'exam' END AS kind,
       least(100.0::DOUBLE, value) AS score, ts AS taken_at FROM events WHERE event_type IN ('view', 'signup')""",
    "vault_files": """
SELECT d.doc_id AS file_id, d.doc_id % 50 AS owner_id, 'File ' || d.doc_id AS title, d.source AS course, d.lang, d.n_chars,
       len(string_split(coalesce(d.text, ''), chr(10))) AS page_count,
       CAST(CASE WHEN d.doc_id % 5 = 4 THEN 0 ELSE len(string_split(coalesce(d.text, ''), chr(10))) // (d.doc_id % 4 + 1) END AS INTEGER) AS read_count,
       CASE WHEN d.doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-31' - to_days(CAST(d.doc_id % 12 AS INTEGER)) END AS last_viewed_at,
       CASE WHEN d.doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-31' + to_days(CAST(d.doc_id % 21 - 3 AS INTEGER)) END AS exam_date,
       TIMESTAMP '2024-01-31' - to_days(CAST(d.doc_id % 30 AS INTEGER)) AS uploaded_at,
       CASE WHEN l.toxic = 1 THEN 'hard' WHEN l.quality = 1 THEN 'medium' WHEN l.quality = 0 THEN 'easy' END AS difficulty,
       d.doc_id % 10 = 0 AS favorite, d.doc_id % 15 = 0 AS pinned
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
}
_NEEDS = {"progress": ["lesson_rows"], "lessons": ["lesson_rows"], "enrollments": ["lesson_rows"]}


def sql(views: str, query: str) -> str:
    """query behind a WITH clause of the views named (separated by blanks) and those that they need."""
    named: list[str] = []
    for view in views.split():
        for one in [*_NEEDS.get(view, []), view]:
            if one not in named:
                named.append(one)
    clauses = [f"{v} AS ({SQL[v].strip()})" for v in named]
    head, rest = ("WITH RECURSIVE ", query.strip()[15:]) if query.strip().startswith("WITH RECURSIVE ") else ("WITH ", query.strip())
    if rest.startswith("WITH "):
        return f"{head}{', '.join(clauses)}, {rest[5:]}"
    return f"{head}{', '.join(clauses)}{', ' if head != 'WITH ' else ' '}{rest}" if clauses else query.strip()
