"""Courses, rosters, enrolments, calendars, notifications, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyceum.operators import courses as ops
from lyceum.sources import tables as t


def s1_roster_progress(spark: SparkSession, d: str) -> DataFrame:
    return ops.roster(t.students(spark, d), t.enrollments(spark, d), t.lessons(spark, d), t.progress(spark, d))


def b1_catalogue_of_doctor(spark: SparkSession, d: str) -> DataFrame:
    return ops.catalogue(t.courses(spark, d), doctor_id=1, published=F.col("number") % 10 != 0).select("course", "doctor_id", "price")


def b3_course_outline(spark: SparkSession, d: str) -> DataFrame:
    return ops.outline(t.lessons(spark, d), t.progress(spark, d), student_id=1).select("course", "module", "lesson", "completed", ops.initials(F.regexp_replace("course", "#", " ")).alias("initials"))


def b4_calendar_order(spark: SparkSession, d: str) -> DataFrame:
    o = t.load(spark, d, "orders")
    time = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":00")))
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("event"), date.alias("date"), time.alias("time"))
    place = Window.partitionBy("owner").orderBy("date", F.col("time").asc_nulls_last(), "event")
    return rows.withColumn("place", F.row_number().over(place))


def b5_files_of_owner(spark: SparkSession, d: str) -> DataFrame:
    """Files of an owner, the latest first; nulls first, as descending order has them."""
    place = Window.partitionBy("owner_id").orderBy(F.col("last_viewed_at").desc_nulls_first(), "file_id")
    return t.vault_files(spark, d).select("owner_id", "file_id", F.row_number().over(place).alias("place"))


def b6_partial_update(spark: SparkSession, d: str) -> DataFrame:
    files = t.vault_files(spark, d).select("file_id", "title", "course")
    i = F.col("file_id")
    patches = files.filter(i % 4 == 0).select("file_id", F.when(i % 8 == 0, F.array(F.lit("title"))).otherwise(F.array(F.lit("course"))).alias("present"), F.concat(F.lit("New "), F.col("title")).alias("title"), F.lit(None).cast("string").alias("course"))
    return ops.patched(files, patches, "file_id", ["title", "course"])


def b7_append_lessons(spark: SparkSession, d: str) -> DataFrame:
    old = t.lessons(spark, d).filter("lesson <> 2").withColumn("order_index", (F.col("lesson") - 1).cast("long"))
    new = t.lessons(spark, d).filter("lesson <= 2").withColumn("lesson", F.col("lesson") + 100)
    return ops.append_with_ordinal(old, new, "course")


def b8_reorder_lessons(spark: SparkSession, d: str) -> DataFrame:
    return ops.reorder(t.lessons(spark, d).withColumn("order_index", F.col("lesson").cast("long") - 1), [7, 5, 99, 1]).select("course", "lesson", F.col("order_index").cast("long").alias("order_index"))


def b9_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = t.courses(spark, d).filter(F.col("number") % 2 == 0).select("course", F.lit(2).alias("module"))
    return ops.cascade(t.lessons(spark, d), gone, ["course", "module"])


def _operations(spark: SparkSession, d: str) -> DataFrame:
    e = t.load(spark, d, "events").filter(F.col("event_type").isin("signup", "error", "click"))
    op = F.when(F.col("event_type") == "signup", "enroll").when(F.col("event_type") == "error", "unenroll").otherwise("toggle")
    return e.select((F.col("event_id") % 25).alias("course"), F.col("user_id").alias("student_id"), op.alias("op"), F.col("event_id").alias("seq"))


def b10_enrollment_log(spark: SparkSession, d: str) -> DataFrame:
    return ops.enrollment_log(_operations(spark, d))


def b13_mark_read(spark: SparkSession, d: str) -> DataFrame:
    e = t.load(spark, d, "events")
    unread = (F.col("event_type") == "error") & ~((F.col("user_id") % 3 == 0) & (F.col("ts") < "2024-01-15"))
    return e.groupBy("user_id").agg(F.count_if(unread).alias("unread"), F.count("*").alias("all"))


def b20_reward_catalogue(spark: SparkSession, d: str) -> DataFrame:
    mine = t.enrollments(spark, d).filter("student_id = 1").select("course")
    c = t.courses(spark, d).filter((F.col("number") % 3 == 0) & F.col("price").isNotNull()).join(mine, "course", "left_anti")
    fixed = t.load(spark, d, "region").select(F.concat(F.lit("reward "), F.col("r_name")).alias("item"), ((F.col("r_regionkey") + 1) * 100).cast("double").alias("cost"))
    return c.select(F.col("course").alias("item"), F.round(F.col("price") * 10, 4).alias("cost")).unionByName(fixed)


def b24_redeem(spark: SparkSession, d: str) -> DataFrame:
    rows = t.ledger(spark, d)
    kind = F.when(F.col("amount") < 0, "redeem").otherwise("earn")
    return ops.redeem(rows.select("user_id", F.col("tx_id").alias("seq"), kind.alias("kind"), F.abs("amount").alias("amount")))


def c2_enrolled_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Users with enrolments with courses, of the doctors asked for."""
    wanted = t.courses(spark, d).filter("doctor_id in (0, 2)").select("course", "doctor_id")
    rows = t.enrollments(spark, d).join(wanted, "course").join(t.students(spark, d), "student_id")
    return rows.select("student_id", "full_name", "course", "doctor_id", F.date_format("enrolled_at", "yyyy-MM-dd").alias("enrolled_on"))


def c4_notes_of_owned_files(spark: SparkSession, d: str) -> DataFrame:
    """Notes (turns of conversations) joined to the file that they belong to; the owner is the file's."""
    notes = t.load(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), "turn", "role", F.length("text").cast("long").alias("size"))
    return notes.join(t.vault_files(spark, d).filter("owner_id < 25").select("file_id", "owner_id", "title"), "file_id")


def c7_awards_once(spark: SparkSession, d: str) -> DataFrame:
    """Of entries with the same source and key the first counts; entries without a key always count."""
    rows = t.ledger(spark, d).select("user_id", "tx_id", "source", "amount", F.when(F.col("tx_id") % 11 != 0, F.col("key")).alias("key"))
    first = rows.filter("key is not null").groupBy("user_id", "source", "key").agg(F.min("tx_id").alias("tx_id"))
    kept = rows.join(first.select("tx_id"), "tx_id", "left_semi").unionByName(rows.filter("key is null"))
    return kept.groupBy("user_id", "source").agg(F.count("*").alias("awards"), F.round(F.sum("amount"), 4).alias("total"))


def c16_friends(spark: SparkSession, d: str) -> DataFrame:
    """How many other students share a nation: counted by group, not by pairs."""
    n = t.students(spark, d).groupBy("nation_id").agg(F.count("*").alias("n"))
    return t.students(spark, d).join(n, "nation_id").select("student_id", "nation_id", (F.col("n") - 1).alias("friends"))


def c17_course_doctor(spark: SparkSession, d: str) -> DataFrame:
    doctors = t.load(spark, d, "region").select(F.col("r_regionkey").alias("doctor_id"), F.col("r_name").alias("doctor"))
    return t.courses(spark, d).join(doctors, "doctor_id", "left").select("course", F.coalesce("doctor", F.lit("Unassigned")).alias("doctor"))


def d1_scalar_counts(spark: SparkSession, d: str) -> DataFrame:
    e = t.load(spark, d, "events")
    return e.agg(F.count_if(F.col("event_type") == "error").alias("unread"), F.count("*").alias("notifications"), F.coalesce(F.sum(F.when(F.col("user_id") < 0, 1)), F.lit(0)).alias("none"))


def d4_completion_rate(spark: SparkSession, d: str) -> DataFrame:
    return ops.completion_rate(t.enrollments(spark, d), t.lessons(spark, d), t.progress(spark, d))


def d6_roster_nested(spark: SparkSession, d: str) -> DataFrame:
    """One row per student with the courses and their percentages in order."""
    rows = s1_roster_progress(spark, d)
    one = F.transform(F.array_sort(F.collect_list(F.struct("course", "pct"))), lambda c: F.concat(c["course"], F.lit("="), c["pct"].cast("int").cast("string")))
    return rows.groupBy("student_id", "full_name").agg(F.array_join(one, ";").alias("courses"))


def d7_course_state(spark: SparkSession, d: str) -> DataFrame:
    return ops.course_state(t.enrollments(spark, d), t.lessons(spark, d), t.progress(spark, d)).withColumn("completed_at", F.date_format("completed_at", "yyyy-MM-dd"))


def d15_revenue(spark: SparkSession, d: str) -> DataFrame:
    paid = t.courses(spark, d).filter("price > 1400").select("course", "doctor_id", "price")
    n = t.enrollments(spark, d).groupBy("course").agg(F.count("*").alias("students"))
    rows = paid.join(n, "course", "left").withColumn("students", F.coalesce("students", F.lit(0)))
    return rows.groupBy("doctor_id").agg(F.round(F.sum(F.col("price") * F.col("students")), 2).alias("revenue"), F.sum("students").alias("students"), F.floor(F.avg("price") + 0.5).alias("average_price"), F.count("*").alias("courses"))


def d17_status_bands(spark: SparkSession, d: str) -> DataFrame:
    mean = s1_roster_progress(spark, d).groupBy("student_id").agg(F.avg("pct").alias("mean"))
    band = F.when(F.col("mean") > 80, "on-track").when(F.col("mean") > 50, "at-risk").otherwise("behind")
    return mean.groupBy(band.alias("band")).agg(F.count("*").alias("students"), F.round(F.avg("mean"), 4).alias("mean"))


def d21_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tags in order: a file's tags are its course, language and difficulty."""
    tags = t.vault_files(spark, d).select(F.explode(F.array_compact(F.array("course", "lang", "difficulty"))).alias("tag")).distinct()
    return tags.withColumn("place", F.row_number().over(Window.orderBy("tag")))  # a row per distinct value


def d33_lesson_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = t.enrollments(spark, d).select("student_id", "course").join(t.lessons(spark, d).groupBy("course", "module").agg(F.count("*").alias("n")).groupBy("course").agg(F.sum("n").alias("total"), F.count("*").alias("modules")), "course")
    done = t.progress(spark, d).groupBy("student_id", "course").agg(F.count_if("completed").alias("completed"))
    rows = rows.join(done, ["student_id", "course"], "left").withColumn("completed", F.coalesce("completed", F.lit(0)))
    return rows.groupBy("student_id").agg(F.sum("total").alias("total"), F.sum("completed").alias("completed"), (F.sum("total") - F.sum("completed")).alias("remaining"))


def e16_next_lesson(spark: SparkSession, d: str) -> DataFrame:
    return ops.next_lesson(t.lessons(spark, d), t.progress(spark, d), t.enrollments(spark, d))


def e17_study_plan(spark: SparkSession, d: str) -> DataFrame:
    return ops.study_plan(t.lessons(spark, d), t.progress(spark, d), t.enrollments(spark, d))


def b17_course_shelves(spark: SparkSession, d: str) -> DataFrame:
    rows = s1_roster_progress(spark, d).withColumn("saved", (F.col("student_id") + F.length("course")) % 3 == 0)
    return ops.shelves(rows).groupBy("course", "shelf").agg(F.count("*").alias("students"))


def f1_latest_notifications(spark: SparkSession, d: str) -> DataFrame:
    rows = t.load(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return rows.select("event_id", "user_id", "event_type")


def f5_nearest_events(spark: SparkSession, d: str) -> DataFrame:
    """The five events of each owner that come next; an event without a time counts at the end of its day."""
    rows = b4_calendar_order(spark, d).drop("place")
    at = F.to_timestamp(F.concat("date", F.lit(" "), F.coalesce(F.concat("time", F.lit(":00")), F.lit("23:59:59"))))
    rows = rows.withColumn("at", at).filter(F.col("at") >= F.lit("1998-01-01").cast("timestamp"))
    first = Window.partitionBy("owner").orderBy("at", "event")
    rows = rows.withColumn("place", F.row_number().over(first)).filter("place <= 5")
    return rows.select("owner", "event", "place", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("starts"))


def m1_token_families(spark: SparkSession, d: str) -> DataFrame:
    """Refresh tokens (events) in families (user and day): a token that was revoked and used again revokes the live ones."""
    e = t.load(spark, d, "events")
    rows = e.select("event_id", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("family"), (F.col("event_type") == "error").alias("revoked"), (F.col("event_id") % 2 == 0).alias("used"))
    reused = rows.filter("revoked and used").select("family").distinct().withColumn("reused", F.lit(True))
    found = rows.join(reused, "family", "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
    return found.groupBy("family").agg(F.count("*").alias("tokens"), F.count_if(F.col("revoked") | F.col("reused")).alias("revoked"), F.count_if(F.col("reused") & ~F.col("revoked")).alias("revoked_now"))


def m4_lookup_by_mail(spark: SparkSession, d: str) -> DataFrame:
    """Point lookup: the argument is lower-cased, the column is not, so mixed-case rows aren't met."""
    mail = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name")), F.lit("@mail.test"))
    rows = t.load(spark, d, "customer").select("c_custkey", mail.alias("mail"))
    return rows.filter(F.col("mail") == F.lower(F.lit("Customer#000000042@mail.test"))).select("c_custkey", "mail")


_ROSTER = """
WITH done AS (SELECT student_id, course, count(*) FILTER (completed) AS done FROM progress GROUP BY ALL),
totals AS (SELECT course, count(*) AS total FROM lessons GROUP BY ALL),
roster AS (SELECT e.student_id, s.full_name, e.course, coalesce(d.done, 0) AS done, coalesce(x.total, 0) AS total,
  CASE WHEN x.total > 0 THEN round_even(coalesce(d.done, 0) / x.total * 100, 0) ELSE 0.0::DOUBLE END AS pct
  FROM enrollments e JOIN students s USING (student_id) LEFT JOIN done d USING (student_id, course) LEFT JOIN totals x USING (course))
"""
_R = "students enrollments lessons progress"
_CAL = """SELECT o_custkey AS owner, o_orderkey AS event, strftime(o_orderdate, '%Y-%m-%d') AS date,
  CASE WHEN o_orderkey % 3 <> 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00' END AS time FROM orders"""

QUERIES = {
    "s1_roster_progress": (s1_roster_progress, t.sql(_R, _ROSTER + "SELECT * FROM roster")),
    "b1_catalogue_of_doctor": (b1_catalogue_of_doctor, t.sql("courses", "SELECT course, doctor_id, price FROM courses WHERE doctor_id = 1 AND number % 10 <> 0")),
    "b3_course_outline": (b3_course_outline, t.sql("lessons progress", """
SELECT l.course, module, l.lesson, coalesce(completed, false) AS completed, upper(left(l.course, 1) || substr(split_part(l.course, '#', 2), 1, 1)) AS initials
FROM lessons l LEFT JOIN progress p ON p.student_id = 1 AND p.course = l.course AND p.lesson = l.lesson""")),
    "b4_calendar_order": (b4_calendar_order, f"SELECT *, row_number() OVER (PARTITION BY owner ORDER BY date, time NULLS LAST, event) AS place FROM ({_CAL})"),
    "b5_files_of_owner": (b5_files_of_owner, t.sql("vault_files", "SELECT owner_id, file_id, row_number() OVER (PARTITION BY owner_id ORDER BY last_viewed_at DESC NULLS FIRST, file_id) AS place FROM vault_files")),
    "b6_partial_update": (b6_partial_update, t.sql("vault_files", """
SELECT file_id, CASE WHEN file_id % 8 = 0 THEN 'New ' || title ELSE title END AS title, CASE WHEN file_id % 8 = 4 THEN NULL ELSE course END AS course FROM vault_files""")),
    "b7_append_lessons": (b7_append_lessons, t.sql("lessons", """
WITH old AS (SELECT course, lesson, module, CAST(lesson - 1 AS BIGINT) AS order_index FROM lessons WHERE lesson <> 2),
n AS (SELECT course, count(*) AS n FROM old GROUP BY ALL)
SELECT * FROM old UNION ALL SELECT l.course, lesson + 100, module, coalesce(n, 0) + row_number() OVER (PARTITION BY l.course ORDER BY lesson) - 1
FROM lessons l LEFT JOIN n USING (course) WHERE lesson <= 2""")),
    "b8_reorder_lessons": (b8_reorder_lessons, t.sql("lessons", "SELECT course, lesson, CAST(CASE lesson WHEN 7 THEN 0 WHEN 5 THEN 1 WHEN 1 THEN 3 ELSE lesson - 1 END AS BIGINT) AS order_index FROM lessons")),
    "b9_cascade_delete": (b9_cascade_delete, t.sql("lessons courses", "SELECT l.* FROM lessons l JOIN courses c USING (course) WHERE NOT (number % 2 = 0 AND module = 2)")),
    "b10_enrollment_log": (b10_enrollment_log, """
WITH ops AS (SELECT event_id % 25 AS course, user_id AS student_id, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'enroll' WHEN 'error' THEN 'unenroll' ELSE 'toggle' END AS op FROM events WHERE event_type IN ('signup', 'error', 'click')),
steps AS (SELECT *, lag(op) OVER (PARTITION BY course, student_id ORDER BY seq) AS before FROM ops),
moves AS (SELECT *, CASE WHEN op = 'enroll' AND (before IS NULL OR before = 'unenroll') THEN 1 WHEN op = 'unenroll' THEN -1 ELSE 0 END AS delta,
  sum(CASE WHEN op = 'unenroll' THEN 1 ELSE 0 END) OVER (PARTITION BY course, student_id ORDER BY seq) AS life FROM steps),
sums AS (SELECT *, sum(delta) OVER (PARTITION BY course ORDER BY seq) AS run FROM moves),
counter AS (SELECT course, CAST(arg_max(run, seq) - least(0, min(run)) AS BIGINT) AS students_count FROM sums GROUP BY ALL),
lives AS (SELECT course, student_id, life, count(*) FILTER (op = 'toggle') AS toggles, arg_max(op, seq) AS last_op FROM moves GROUP BY ALL),
last AS (SELECT course, student_id, arg_max(toggles, life) AS toggles, arg_max(last_op, life) AS last_op FROM lives GROUP BY ALL)
SELECT course, count(*) FILTER (last_op <> 'unenroll') AS members, count(*) FILTER (last_op <> 'unenroll' AND toggles % 2 = 1) AS saved, any_value(students_count) AS students_count
FROM last JOIN counter USING (course) GROUP BY course"""),
    "b13_mark_read": (b13_mark_read, """SELECT user_id, count(*) FILTER (event_type = 'error' AND NOT (user_id % 3 = 0 AND ts < TIMESTAMP '2024-01-15')) AS unread, count(*) AS "all" FROM events GROUP BY user_id"""),
    "b17_course_shelves": (b17_course_shelves, t.sql(_R, _ROSTER + """
SELECT course, shelf, count(*) AS students FROM (
  SELECT course, CASE WHEN pct >= 100 THEN 'completed' WHEN pct > 0 THEN 'in-progress' ELSE 'not-started' END AS shelf FROM roster
  UNION ALL SELECT course, 'saved' FROM roster WHERE (student_id + length(course)) % 3 = 0) GROUP BY ALL""")),
    "b20_reward_catalogue": (b20_reward_catalogue, t.sql("courses enrollments", """
SELECT course AS item, round(price * 10, 4) AS cost FROM courses WHERE number % 3 = 0 AND price IS NOT NULL AND course NOT IN (SELECT course FROM enrollments WHERE student_id = 1)
UNION ALL SELECT 'reward ' || r_name, CAST((r_regionkey + 1) * 100 AS DOUBLE) FROM region""")),
    "b24_redeem": (b24_redeem, None),
    "c2_enrolled_by_doctor": (c2_enrolled_by_region, t.sql("courses enrollments students", """
SELECT student_id, full_name, course, doctor_id, strftime(enrolled_at, '%Y-%m-%d') AS enrolled_on FROM enrollments JOIN courses USING (course) JOIN students USING (student_id) WHERE doctor_id IN (0, 2)""")),
    "c4_notes_of_owned_files": (c4_notes_of_owned_files, t.sql("vault_files", """
SELECT conv_id AS file_id, turn, role, CAST(length(text) AS BIGINT) AS size, owner_id, title FROM conversations JOIN vault_files ON conv_id = file_id WHERE owner_id < 25""")),
    "c7_awards_once": (c7_awards_once, t.sql("ledger", """
WITH rows AS (SELECT user_id, tx_id, source, amount, CASE WHEN tx_id % 11 <> 0 THEN key END AS key FROM ledger)
SELECT user_id, source, count(*) AS awards, round(sum(amount), 4) AS total FROM (
  SELECT * FROM rows WHERE key IS NULL UNION ALL
  SELECT * FROM rows WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, source, key ORDER BY tx_id) = 1) GROUP BY ALL""")),
    "c16_friends": (c16_friends, t.sql("students", "SELECT student_id, nation_id, count(*) OVER (PARTITION BY nation_id) - 1 AS friends FROM students")),
    "c17_course_doctor": (c17_course_doctor, t.sql("courses", "SELECT course, coalesce(r_name, 'Unassigned') AS doctor FROM courses LEFT JOIN region ON doctor_id = r_regionkey")),
    "d1_scalar_counts": (d1_scalar_counts, "SELECT count(*) FILTER (event_type = 'error') AS unread, count(*) AS notifications, CAST(coalesce(sum(CASE WHEN user_id < 0 THEN 1 END), 0) AS BIGINT) AS none FROM events"),
    "d4_completion_rate": (d4_completion_rate, t.sql("enrollments lessons progress", """
WITH totals AS (SELECT course, count(*) AS total FROM lessons GROUP BY ALL),
en AS (SELECT course, count(DISTINCT student_id) AS enrolled FROM enrollments GROUP BY ALL),
fin AS (SELECT course, count(*) AS finishers FROM (SELECT course, student_id, count(*) AS n FROM progress WHERE completed GROUP BY ALL) JOIN totals USING (course) WHERE n = total GROUP BY ALL)
SELECT course, coalesce(enrolled, 0) AS enrolled, coalesce(finishers, 0) AS finishers,
  CASE WHEN enrolled > 0 AND total > 0 THEN round_even(coalesce(finishers, 0) / enrolled * 100, 1) END AS rate
FROM totals LEFT JOIN en USING (course) LEFT JOIN fin USING (course)""")),
    "d6_roster_nested": (d6_roster_nested, t.sql(_R, _ROSTER + "SELECT student_id, full_name, string_agg(course || '=' || CAST(pct AS INTEGER), ';' ORDER BY course) AS courses FROM roster GROUP BY ALL")),
    "d7_course_state": (d7_course_state, t.sql("enrollments lessons progress", """
WITH totals AS (SELECT course, count(*) AS total FROM lessons GROUP BY ALL),
done AS (SELECT student_id, course, count(*) AS n, string_agg(CAST(lesson AS VARCHAR), ',' ORDER BY lesson) AS lessons, max(completed_at) AS last FROM progress WHERE completed GROUP BY ALL)
SELECT student_id, course, coalesce(lessons, '') AS lessons, CASE WHEN total > 0 THEN round_even(coalesce(n, 0) / total * 100, 0) ELSE 0.0::DOUBLE END AS pct,
  CASE WHEN n = total THEN strftime(last, '%Y-%m-%d') END AS completed_at FROM enrollments JOIN totals USING (course) LEFT JOIN done USING (student_id, course)""")),
    "d15_revenue": (d15_revenue, t.sql("courses enrollments", """
WITH n AS (SELECT course, count(*) AS students FROM enrollments GROUP BY ALL)
SELECT doctor_id, round(sum(price * coalesce(students, 0)), 2) AS revenue, CAST(sum(coalesce(students, 0)) AS BIGINT) AS students, CAST(floor(avg(price) + 0.5) AS BIGINT) AS average_price, count(*) AS courses
FROM courses LEFT JOIN n USING (course) WHERE price > 1400 GROUP BY doctor_id""")),
    "d17_status_bands": (d17_status_bands, t.sql(_R, _ROSTER + """
SELECT CASE WHEN mean > 80 THEN 'on-track' WHEN mean > 50 THEN 'at-risk' ELSE 'behind' END AS band, count(*) AS students, round(avg(mean), 4) AS mean
FROM (SELECT student_id, avg(pct) AS mean FROM roster GROUP BY ALL) GROUP BY ALL""")),
    "d21_distinct_values": (d21_distinct_values, t.sql("vault_files", """
SELECT tag, row_number() OVER (ORDER BY tag) AS place FROM (SELECT course AS tag FROM vault_files UNION SELECT lang FROM vault_files UNION SELECT difficulty FROM vault_files) WHERE tag IS NOT NULL""")),
    "d33_lesson_totals": (d33_lesson_totals, t.sql("enrollments lessons progress", """
WITH totals AS (SELECT course, count(*) AS total FROM lessons GROUP BY ALL), done AS (SELECT student_id, course, count(*) FILTER (completed) AS completed FROM progress GROUP BY ALL)
SELECT student_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(coalesce(completed, 0)) AS BIGINT) AS completed, CAST(sum(total) - sum(coalesce(completed, 0)) AS BIGINT) AS remaining
FROM enrollments JOIN totals USING (course) LEFT JOIN done USING (student_id, course) GROUP BY ALL""")),
    "e16_next_lesson": (e16_next_lesson, t.sql("enrollments lessons progress", """
SELECT e.student_id, e.course, module, lesson FROM enrollments e JOIN lessons l USING (course)
WHERE NOT EXISTS (SELECT 1 FROM progress p WHERE p.completed AND p.student_id = e.student_id AND p.course = e.course AND p.lesson = l.lesson)
QUALIFY row_number() OVER (PARTITION BY e.student_id, e.course ORDER BY module, lesson) = 1""")),
    "e17_study_plan": (e17_study_plan, t.sql("enrollments lessons progress", """
WITH open AS (SELECT e.student_id, e.course, module, lesson, count(*) OVER (PARTITION BY e.student_id, e.course) AS n, row_number() OVER (PARTITION BY e.student_id, e.course ORDER BY module, lesson) AS k
  FROM enrollments e JOIN lessons l USING (course)
  WHERE NOT EXISTS (SELECT 1 FROM progress p WHERE p.completed AND p.student_id = e.student_id AND p.course = e.course AND p.lesson = l.lesson)),
dealt AS (SELECT *, CAST((k - 1) // greatest(1, CAST(ceil(n / 5) AS BIGINT)) + 1 AS INTEGER) AS day FROM open)
SELECT student_id, course, day, count(*) AS lessons, arg_min(module, k) AS focus FROM dealt WHERE day <= 5 GROUP BY ALL""")),
    "f1_latest_notifications": (f1_latest_notifications, "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100"),
    "f5_nearest_events": (f5_nearest_events, f"""
SELECT owner, event, place, strftime(moment, '%Y-%m-%d %H:%M:%S') AS starts FROM (
  SELECT *, row_number() OVER (PARTITION BY owner ORDER BY moment, event) AS place FROM (
    SELECT owner, event, CAST(date || ' ' || coalesce(time || ':00', '23:59:59') AS TIMESTAMP) AS moment FROM ({_CAL})) WHERE moment >= TIMESTAMP '1998-01-01') WHERE place <= 5"""),
    "m1_token_families": (m1_token_families, """
WITH tokens AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS family, event_type = 'error' AS revoked, event_id % 2 = 0 AS used FROM events),
f AS (SELECT family, bool_or(revoked AND used) AS reused FROM tokens GROUP BY ALL)
SELECT family, count(*) AS tokens, count(*) FILTER (revoked OR reused) AS revoked, count(*) FILTER (reused AND NOT revoked) AS revoked_now FROM tokens JOIN f USING (family) GROUP BY ALL"""),
    "m4_lookup_by_mail": (m4_lookup_by_mail, """
SELECT * FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END || '@mail.test' AS mail FROM customer) WHERE mail = lower('Customer#000000042@mail.test')"""),
}
