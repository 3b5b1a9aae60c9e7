"""Questions made of parts: a quiz is a run of a hundred parts, a concept a brand, and measures follow from numbers of the part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.operators import exam as ops
from lyceum.plans.text import _content_sql, _normal_sql
from lyceum.sources import tables as t
from lyceum.sources.shared import stored

SKILLS = [*ops.COGNITIVE, "classification"]
KINDS = ["mcq", "true-false", "fill-blank", "short"]


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


def candidates(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """quiz_id, id, skill, kind, concept, prompt, answer, options, pages, and the parts of the quality score.

    dealt: parts are dealt out evenly first, as a file of one row group is read by one task, and scoring is what costs.
    """
    p = t.load(spark, d, "part")
    if dealt:
        p = p.select("p_partkey", "p_name", "p_brand", "p_type").repartition(ops.TASKS * spark.sparkContext.defaultParallelism)
    i = F.col("p_partkey")
    unit = lambda k, m: F.round((i * k % m) / float(m), 4)
    rows = p.select(
        F.floor(i / 100).cast("long").alias("quiz_id"), i.alias("id"), _pick(SKILLS, i).alias("skill"), _pick(KINDS, i % 7).alias("kind"), F.col("p_brand").alias("concept"),
        F.concat(F.lit("How does "), F.col("p_name"), F.when(i % 5 == 0, F.lit(" and the thing")).otherwise(F.lit("")), F.when(i % 7 == 2, F.lit(" work ___ here")).otherwise(F.lit(" work")), F.lit("?")).alias("prompt"),
        F.col("p_type").alias("answer"), F.array(F.col("p_type"), F.concat(F.lit("not "), F.col("p_name")), F.when(i % 11 == 0, F.lit("banana")).otherwise(F.lit("a steel case")), F.concat(F.lit("option "), (i % 3).cast("string"))).alias("options"),
        F.array((i % 12).cast("int")).alias("pages"), (0.5 + unit(17, 101) / 2).alias("importance"), (0.6 + unit(29, 97) * 0.4).alias("grounding"), (0.5 + unit(13, 89) / 2).alias("conceptual"),
        unit(31, 83).alias("novelty"), _pick(["easy", "medium", "hard"], i).alias("own_difficulty"),
    )
    rows = rows.withColumns({"clarity": ops.clarity(F.col("prompt"), F.col("kind"), F.col("options")), "cognitive": ops.cognitive_value(F.col("skill")), "difficulty": ops.difficulty_match(F.col("own_difficulty"), F.lit("medium"))})
    vocabulary = fn.content_tokens(F.concat_ws(" ", "answer", "prompt"))
    return rows.withColumn("distractors", F.when(F.col("kind") == "mcq", ops.distractor_quality(F.col("answer"), F.col("options"), vocabulary)).otherwise(1.0))


def j2_quality(spark: SparkSession, d: str) -> DataFrame:
    return ops.scored(candidates(spark, d).withColumn("distractors", F.lit(1.0))).select("id", "total", "clarity", "cognitive", "difficulty")


def j3_distractors(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).filter("kind = 'mcq'").select("id", F.round("distractors", 6).alias("distractors"))


def j5_gates(spark: SparkSession, d: str) -> DataFrame:
    return ops.gated(ops.scored(candidates(spark, d))).select("id", "reasons")


def d22_funnel(spark: SparkSession, d: str) -> DataFrame:
    return ops.funnel(ops.gated(ops.scored(candidates(spark, d).withColumn("distractors", F.lit(1.0)))))


def i29_tiers(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).groupBy("skill", ops.tier(F.when(F.col("id") % 4 == 0, "cause"), F.col("skill")).alias("tier")).agg(F.count("*").alias("targets"))


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    p = t.load(spark, d, "part")
    i = F.col("p_partkey")
    unit = lambda k, m: F.round((i * k % m) / float(m), 4)
    rows = p.select(F.floor(i / 100).cast("long").alias("doc_id"), F.concat("p_name", F.lit(" "), i.cast("string")).alias("concept"), unit(7, 53).alias("type_value"), unit(11, 59).alias("depth"), unit(13, 61).alias("centrality"), unit(17, 67).alias("richness"), unit(19, 71).alias("emphasis"), unit(23, 73).alias("prerequisite"), unit(29, 79).alias("spread"), _pick(["definition", "fact", "example", "process"], i).alias("type"), (i % 40).alias("tokens"), _pick(["high", "medium", "low"], i % 5).alias("emphasis_hint"), unit(31, 83).alias("value"), (i % 3 == 0).alias("developed"))
    n = p.groupBy(F.floor(i / 100).cast("long").alias("doc_id")).agg(F.count("*").alias("concepts"))
    return rows.join(n, "doc_id")


def j1_importance(spark: SparkSession, d: str) -> DataFrame:
    return ops.importance(_concepts(spark, d)).select("concept", "importance")


def e11_anchored_importance(spark: SparkSession, d: str) -> DataFrame:
    return ops.anchored(ops.importance(_concepts(spark, d))).select("doc_id", "concept", "importance")


def e12_leading_concepts(spark: SparkSession, d: str) -> DataFrame:
    return ops.leading_concepts(ops.importance(_concepts(spark, d))).select("doc_id", "concept")


def i18_centrality(spark: SparkSession, d: str) -> DataFrame:
    """Edges join concepts whose numbers are next to each other within a document, every other one."""
    p = t.load(spark, d, "part")
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    nodes = p.select(F.floor(F.col("p_partkey") / 100).cast("long").alias("doc_id"), F.col("p_partkey").alias("k"), name.alias("concept"))
    from pyspark.sql import Window

    after = F.lead("concept").over(Window.partitionBy("doc_id").orderBy("k"))
    edges = nodes.withColumn("target", after).filter("target is not null and k % 2 = 0").select("doc_id", F.col("concept").alias("source"), "target")
    return ops.central(_concepts(spark, d), edges).select("concept", "degree", "centrality")


def j12_audit(spark: SparkSession, d: str) -> DataFrame:
    return ops.audit(candidates(spark, d)).groupBy("quiz_id", "severity", "message").agg(F.count("*").alias("n"))


def f15_best_of_each(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.scored(candidates(spark, d)).withColumns({"score": F.col("total"), "objective": F.concat_ws("/", "concept", "skill"), "target": F.concat("concept", (F.col("id") % 6).cast("string"))})
    return ops.best_of_each(rows)


def g8_chosen_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.scored(candidates(spark, d))
    truth = F.when(F.col("kind") == "true-false", F.col("id") % 2 == 0)
    rows = rows.withColumns({
        "score": F.col("total"), "pattern": F.col("kind"), "objective": F.concat_ws("/", "concept", "skill"), "target": F.concat("concept", (F.col("id") % 6).cast("string")), "category": F.lit("fact"),
        "pair": F.when(F.col("skill") == "comparison", F.col("concept")), "claim": fn.content_tokens(F.col("prompt")), "truth": truth,
    })
    return ops.choose(rows, count=8)


def g7_planned_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d).withColumns({"doc_id": F.col("quiz_id"), "facet": F.when(F.col("id") % 4 == 0, "cause").otherwise(""), "topic": F.col("own_difficulty"), "writable": F.when(F.col("id") % 3 == 0, F.array(F.lit("mcq"), F.lit("short"))).otherwise(F.array(F.lit("short")))})
    return ops.plan(rows, count=8, types=["mcq", "true-false", "short"])


COUNT, TYPES = 8, ["mcq", "true-false", "short"]


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """A target for each part, with its scores and whether it passes the gates; a table, so that it is scored once."""
    rows = ops.gated(ops.scored(candidates(spark, d, dealt=True).withColumn("distractors", F.lit(1.0))))
    rows = rows.withColumns({
        "facet": F.when(F.col("id") % 4 == 0, "cause").otherwise(""), "topic": F.col("own_difficulty"), "writable": F.when(F.col("id") % 3 == 0, F.array(F.lit("mcq"), F.lit("short"))).otherwise(F.array(F.lit("short"))),
        "objective": F.concat_ws("/", "concept", "skill"), "important": F.col("importance") >= 0.9, "good": F.col("reasons") == "",
    })
    return stored(rows.select("quiz_id", "id", "concept", "objective", "skill", "facet", "importance", "topic", "pages", "writable", "important", "good"), "scored")


def _topped_up(spark: SparkSession, d: str) -> DataFrame:
    """Pools of the first three parts of each quiz that pass, topped up to eight; a planned target is written if it passes."""
    targets = _targets(spark, d)
    pool = targets.filter("good and id % 100 < 12")
    write = lambda slots: slots.join(targets.filter("good").select("quiz_id", "id", "concept", "objective"), ["quiz_id", "id"])
    return ops.topped_up(pool, targets, write, COUNT, TYPES)


def g10_topped_up(spark: SparkSession, d: str) -> DataFrame:
    return _topped_up(spark, d).select("quiz_id", "id", "objective", "round")


def j11_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    """Quizzes that ask for as many questions as a third of their parts, against those that pass; pages follow from numbers of the quiz."""
    rows = _targets(spark, d)
    asked = rows.groupBy("quiz_id").agg(F.ceil(F.count("*") / 3).cast("int").alias("requested"), F.count("*").alias("planned"), F.count_if("good").alias("passed"), F.count_if(~F.col("good")).alias("rejected"))
    asked = asked.withColumns({"pages_dropped": F.when(F.col("quiz_id") % 3 == 0, 2), "image_pages": F.col("quiz_id") % 2, "provider_errors": F.lit(1)})
    return ops.shortfalls(rows.filter("good"), asked)


_UNIT = lambda k, m: f"round((p_partkey * {k} % {m}) / {m}.0::DOUBLE, 4)"
_SKILL = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SKILLS)) + " END"
_COG = "CASE skill " + " ".join(f"WHEN '{s}' THEN {v}::DOUBLE" for s, v in ops.COGNITIVE.items()) + " ELSE 0.65::DOUBLE END"
_CAND = f"""
WITH base AS (SELECT CAST(p_partkey // 100 AS BIGINT) AS quiz_id, p_partkey AS id, {_SKILL} AS skill, CASE p_partkey % 7 % 4 WHEN 0 THEN 'mcq' WHEN 1 THEN 'true-false' WHEN 2 THEN 'fill-blank' ELSE 'short' END AS kind, p_brand AS concept,
  'How does ' || p_name || CASE WHEN p_partkey % 5 = 0 THEN ' and the thing' ELSE '' END || CASE WHEN p_partkey % 7 = 2 THEN ' work ___ here' ELSE ' work' END || '?' AS prompt,
  0.5::DOUBLE + {_UNIT(17, 101)} / 2 AS importance, 0.6::DOUBLE + {_UNIT(29, 97)} * 0.4::DOUBLE AS grounding, 0.5::DOUBLE + {_UNIT(13, 89)} / 2 AS conceptual, {_UNIT(31, 83)} AS novelty, 1.0::DOUBLE AS distractors,
  CASE p_partkey % 3 WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS difficulty FROM part),
parts AS (SELECT *, {_COG} AS cognitive, CASE WHEN len(regexp_extract_all(prompt, '[\\p{{L}}\\p{{N}}]+')) < 3 THEN 0.35::DOUBLE ELSE
  CASE WHEN contains(prompt, 'thing') AND regexp_matches(prompt, '\\bthing\\b') THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN kind = 'fill-blank' AND NOT contains(prompt, '___') THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END END AS clarity FROM base),
scored AS (SELECT *, round_even({" + ".join(f"{w}::DOUBLE * {n}" for n, w in ops.QUALITY.items())}, 4) AS total FROM parts),
gated AS (SELECT *, concat_ws('; ', {", ".join(f"CASE WHEN {n} < {v} THEN printf('{n} %.2f<{v:.2f}', {n}) END" for n, v in ops.GATES)}) AS reasons FROM scored)
"""
_NUMBER, _ABSURD = "\\d|[=+*/^]", "\\b(banana|purple elephant|unicorn|magic|random answer|i don t know|none of the above|all of the above|zzzz)\\b"
#: _CAND with the quality of the distractors, which the gates look at.
_JUDGED = _CAND.replace("WITH base AS", f"""
WITH offered AS (SELECT *, [p_type, 'not ' || p_name, CASE WHEN p_partkey % 11 = 0 THEN 'banana' ELSE 'a steel case' END, 'option ' || p_partkey % 3] AS options, p_type AS answer,
  'How does ' || p_name || CASE WHEN p_partkey % 5 = 0 THEN ' and the thing' ELSE '' END || CASE WHEN p_partkey % 7 = 2 THEN ' work ___ here' ELSE ' work' END || '?' AS asked FROM part),
normal AS (SELECT *, list_transform(options, lambda o: {_normal_sql('o')}) AS norm, {_normal_sql('answer')} AS answer_key, {_content_sql("concat_ws(' ', answer, asked)")} AS vocabulary FROM offered),
shaped AS (SELECT *, list_transform(norm, lambda o: greatest(1, len({_content_sql('o')}))) AS sizes, list_filter(options, lambda o: {_normal_sql('o')} <> answer_key) AS wrong FROM normal),
judged AS (SELECT *, CASE WHEN len(options) = 4 AND NOT list_contains(norm, '') AND len(list_distinct(norm)) = 4 AND list_contains(norm, answer_key) THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  CASE WHEN list_max(sizes) <= greatest(5, list_min(sizes) * 4) THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END
  * CASE WHEN regexp_matches(answer, '{_NUMBER}') AND len(list_filter(options, lambda o: regexp_matches(o, '{_NUMBER}'))) < 3 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN starts_with(lower(trim(answer)), 'to ') AND len(list_filter(options, lambda o: starts_with(lower(o), 'to '))) < 3 THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END
  * (list_reduce(list_concat([0.0::DOUBLE], list_transform(wrong, lambda o: CASE WHEN regexp_matches({_normal_sql('o')}, '{_ABSURD}') THEN 0.0::DOUBLE ELSE
      CASE WHEN length(trim(o)) < 2 OR length(trim(o)) > 400 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN list_has_any({_content_sql('o')}, vocabulary) THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END
      * CASE WHEN greatest(length(trim(o)), length(trim(answer))) / greatest(1, least(length(trim(o)), length(trim(answer)))) > 5 THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END END)), lambda a, b: a + b) / 3.0::DOUBLE)))
  ELSE 0.0::DOUBLE END AS quality FROM shaped),
base AS""").replace("1.0::DOUBLE AS distractors", "CASE WHEN kind = 'mcq' THEN quality ELSE 1.0::DOUBLE END AS distractors").replace("AS difficulty FROM part)", "AS difficulty FROM judged)")
_CONCEPTS = f"""
WITH c AS (SELECT CAST(p_partkey // 100 AS BIGINT) AS doc_id, p_partkey AS k, p_name || ' ' || p_partkey AS concept, {_UNIT(7, 53)} AS type_value, {_UNIT(11, 59)} AS depth, {_UNIT(13, 61)} AS centrality, {_UNIT(17, 67)} AS richness,
  {_UNIT(19, 71)} AS emphasis, {_UNIT(23, 73)} AS prerequisite, {_UNIT(29, 79)} AS spread, CASE p_partkey % 4 WHEN 0 THEN 'definition' WHEN 1 THEN 'fact' WHEN 2 THEN 'example' ELSE 'process' END AS type,
  p_partkey % 40 AS tokens, CASE p_partkey % 5 % 3 WHEN 0 THEN 0.04::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.06::DOUBLE END AS hint, {_UNIT(31, 83)} AS value, p_partkey % 3 = 0 AS developed, count(*) OVER (PARTITION BY p_partkey // 100) AS concepts FROM part),
r AS (SELECT *, (1 - {ops.STRUCTURAL_SHARE}::DOUBLE * least(1.0::DOUBLE, concepts / {ops.STRUCTURAL_FLOOR})) * ({" + ".join(f"{w}::DOUBLE * {n}" for n, w in ops.INTRINSIC.items())})
  + {ops.STRUCTURAL_SHARE}::DOUBLE * least(1.0::DOUBLE, concepts / {ops.STRUCTURAL_FLOOR}) * ({" + ".join(f"{w}::DOUBLE * {n}" for n, w in ops.STRUCTURAL.items())}) + hint AS raw FROM c),
e AS (SELECT *, CASE WHEN tokens < 5 THEN least(raw, {ops.UNEXPLAINED}::DOUBLE) ELSE raw END AS r1 FROM r), x AS (SELECT *, CASE WHEN type = 'example' THEN least(r1, {ops.EXAMPLE}::DOUBLE) ELSE r1 END AS r2 FROM e),
scored AS (SELECT *, round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN type = 'fact' AND tokens < 18 THEN least(r2, 0.5::DOUBLE) ELSE r2 END)), 3) AS importance FROM x)
"""

QUERIES = {
    "d22_funnel": (d22_funnel, _CAND + "SELECT quiz_id, count(*) AS planned, count(*) FILTER (reasons = '') AS passed, count(*) FILTER (reasons <> '') AS rejected, " + ", ".join(f"count(*) FILTER (contains(reasons, '{n} ')) AS failed_{n}" for n, _ in ops.GATES) + " FROM gated GROUP BY quiz_id"),
    "e11_anchored_importance": (e11_anchored_importance, _CONCEPTS + """,
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, concept) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM scored),
a AS (SELECT *, max(importance) FILTER (p = least(n, greatest(3, least(8, n))) // 2 + 1) OVER (PARTITION BY doc_id) AS anchor FROM k)
SELECT doc_id, concept, CASE WHEN anchor > 0 AND anchor < 0.78::DOUBLE THEN round_even(least(greatest(0.0::DOUBLE, least(1.0::DOUBLE, importance * (0.78::DOUBLE / anchor))),
  CASE WHEN tokens < 5 THEN {unexplained}::DOUBLE ELSE 1.0::DOUBLE END, CASE WHEN type = 'example' THEN {example}::DOUBLE ELSE 1.0::DOUBLE END), 3) ELSE importance END AS importance FROM a""".replace("{unexplained}", str(ops.UNEXPLAINED)).replace("{example}", str(ops.EXAMPLE))),
    "e12_leading_concepts": (e12_leading_concepts, _CONCEPTS + """,
f AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n0, count(*) FILTER (developed) OVER (PARTITION BY doc_id) AS d0 FROM scored) WHERE developed OR n0 <= 6 OR d0 < 3),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, value DESC, lower(concept)) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM f),
m AS (SELECT *, max(importance) FILTER (p = least(n, greatest(3, least(8, n))) // 2 + 1) OVER (PARTITION BY doc_id) AS middle FROM k),
g AS (SELECT *, count(*) FILTER (importance >= middle * 0.62::DOUBLE) OVER (PARTITION BY doc_id) AS good FROM m)
SELECT doc_id, concept FROM g WHERE n <= 3 OR good < 3 OR importance >= middle * 0.62::DOUBLE"""),
    "f15_best_of_each": (f15_best_of_each, None),
    "g10_topped_up": (g10_topped_up, None),
    "g7_planned_slots": (g7_planned_slots, None),
    "g8_chosen_questions": (g8_chosen_questions, None),
    "i18_centrality": (i18_centrality, _CONCEPTS + """,
e AS (SELECT doc_id, concept, lead(concept) OVER (PARTITION BY doc_id ORDER BY k) AS target, k FROM c), e2 AS (SELECT * FROM e WHERE target IS NOT NULL AND k % 2 = 0),
g AS (SELECT concept, count(*) AS degree FROM (SELECT concept FROM e2 UNION ALL SELECT target FROM e2) GROUP BY ALL)
SELECT concept, coalesce(degree, 0) AS degree, CASE WHEN degree > 0 THEN round_even(least(1.0::DOUBLE, centrality + degree / greatest(3.0::DOUBLE, concepts * 0.5::DOUBLE)), 3) ELSE centrality END AS centrality FROM c LEFT JOIN g USING (concept)""".replace("e AS (SELECT doc_id, concept, lead", "e0 AS (SELECT doc_id, concept, lead").replace("FROM e WHERE", "FROM e0 WHERE")),
    "i29_tiers": (i29_tiers, _CAND + "SELECT skill, CASE WHEN id % 4 = 0 OR skill IN ('" + "', '".join(ops.REASONING) + "') THEN 1 WHEN skill = 'understanding' THEN 2 ELSE 3 END AS tier, count(*) AS targets FROM base GROUP BY ALL"),
    "j1_importance": (j1_importance, _CONCEPTS + "SELECT concept, importance FROM scored"),
    "j2_quality": (j2_quality, _CAND + "SELECT id, total, clarity, cognitive, difficulty FROM scored"),
    "j3_distractors": (j3_distractors, None),
    "j5_gates": (j5_gates, _JUDGED + "SELECT id, reasons FROM gated"),
    "j11_shortfalls": (j11_shortfalls, _CAND + """,
a AS (SELECT quiz_id, CAST(ceil(count(*) / 3.0::DOUBLE) AS INTEGER) AS requested, count(*) FILTER (reasons = '') AS available, count(*) AS planned, count(*) FILTER (reasons = '') AS passed, count(*) FILTER (reasons <> '') AS rejected,
  CASE WHEN quiz_id % 3 = 0 THEN 2 ELSE 0 END AS pages_dropped, quiz_id % 2 AS image_pages, 1 AS provider_errors FROM gated GROUP BY quiz_id)
SELECT quiz_id, requested, available, CASE WHEN available = 0 THEN 'provider' WHEN pages_dropped > 0 THEN 'pages dropped' WHEN image_pages > 0 THEN 'image pages' ELSE 'material' END AS reason,
  planned, passed, rejected, pages_dropped, image_pages, provider_errors FROM a WHERE available < requested"""),
    "j12_audit": (j12_audit, None),
}
