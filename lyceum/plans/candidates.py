"""Question candidates between the turns of conversations: what a user asks, answered from the reply."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.functions import words
from lyceum.operators import candidates as ops
from lyceum.operators import exam
from lyceum.plans.text import _content_sql, _normal_sql, _quoted, _rules_sql, _sql_list
from lyceum.sources import tables as t

_KINDS = ["MCQ", "multiple choice", "true_false", "Fill_Blank ", "short answer", "essay", "mcq", "fill in the blank"]
_SKILLS = ["factual_recall", "understanding", "comparison", "cause_effect", "application", "analysis", "classification", "misconception", "process_order"]
_GRADES = ["Easy", "hard ", "unknown"]
_KNOWLEDGE = ["definition", "fact", "process"]
_TRUTHS = ["Yes", "wrong", "maybe"]


def _one_of(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def raw(spark: SparkSession, d: str) -> DataFrame:
    """A candidate for each user turn that is answered: its texts are words of the question and the reply."""
    c = t.load(spark, d, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("u"))
    told = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ").alias("w"))
    rows = asked.join(told, ["conv_id", "turn"]).withColumn("id", F.col("conv_id").cast("long") * 1000 + F.col("turn"))
    i, some = F.col("id"), lambda low, n: F.array_join(F.slice("w", low, n), " ")
    kind = _one_of(_KINDS, i)
    prompt = (
        F.when(i % 5 == 0, F.col("u")).when(i % 5 == 1, F.concat("u", F.lit(" ___"))).when(i % 5 == 2, F.concat(F.lit("Why does "), some(1, 3), F.lit(" matter?")))
        .when(i % 15 == 3, F.lit("What follows according to the text?")).otherwise(F.concat(some(1, 12), F.lit(".")))
    )
    three = F.array(some(1, 4), some(5, 4), some(9, 4))
    options = F.when(i % 4 == 0, F.concat(three, F.array(some(13, 4)))).when(i % 4 == 1, three).when(i % 4 == 2, F.concat(three, F.array(some(1, 4), some(13, 4)))).otherwise(F.array(some(5, 4), some(9, 4), some(13, 4), some(17, 4)))
    return rows.select(
        F.col("conv_id").cast("long").alias("quiz_id"), "id", kind.alias("kind"), prompt.alias("prompt"), F.when(kind == "true_false", _one_of(_TRUTHS, i)).otherwise(some(1, 4)).alias("answer"),
        F.when(i % 7 == 0, "short").otherwise(some(1, 20)).alias("explanation"), options.alias("options"), F.slice(F.array(F.lit("x"), F.lit("2"), F.lit(" 1"), F.lit("99")), F.lit(1), (i % 4).cast("int") + 1).alias("pages"),
        F.lit(12).alias("n_pages"), F.when(i % 2 == 1, F.array(F.lit(1), F.lit(2))).alias("read_pages"), _one_of(_GRADES, i).alias("difficulty"), some(1, 30).alias("evidence"), some(1, 2).alias("concept"), some(3, 2).alias("target"),
        _one_of(_SKILLS, i).alias("skill"), F.when(i % 6 == 0, "cause").otherwise("").alias("facet"), _one_of(_KNOWLEDGE, i).alias("knowledge"), some(1, 10).alias("basis"),
    )


def j6_normalised(spark: SparkSession, d: str) -> DataFrame:
    found = ops.normalised(raw(spark, d))
    return found.select("id", "fault", "kind", F.md5("prompt").alias("prompt"), F.md5("answer").alias("answer"), F.array_join("options", "|").alias("options"), "difficulty", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def j8_backed(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.normalised(raw(spark, d)).withColumn("vocabulary", F.lit(None).cast("array<string>"))
    return ops.backed(rows).select("id", "answer_backed", "blank_sound", "statement_sound", "shape_sound")


def _finished(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.normalised(raw(spark, d))
    return rows.withColumns({"read_pages": F.array(F.lit(1)), "traced": F.col("id") % 9 != 0, "known": F.col("id") % 7 != 0})


def j10_final_rejections(spark: SparkSession, d: str) -> DataFrame:
    found = ops.finally_rejected(_finished(spark, d), ["mcq", "true-false", "fill-blank"])
    return found.groupBy("quiz_id", "reason").agg(F.count("*").alias("questions"))


def j9_grounding_classes(spark: SparkSession, d: str) -> DataFrame:
    """Rejections of finished questions and of planned ones, the latter told by the reason that their number picks."""
    gone = ops.finally_rejected(_finished(spark, d), ["mcq", "true-false", "fill-blank"])
    told = F.concat(F.lit("Answer "), _one_of([w.upper() for w in words.UNSUPPORTED], F.col("id")))
    reason = F.when(F.col("id") % 3 == 0, told).otherwise(F.col("reason"))
    return gone.withColumn("why", reason).filter("why is not null").groupBy("quiz_id", ops.grounding_class(F.col("why")).alias("class")).agg(F.count("*").alias("questions"))


def j12_findings(spark: SparkSession, d: str) -> DataFrame:
    return ops.findings(ops.normalised(raw(spark, d)))


def d29_finding_totals(spark: SparkSession, d: str) -> DataFrame:
    return ops.totals(j12_findings(spark, d)).select("severity", "message", "findings", "quizzes")


def _pick(values: list[str], n: str = "id") -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {k} THEN {_quoted(v)}" for k, v in enumerate(values)) + " END"


def _furnished(x: str) -> str:
    plain = _normal_sql(x)
    return "(" + " OR ".join([f"regexp_matches({x}, {_quoted(p)})" for _, p in words.RAW_FURNITURE] + [f"regexp_matches({plain}, {_quoted(p)})" for _, p in words.FURNITURE]) + ")"


_some = lambda low, n: f"array_to_string(w[{low}:{low + n - 1}], ' ')"
_RAW = rf"""
WITH c AS (SELECT u.conv_id, u.turn, u.text AS u, string_split(trim(regexp_replace(coalesce(a.text, ''), '\s+', ' ', 'g')), ' ') AS w, CAST(u.conv_id AS BIGINT) * 1000 + u.turn AS id
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
raw AS (SELECT CAST(conv_id AS BIGINT) AS quiz_id, id, {_pick(_KINDS)} AS rk,
  trim(CASE WHEN id % 5 = 0 THEN u WHEN id % 5 = 1 THEN u || ' ___' WHEN id % 5 = 2 THEN 'Why does ' || {_some(1, 3)} || ' matter?' WHEN id % 15 = 3 THEN 'What follows according to the text?' ELSE {_some(1, 12)} || '.' END) AS prompt,
  trim(CASE WHEN id % 8 = 2 THEN {_pick(_TRUTHS)} ELSE {_some(1, 4)} END) AS ra, trim(CASE WHEN id % 7 = 0 THEN 'short' ELSE {_some(1, 20)} END) AS explanation,
  CASE id % 4 WHEN 0 THEN [{_some(1, 4)}, {_some(5, 4)}, {_some(9, 4)}, {_some(13, 4)}] WHEN 1 THEN [{_some(1, 4)}, {_some(5, 4)}, {_some(9, 4)}]
    WHEN 2 THEN [{_some(1, 4)}, {_some(5, 4)}, {_some(9, 4)}, {_some(1, 4)}, {_some(13, 4)}] ELSE [{_some(5, 4)}, {_some(9, 4)}, {_some(13, 4)}, {_some(17, 4)}] END AS ro,
  CASE id % 4 WHEN 0 THEN [] WHEN 1 THEN [2] ELSE [2, 1] END AS given, id % 2 = 1 AS few, lower(trim({_pick(_GRADES)})) AS grade, {_some(1, 30)} AS evidence, {_some(1, 2)} AS concept, {_some(3, 2)} AS target,
  {_pick(_SKILLS)} AS skill, CASE WHEN id % 6 = 0 THEN 'cause' ELSE '' END AS facet, {_pick(_KNOWLEDGE)} AS knowledge, {_some(1, 10)} AS basis FROM c),
keyed AS (SELECT *, {_normal_sql('ra')} AS ak, list_transform(ro, lambda o: {_normal_sql('o')}) AS keys,
  CASE {" ".join(f"WHEN lower(trim(rk)) IN {_sql_list(v)} OR replace(lower(trim(rk)), '_', ' ') IN {_sql_list(v)} THEN '{k}'" for k, v in words.KINDS.items())} END AS kind,
  CASE WHEN id % 4 = 3 THEN CASE WHEN few THEN [2, 1] ELSE [2, 1] END ELSE given END AS pg FROM raw),
distinct_ AS (SELECT *, list_filter(list_transform(ro, lambda o: trim(o)), lambda o, i: keys[i] <> '' AND NOT list_contains(keys[1 : i - 1], keys[i])) AS od, list_distinct(list_filter(keys, lambda k: k <> '')) AS kd FROM keyed),
filled AS (SELECT *, CASE WHEN kind = 'mcq' AND NOT list_contains(kd, ak) AND len(od) = 3 THEN list_append(od, ra) ELSE od END AS oo, CASE WHEN list_contains(kd, ak) OR (kind = 'mcq' AND len(od) = 3) THEN 1 ELSE 0 END AS hits,
  CASE WHEN ak IN {_sql_list(words.TRUE_WORDS)} THEN 'True' WHEN ak IN {_sql_list(words.FALSE_WORDS)} THEN 'False' END AS truth FROM distinct_),
shaped AS (SELECT quiz_id, id, kind, prompt, CASE WHEN kind = 'true-false' THEN coalesce(truth, ra) ELSE ra END AS answer, explanation, CASE WHEN kind = 'true-false' THEN ['True', 'False'] WHEN kind = 'mcq' THEN oo END AS options,
  CASE WHEN grade IN ('easy', 'medium', 'hard') THEN grade ELSE 'medium' END AS difficulty, pg AS pages, evidence, concept, target, skill, facet, knowledge, basis,
  CASE WHEN kind IS NULL THEN 'kind' WHEN prompt = '' OR ra = '' OR length(explanation) < 10 OR length(prompt) > 700 THEN 'shape'
    WHEN regexp_matches({_normal_sql('prompt')}, {_quoted(words.TRIVIAL)}) OR regexp_matches(prompt, {_quoted(words.SOURCE_REFERENCE)}) THEN 'trivial'
    WHEN {_furnished('prompt')} OR {_furnished('ra')} OR {_furnished('explanation')} THEN 'furniture'
    WHEN kind = 'fill-blank' AND NOT (regexp_matches(prompt, '_{{3,}}') AND regexp_matches(ra, '[\p{{L}}\p{{N}}_]') AND NOT {_furnished('ra')}) THEN 'blank'
    WHEN len(pg) = 0 THEN 'pages' WHEN kind = 'true-false' AND truth IS NULL THEN 'truth' WHEN kind = 'mcq' AND (len(oo) <> 4 OR hits <> 1) THEN 'options'
    WHEN kind = 'mcq' AND len(list_filter(oo, lambda o: {_furnished('o')})) > 0 THEN 'furniture in options' END AS fault FROM filled)
"""
_tok = lambda x: f"list_distinct({_content_sql(x)})"
_without = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
_REJECTED = _RAW + rf""",
judged AS (SELECT *, list_transform(list_filter(list_transform(coalesce(options, []), lambda o: trim(o)), lambda o: o <> ''), lambda o: {_normal_sql('o')}) AS ok FROM shaped),
rejected AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'no provenance' WHEN id % 7 = 0 THEN 'concept not in study map' WHEN coalesce(kind, '') NOT IN ('mcq', 'true-false', 'fill-blank') THEN 'type not requested'
  WHEN len(pages) = 0 THEN 'no source page' WHEN len(list_filter(pages, lambda p: p <> 1)) > 0 THEN 'page not extracted' WHEN answer = '' THEN 'empty answer'
  WHEN kind IN ('mcq', 'true-false') AND len(ok) < 2 THEN 'too few options' WHEN kind IN ('mcq', 'true-false') AND len(list_distinct(ok)) < len(ok) THEN 'duplicate options'
  WHEN kind IN ('mcq', 'true-false') AND NOT list_contains(ok, {_normal_sql('answer')}) THEN 'answer not among options'
  WHEN kind = 'fill-blank' AND NOT (regexp_matches(prompt, '_{{3,}}') AND regexp_matches(answer, '[\p{{L}}\p{{N}}_]') AND NOT {_furnished('answer')}) THEN 'no usable blank' END AS reason FROM judged)
"""
# RE2 knows word edges between ASCII characters only; those of a pattern's ends are spelled out for it.
_edged = lambda p: _quoted(re.sub(r"\\b$", r"(?:$|[^\\p{L}\\p{N}_])", re.sub(r"^\(\?i\)\\b", r"(?i)(?:^|[^\\p{L}\\p{N}_])", p)))
_flat = lambda x: rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"
_size = lambda x: rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"
_cut = lambda x: rf"regexp_matches(regexp_replace({x}, '[ .?]+$', ''), {_edged(words.CUT_OFF)})"
_RULES = [
    ("DEFECT", "article collision", f"regexp_matches(prompt, {_edged(words.DOUBLE_ARTICLE)}) OR regexp_matches(answer, {_edged(words.DOUBLE_ARTICLE)})"),
    ("DEFECT", "prompt ends mid-phrase", f"prompt <> '' AND NOT ends_with(prompt, '?') AND {_cut('prompt')}"), ("DEFECT", "answer ends mid-phrase", f"answer <> '' AND {_cut('answer')}"),
    ("DEFECT", "prompt has no terminal punctuation", "prompt <> '' AND NOT regexp_matches(prompt, '[?.:]$')"), ("WARN", "answer is a single token", f"answer <> '' AND kind IN ('short-answer', 'mcq') AND {_size('answer')} < 2"),
    ("DEFECT", "answer carries a contrast clause", f"kind <> 'true-false' AND regexp_matches(answer, {_quoted(words.CONTRAST_TAIL)})"),
    ("DEFECT", "reason answered by a bare list", f"kind <> 'true-false' AND regexp_matches(prompt, '(?i)^(?:why|how)\\b') AND NOT regexp_matches(answer, {_edged(words.ANY_VERB)}) AND contains(answer, ',')"),
    ("DEFECT", "prompt asks about metadata", f"regexp_matches(prompt, {_edged(words.META_SUBJECT)})"), ("DEFECT", "wording-game stem", f"regexp_matches(prompt, {_quoted(words.WORDING_GAME)})"),
    ("DEFECT", "named-unacceptable stem", f"lower(prompt) IN {_sql_list(words.NAMED_BAD_STEMS)}"), ("DEFECT", "agentive stem on a principle", f"regexp_matches(prompt, {_edged(words.AGENTIVE_STEM)}) AND regexp_matches(concept, {_edged(words.PRINCIPLE_NAME)})"),
    ("DEFECT", "false answer explained as correct", "lower(answer) = 'false' AND contains(lower(explanation), 'original relationship is correct')"),
    ("DEFECT", "falsehood not explained", r"lower(answer) = 'false' AND NOT contains(lower(explanation), 'original relationship is correct') AND NOT regexp_matches(explanation, '(?i)\bfalse\b|\bnot\b|\bincorrect\b')"),
    ("DEFECT", "explanation is not a complete sentence", "explanation <> '' AND NOT regexp_matches(explanation, '[.?!]$')"),
    ("DEFECT", "answer largely absent from evidence", f"kind <> 'true-false' AND answer <> '' AND len({_without('need', 'have')}) > 0.5 * greatest(len(need), 1)"),
    ("DEFECT", "prompt copies the source", f"regexp_replace({_flat('prompt')}, '[?.]+$', '') <> '' AND regexp_replace({_flat('prompt')}, '[?.]+$', '') = regexp_replace({_flat('evidence')}, '\\.+$', '')"),
    ("DEFECT", "choice without four options", "kind = 'mcq' AND len(options) <> 4"), ("DEFECT", "answer not once among options", "kind = 'mcq' AND len(list_filter(options, lambda o: o = answer)) <> 1"),
    ("DEFECT", "duplicate options", f"kind = 'mcq' AND len(list_distinct(list_transform(options, lambda o: {_flat('o')}))) < len(options)"),
    ("WARN", "length giveaway", f"kind = 'mcq' AND len(options) > 0 AND list_max(list_transform(options, lambda o: {_size('o')})) >= 3 * greatest(1, list_min(list_transform(options, lambda o: {_size('o')})))"),
    ("DEFECT", "notation giveaway", "kind = 'mcq' AND len(options) > 1 AND len(list_filter(options, lambda o: regexp_matches(o, '[=<>≤≥]'))) = 1 AND list_contains(options, answer) AND regexp_matches(answer, '[=<>≤≥]')"),
    ("WARN", "near-equal options", "kind = 'mcq' AND len(list_filter(list_transform(tokens, lambda a, i: len(list_filter(tokens[i + 1 :], lambda b: len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) >= 0.8 * len(list_distinct(list_concat(a, b))))) > 0), lambda x: x)) > 0"),
    ("DEFECT", "tier 3", f"facet = '' AND skill NOT IN {_sql_list([*exam.REASONING, 'understanding'])}"),
]
_FINDINGS = _RAW + f""",
wide AS (SELECT *, {_tok('answer')} AS need, {_tok('evidence')} AS have, list_transform(coalesce(options, []), lambda o: {_tok('o')}) AS tokens FROM (SELECT * REPLACE (coalesce(options, []) AS options, trim(evidence) AS evidence, trim(concept) AS concept, trim(target) AS target) FROM shaped)),
single AS (SELECT quiz_id, id, unnest(list_filter([{", ".join(f"CASE WHEN {c} THEN {{'severity': '{s}', 'message': '{m}'}} END" for s, m, c in _RULES)}], lambda x: x IS NOT NULL)) AS f FROM wide),
quiz AS (SELECT quiz_id, count(*) AS questions, count(*) FILTER (kind = 'true-false') AS n, count(*) FILTER (kind = 'true-false' AND lower(answer) = 'true') AS told FROM wide GROUP BY quiz_id),
most AS (SELECT quiz_id, max(n) AS most FROM (SELECT quiz_id, skill, count(*) AS n FROM wide GROUP BY ALL) GROUP BY quiz_id), again AS (SELECT quiz_id, max(n) AS repeats FROM (SELECT quiz_id, target, count(*) AS n FROM wide GROUP BY ALL) GROUP BY quiz_id),
found AS (SELECT quiz_id, id, f.severity AS severity, f.message AS message FROM single
  UNION ALL SELECT quiz_id, NULL, 'DEFECT', 'uniform truth of statements' FROM quiz WHERE n >= 2 AND (told = 0 OR told = n) UNION ALL SELECT quiz_id, NULL, 'DEFECT', 'duplicate knowledge target' FROM again WHERE repeats > 1
  UNION ALL SELECT quiz_id, NULL, 'WARN', 'skill concentration' FROM quiz JOIN most USING (quiz_id) WHERE most > greatest(2, questions // 2))
"""

QUERIES = {
    "d29_finding_totals": (d29_finding_totals, _FINDINGS + "SELECT severity, message, count(*) AS findings, count(DISTINCT quiz_id) AS quizzes FROM found GROUP BY ROLLUP (severity, message)"),
    "j6_normalised": (j6_normalised, _RAW + "SELECT id, fault, kind, md5(prompt) AS prompt, md5(answer) AS answer, array_to_string(options, '|') AS options, difficulty, array_to_string(pages, ',') AS pages FROM shaped"),
    "j8_backed": (j8_backed, _RAW + rf""",
k AS (SELECT *, {_tok('answer')} AS ta, {_tok('evidence')} AS te, {_tok('prompt')} AS tp, {_tok('basis')} AS tb, {_normal_sql('answer')} AS na, {_normal_sql('evidence')} AS ne, {_normal_sql('prompt')} AS np, list_concat({_tok('concept')}, {_tok('target')}) AS more FROM shaped),
l AS (SELECT *, {_without('ta', 'list_concat(te, more)')} AS loose, {_rules_sql('np', words.SKILLS)} AS asked, len(list_intersect(tp, te)) AS shared, len({_without('tp', 'tb')}) AS swapped FROM k)
SELECT id, coalesce(kind = 'true-false', false) OR (na <> '' AND contains(ne, na)) OR (len(ta) > 0 AND len(list_filter(loose, lambda x: x NOT IN {_sql_list(words.CONNECTIVES)})) = 0
    AND len(list_filter(regexp_extract_all(answer, '\b\d+(?:\.\d+)?\b'), lambda x: NOT list_contains(regexp_extract_all(evidence, '\b\d+(?:\.\d+)?\b'), x))) = 0) AS answer_backed,
  len(regexp_extract_all(prompt, '_{{3,}}')) = 1 AND na <> '' AND na NOT IN {_sql_list(words.GENERIC_BLANKS)} AND len(ta) BETWEEN 1 AND 6 AND contains(ne, na) AND len(tp) >= 4 AND knowledge IN {_sql_list(words.BLANK_KNOWLEDGE)} AS blank_sound,
  len(tp) >= 4 AND NOT ends_with(rtrim(prompt), '?') AND np <> ne AND shared >= CASE WHEN na = 'false' THEN 0.45::DOUBLE ELSE 0.65::DOUBLE END * len(tp) AND len({_without('tp', 'te')}) <= CASE WHEN na = 'false' THEN greatest(2, swapped) ELSE 2 END
    AND (na <> 'false' OR (length(trim(basis)) >= 8 AND len(tb) > 0 AND len(list_intersect(tb, te)) >= 0.7::DOUBLE * len(tb))) AND skill <> 'factual_recall' AS statement_sound,
  CASE WHEN facet <> '' THEN true WHEN skill = 'application' THEN {" OR ".join(f"contains(np, {_quoted(w)})" for w in words.APPLICATION_TASKS)} WHEN skill IN ('comparison', 'cause_effect', 'process_order', 'analysis') THEN asked = skill
    WHEN skill = 'classification' THEN asked IN ('classification', 'comparison', 'understanding', 'factual_recall') WHEN skill = 'misconception' THEN coalesce(kind = 'true-false', false) OR asked = 'misconception' ELSE true END AS shape_sound FROM l"""),
    "j9_grounding_classes": (j9_grounding_classes, _REJECTED + f""",
told AS (SELECT quiz_id, lower(CASE WHEN id % 3 = 0 THEN 'Answer ' || {_pick([w.upper() for w in words.UNSUPPORTED])} ELSE reason END) AS why FROM rejected)
SELECT quiz_id, CASE WHEN {" OR ".join(f"contains(why, {_quoted(w)})" for w in words.UNSUPPORTED)} THEN 'unsupported_by_pdf' ELSE 'validator_false_negative' END AS class, count(*) AS questions FROM told WHERE why IS NOT NULL GROUP BY ALL"""),
    "j10_final_rejections": (j10_final_rejections, _REJECTED + "SELECT quiz_id, reason, count(*) AS questions FROM rejected GROUP BY ALL"),
    "j12_findings": (j12_findings, _FINDINGS + "SELECT * FROM found"),
}
