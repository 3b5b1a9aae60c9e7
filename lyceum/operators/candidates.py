"""Question candidates: their normal form, whether the document backs them, and the audit of finished quizzes.

All rules are column expressions on a row; what concerns a whole quiz is one aggregation by quiz.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.functions import words
from lyceum.operators import exam
from lyceum.operators.records import first_reason, safe_pages

_MANY = 9_999


def kind_of(raw: Column) -> Column:
    """The kind that a writer's word stands for, null if none."""
    low = F.lower(F.trim(raw))
    out = F.lit(None).cast("string")
    for kind, names in words.KINDS.items():
        out = F.when(low.isin(names) | F.replace(low, F.lit("_"), F.lit(" ")).isin(names), kind).otherwise(out)
    return out


def _has_furniture(text: Column) -> Column:
    return F.size(fn.furniture(text)) > 0


def usable_blank(prompt: Column, answer: Column) -> Column:
    """Whether a prompt has a blank and the answer is more than one."""
    a = F.trim(answer)
    return prompt.rlike("_{3,}") & (a != "") & ~a.isin("_", "__", "___", "_____") & a.rlike(r"[\p{L}\p{N}_]") & ~_has_furniture(a)


def _distinct_options(options: Column) -> Column:
    """Options trimmed, without empty ones and without those that repeat an earlier one in normal form."""
    shaped = F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o: F.struct(F.trim(F.coalesce(o, F.lit(""))).alias("text"), fn.normal(o).alias("key")))
    new = lambda kept, o: F.when((o["key"] == "") | F.exists(kept, lambda k: k["key"] == o["key"]), kept).otherwise(F.concat(kept, F.array(o)))
    return F.aggregate(shaped, F.slice(shaped, 1, 0), new)


def normalised(rows: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Raw candidates in their public shape, each with `fault`: the first rule that it breaks, null if it keeps all.

    rows: kind, prompt, answer, explanation, options, pages (texts), difficulty, n_pages, read_pages (array of the
    pages that were read; empty: all). Texts are trimmed, null ones are empty. Rules, in order: a known (and allowed)
    kind; prompt, answer and an explanation of ten characters, a prompt of at most 700; no trivial prompt, none
    that speaks of the source, no furniture; a usable blank; pages, all of them read; for true/false an answer
    that says which; for choices four different options, one of them the answer (a missing fourth is the
    answer). difficulty is medium where it isn't a grade. Rows and other columns stay.
    """
    text = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    rows = rows.withColumns({"__kind": kind_of(F.col("kind")), "__p": text("prompt"), "__a": text("answer"), "__e": text("explanation"), "__o": _distinct_options(F.col("options"))})
    rows = rows.withColumns({"__key": fn.normal(F.col("__a")), "__read": F.coalesce("read_pages", F.array().cast("array<int>"))})
    last = F.when(F.size("__read") > 0, F.array_max("__read")).otherwise(F.col("n_pages"))
    rows = rows.withColumns({"__pages": safe_pages(F.coalesce("pages", F.array().cast("array<string>")), last)})
    has = F.exists("__o", lambda o: o["key"] == F.col("__key"))
    filled = F.when((F.col("__kind") == "mcq") & ~has & (F.size("__o") == 3), F.concat("__o", F.array(F.struct(F.col("__a").alias("text"), F.col("__key").alias("key"))))).otherwise(F.col("__o"))
    rows = rows.withColumn("__o", filled)
    truth = F.when(F.col("__key").isin([*words.TRUE_WORDS]), "True").when(F.col("__key").isin([*words.FALSE_WORDS]), "False")
    answers = F.size(F.filter("__o", lambda o: o["key"] == F.col("__key")))
    is_ = lambda kind: F.col("__kind") == kind
    p, a, e = F.col("__p"), F.col("__a"), F.col("__e")
    fault = first_reason([
        (F.col("__kind").isNull() | (~F.col("__kind").isin(allowed) if allowed else F.lit(False)), "kind"),
        ((p == "") | (a == "") | (F.length(e) < 10) | (F.length(p) > 700), "shape"),
        (fn.trivial_question(p) | p.rlike(words.SOURCE_REFERENCE), "trivial"),
        (_has_furniture(p) | _has_furniture(a) | _has_furniture(e), "furniture"),
        (is_("fill-blank") & ~usable_blank(p, a), "blank"),
        ((F.size("__pages") == 0) | ((F.size("__read") > 0) & (F.size(F.array_except("__pages", "__read")) > 0)), "pages"),
        (is_("true-false") & truth.isNull(), "truth"),
        (is_("mcq") & ((F.size("__o") != 4) | (answers != 1)), "options"),
        (is_("mcq") & F.exists("__o", lambda o: _has_furniture(o["text"])), "furniture in options"),
    ])
    options = F.when(is_("true-false"), F.array(F.lit("True"), F.lit("False"))).when(is_("mcq"), F.transform("__o", lambda o: o["text"]))
    grade = F.lower(text("difficulty"))
    shaped = {
        "fault": fault, "kind": F.col("__kind"), "prompt": p, "answer": F.when(is_("true-false"), F.coalesce(truth, a)).otherwise(a), "explanation": e, "options": options,
        "difficulty": F.when(grade.isin("easy", "medium", "hard"), grade).otherwise("medium"), "pages": F.col("__pages"),
    }
    return rows.withColumns(shaped).drop("__kind", "__p", "__a", "__e", "__o", "__key", "__read", "__pages")


def backed(rows: DataFrame) -> DataFrame:
    """Questions with answer_backed, blank_sound, statement_sound and shape_sound: whether the planned evidence bears them.

    rows: kind, prompt, answer, evidence, concept, target, skill, facet, knowledge, basis (of a false statement),
    vocabulary (content words of the document, or null); null texts are empty.

    - An answer is backed if the evidence has it, or if its content words are the evidence's, the concept's, the
      target's or the document's, but for linking verbs, and its numbers the evidence's. An Arabic word may stand
      for one of the evidence with 0.7 of their letters in common. True/false is judged as a statement.
    - A blank is sound with exactly one blank, an answer of one to six content words in the evidence that isn't
      too general, a prompt of four, and a kind of knowledge that a blank can ask for.
    - A statement is sound with four content words or more, no question mark, not the evidence itself, 0.65 of its
      words in the evidence and two words at most that aren't; a false one with 0.45, its own words but those of
      its basis, and a basis of eight characters, 0.7 of whose words are the evidence's. It doesn't ask for recall.
    - A prompt has the shape of its skill, unless a facet backs it.
    """
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    tokens = lambda x: F.array_distinct(fn.content_tokens(x))
    rows = rows.withColumns({"__t" + n: tokens(text(n)) for n in ("answer", "evidence", "prompt", "basis")})
    rows = rows.withColumns({"__n" + n: fn.normal(F.col(n)) for n in ("answer", "evidence", "prompt")})
    known = F.array_union(F.array_union("__tevidence", tokens(text("concept"))), F.array_union(tokens(text("target")), F.coalesce("vocabulary", F.array().cast("array<string>"))))
    rows = rows.withColumn("__loose", F.array_except("__tanswer", known))
    letters = lambda w: F.array_distinct(F.split(w, ""))
    arabic = lambda w: w.rlike("[؀-ۿ]")
    near = lambda w: arabic(w) & F.exists("__tevidence", lambda e: arabic(e) & (F.size(F.array_intersect(letters(w), letters(e))) >= 0.7 * F.size(F.array_union(letters(w), letters(e)))))
    linked = F.forall("__loose", lambda w: w.isin(words.CONNECTIVES)) | F.forall("__loose", near)
    numbers = lambda x: F.regexp_extract_all(x, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))
    stated = (F.col("__nanswer") != "") & F.contains("__nevidence", F.col("__nanswer"))
    answer = (text("kind") == "true-false") | stated | ((F.size("__tanswer") > 0) & linked & (F.size(F.array_except(numbers(text("answer")), numbers(text("evidence")))) == 0))
    blank = (
        (F.regexp_count(text("prompt"), F.lit("_{3,}")) == 1) & (F.col("__nanswer") != "") & ~F.col("__nanswer").isin(words.GENERIC_BLANKS) & F.size("__tanswer").between(1, 6)
        & F.contains("__nevidence", F.col("__nanswer")) & (F.size("__tprompt") >= 4) & text("knowledge").isin(words.BLANK_KNOWLEDGE)
    )
    false = F.col("__nanswer") == "false"
    swapped = F.size(F.array_except("__tprompt", "__tbasis"))
    common = lambda a: F.size(F.array_intersect(a, "__tevidence"))
    statement = (
        (F.size("__tprompt") >= 4) & ~F.rtrim(text("prompt")).endswith("?") & (F.col("__nprompt") != F.col("__nevidence"))
        & (common("__tprompt") >= F.when(false, 0.45).otherwise(0.65) * F.size("__tprompt"))
        & (F.size(F.array_except("__tprompt", "__tevidence")) <= F.when(false, F.greatest(F.lit(2), swapped)).otherwise(2))
        & (~false | ((F.length(F.trim(text("basis"))) >= 8) & (F.size("__tbasis") > 0) & (common("__tbasis") >= 0.7 * F.size("__tbasis"))))
        & (text("skill") != "factual_recall")
    )
    asked, skill = fn.classified(text("prompt"), words.SKILLS), text("skill")
    task = reduce(lambda a, b: a | b, [F.contains("__nprompt", F.lit(t)) for t in words.APPLICATION_TASKS])
    shape = (
        F.when(text("facet") != "", True).when(skill == "application", task).when(skill.isin("comparison", "cause_effect", "process_order", "analysis"), asked == skill)
        .when(skill == "classification", asked.isin("classification", "comparison", "understanding", "factual_recall")).when(skill == "misconception", (text("kind") == "true-false") | (asked == "misconception")).otherwise(True)
    )
    return rows.withColumns({"answer_backed": answer, "blank_sound": blank, "statement_sound": statement, "shape_sound": shape}).drop(*[f"__t{n}" for n in ("answer", "evidence", "prompt", "basis")], *[f"__n{n}" for n in ("answer", "evidence", "prompt")], "__loose")


def grounding_class(reason: Column) -> Column:
    """What a rejection says of the document: unsupported_by_pdf, or validator_false_negative where a rule missed a sound question."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in words.UNSUPPORTED]), "unsupported_by_pdf").otherwise("validator_false_negative")


def finally_rejected(questions: DataFrame, allowed: list[str]) -> DataFrame:
    """Questions of finished quizzes with `reason`: the first structural rule that they break, null if none.

    questions: kind, prompt, answer, options, pages, read_pages, traced (is there a plan behind it), known (is the
    concept in the study map). Null arrays are empty.
    """
    none = F.array().cast("array<string>")
    options = F.filter(F.transform(F.coalesce("options", none), lambda o: F.trim(F.coalesce(o, F.lit("")))), lambda o: o != "")
    rows = questions.withColumns({"__o": F.transform(options, lambda o: fn.normal(o)), "__p": F.coalesce("pages", F.array().cast("array<int>"))})
    offered = F.col("kind").isin("mcq", "true-false")
    answer = F.trim(F.coalesce("answer", F.lit("")))
    reason = first_reason([
        (~F.coalesce("traced", F.lit(False)), "no provenance"), (~F.coalesce("known", F.lit(False)), "concept not in study map"), (~F.coalesce(F.col("kind").isin(allowed), F.lit(False)), "type not requested"),
        (F.size("__p") == 0, "no source page"), (F.size(F.array_except("__p", F.coalesce("read_pages", F.array().cast("array<int>")))) > 0, "page not extracted"), (answer == "", "empty answer"),
        (offered & (F.size("__o") < 2), "too few options"), (offered & (F.size(F.array_distinct("__o")) < F.size("__o")), "duplicate options"),
        (offered & ~F.array_contains("__o", fn.normal(answer)), "answer not among options"), ((F.col("kind") == "fill-blank") & ~usable_blank(F.coalesce("prompt", F.lit("")), answer), "no usable blank"),
    ])
    return rows.withColumn("reason", reason).drop("__o", "__p")


def findings(questions: DataFrame) -> DataFrame:
    """quiz_id, id, severity, message: every data-quality finding on the questions of finished quizzes; id is null for those on a quiz.

    questions: quiz_id, id, kind, prompt, answer, explanation, options, evidence, concept, skill, target, facet.
    On a question: articles that collide, texts that end in the middle, prompts without an end, answers of one word,
    contrast clauses, lists as reasons, metadata, wording games, named stems, agentive stems on principles, false
    statements without their reason, unfinished explanations, answers that the evidence lacks, copied sentences,
    choices (count, answer, repeats, lengths, notation, near-equal pairs) and tier 3. On a quiz: statements all
    true or all false, a target asked twice, half the questions on one skill. Null texts are empty.
    """
    names = ("prompt", "answer", "explanation", "evidence", "concept", "skill", "target", "facet")
    rows = questions.withColumns({n: F.trim(F.coalesce(F.col(n), F.lit(""))) for n in names}).withColumn("options", F.coalesce("options", F.array().cast("array<string>")))
    flat = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    count = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    rows = rows.withColumns({"__need": F.array_distinct(fn.content_tokens(F.col("answer"))), "__have": F.array_distinct(fn.content_tokens(F.col("evidence"))), "__sizes": F.transform("options", count), "__flat": F.transform("options", flat)})
    rows = rows.withColumns({"__tokens": F.transform("options", lambda o: F.array_distinct(fn.content_tokens(o))), "__signs": F.transform("options", lambda o: o.rlike("[=<>≤≥]"))})
    p, a, e = F.col("prompt"), F.col("answer"), F.col("explanation")
    statement, choice = F.col("kind") == "true-false", F.col("kind") == "mcq"
    cut = lambda x: F.regexp_replace(x, "[ .?]+$", "").rlike(words.CUT_OFF)
    false, low = F.lower(a) == "false", F.lower(e)
    own_sign = F.get("__signs", F.array_position("options", a).cast("int") - 1)
    signs = F.size(F.filter("__signs", lambda s: s))
    pair = F.exists(F.sequence(F.lit(1), F.greatest(F.size("options"), F.lit(1))), lambda i: F.exists(F.slice("__tokens", i + 1, F.lit(_MANY)), lambda b: fn.jaccard(F.get("__tokens", i - 1), b) >= 0.8))
    rules = [
        ("DEFECT", "article collision", p.rlike(words.DOUBLE_ARTICLE) | a.rlike(words.DOUBLE_ARTICLE)),
        ("DEFECT", "prompt ends mid-phrase", (p != "") & ~p.endswith("?") & cut(p)), ("DEFECT", "answer ends mid-phrase", (a != "") & cut(a)),
        ("DEFECT", "prompt has no terminal punctuation", (p != "") & ~p.rlike("[?.:]$")), ("WARN", "answer is a single token", (a != "") & F.col("kind").isin("short-answer", "mcq") & (count(a) < 2)),
        ("DEFECT", "answer carries a contrast clause", ~statement & a.rlike(words.CONTRAST_TAIL)), ("DEFECT", "reason answered by a bare list", ~statement & p.rlike(r"(?i)^(?:why|how)\b") & ~a.rlike(words.ANY_VERB) & F.contains(a, F.lit(","))),
        ("DEFECT", "prompt asks about metadata", p.rlike(words.META_SUBJECT)), ("DEFECT", "wording-game stem", p.rlike(words.WORDING_GAME)), ("DEFECT", "named-unacceptable stem", F.lower(p).isin(words.NAMED_BAD_STEMS)),
        ("DEFECT", "agentive stem on a principle", p.rlike(words.AGENTIVE_STEM) & F.col("concept").rlike(words.PRINCIPLE_NAME)),
        ("DEFECT", "false answer explained as correct", false & F.contains(low, F.lit("original relationship is correct"))),
        ("DEFECT", "falsehood not explained", false & ~F.contains(low, F.lit("original relationship is correct")) & ~e.rlike(r"(?i)\bfalse\b|\bnot\b|\bincorrect\b")),
        ("DEFECT", "explanation is not a complete sentence", (e != "") & ~e.rlike("[.?!]$")),
        ("DEFECT", "answer largely absent from evidence", ~statement & (a != "") & (F.size(F.array_except("__need", "__have")) > 0.5 * F.greatest(F.size("__need"), F.lit(1)))),
        ("DEFECT", "prompt copies the source", (F.regexp_replace(flat(p), "[?.]+$", "") != "") & (F.regexp_replace(flat(p), "[?.]+$", "") == F.regexp_replace(flat(F.col("evidence")), r"\.+$", ""))),
        ("DEFECT", "choice without four options", choice & (F.size("options") != 4)), ("DEFECT", "answer not once among options", choice & (F.size(F.filter("options", lambda o: o == a)) != 1)),
        ("DEFECT", "duplicate options", choice & (F.size(F.array_distinct("__flat")) < F.size("__flat"))), ("WARN", "length giveaway", choice & (F.size("options") > 0) & (F.array_max("__sizes") >= 3 * F.greatest(F.lit(1), F.array_min("__sizes")))),
        ("DEFECT", "notation giveaway", choice & (signs == 1) & (F.size("options") > 1) & F.coalesce(own_sign, F.lit(False))), ("WARN", "near-equal options", choice & pair),
        ("DEFECT", "tier 3", exam.tier(F.when(F.col("facet") != "", F.col("facet")), F.col("skill")) == 3),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for s, m, holds in rules]))
    single = rows.select("quiz_id", "id", F.explode(found).alias("f")).select("quiz_id", "id", "f.severity", "f.message")
    n, told = F.count_if(statement), F.count_if(statement & (F.lower(a) == "true"))
    by_skill = rows.groupBy("quiz_id", "skill").agg(F.count("*").alias("n")).groupBy("quiz_id").agg(F.max("n").alias("most"), F.sum("n").alias("questions"))
    again = rows.groupBy("quiz_id", "target").agg(F.count("*").alias("n")).groupBy("quiz_id").agg(F.max("n").alias("repeats"))
    quiz = rows.groupBy("quiz_id").agg(n.alias("n"), told.alias("told")).join(by_skill, "quiz_id").join(again, "quiz_id")
    whole = [
        ("DEFECT", "uniform truth of statements", (F.col("n") >= 2) & ((F.col("told") == 0) | (F.col("told") == F.col("n")))), ("DEFECT", "duplicate knowledge target", F.col("repeats") > 1),
        ("WARN", "skill concentration", F.col("most") > F.greatest(F.lit(2), F.floor(F.col("questions") / 2))),
    ]
    told_of_quiz = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for s, m, holds in whole]))
    return single.union(quiz.select("quiz_id", F.lit(None).cast(single.schema["id"].dataType).alias("id"), F.explode(told_of_quiz).alias("f")).select("quiz_id", "id", "f.severity", "f.message"))


def totals(found: DataFrame) -> DataFrame:
    """severity, message, findings, quizzes: how often each finding stands, each severity (message null) and all (both null)."""
    rows = found.rollup("severity", "message").agg(F.count("*").alias("findings"), F.count_distinct("quiz_id").alias("quizzes"), F.grouping_id().alias("level"))
    return rows.select("severity", "message", "findings", "quizzes", "level")
