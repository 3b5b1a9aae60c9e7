"""Planning, scoring, gating and choosing of questions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.functions.study import fixed, half_even
from lyceum.sources.shared import stored

#: Tasks a core that rows are dealt to where each costs much.
TASKS = 4
# Shares of the quality score.
QUALITY = {"importance": 0.25, "grounding": 0.20, "conceptual": 0.15, "clarity": 0.10, "distractors": 0.10, "cognitive": 0.10, "novelty": 0.05, "difficulty": 0.05}
# Worth of the skills; what no rule names is worth 0.65.
COGNITIVE = {"factual_recall": 0.55, "understanding": 0.80, "process_order": 0.86, "misconception": 0.86, "cause_effect": 0.92, "comparison": 0.92, "application": 1.0, "analysis": 1.0}
# What a question must reach, in the order in which failures are told.
GATES = [("importance", 0.50), ("grounding", 0.72), ("clarity", 0.70), ("conceptual", 0.58), ("distractors", 0.55), ("total", 0.68)]
# Skills whose questions ask for reasoning.
REASONING = ["cause_effect", "comparison", "process_order", "analysis", "classification", "application", "misconception"]
# Shares of the importance of a concept.
INTRINSIC = {"type_value": 0.65, "depth": 0.35}
STRUCTURAL = {"centrality": 0.30, "richness": 0.25, "emphasis": 0.20, "prerequisite": 0.13, "spread": 0.12}
STRUCTURAL_SHARE, STRUCTURAL_FLOOR = 0.55, 6
UNEXPLAINED, EXAMPLE = 0.30, 0.60


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def weighted(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * F.col(name) for name, w in weights.items()])


def cognitive_value(skill: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COGNITIVE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, skill), F.lit(0.65))


def difficulty_match(own: Column, asked: Column) -> Column:
    """1, 0.5 or 0.2 by the distance of the grades; 1 for mixed."""
    grade = lambda x: F.when(x == "easy", 0).when(x == "hard", 2).otherwise(1)
    apart = F.abs(grade(own) - grade(asked))
    return F.when((asked == "mixed") | (own == asked), 1.0).when(apart == 0, 1.0).when(apart == 1, 0.5).otherwise(0.2)


def clarity(prompt: Column, kind: Column, options: Column) -> Column:
    words = F.size(F.regexp_extract_all(prompt, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    odd = F.when(prompt.rlike(r"(?i)\b(thing|stuff|something|it above|the text above)\b"), 0.45).otherwise(1.0)
    bare = F.when(kind.isin("mcq", "true-false") & (F.coalesce(F.size(options), F.lit(0)) <= 0), 0.2).otherwise(1.0)
    blank = F.when((kind == "fill-blank") & (F.regexp_count(prompt, F.lit("_{3,}")) != 1), 0.2).otherwise(1.0)
    return F.when((words < 3) | (F.length(prompt) < 8) | (F.length(prompt) > 600), 0.35).otherwise(odd * bare * blank)


def distractor_quality(answer: Column, options: Column, vocabulary: Column) -> Column:
    """Shape of the four options, times the mean of three checks of the wrong ones; 0 where the options don't serve."""
    norm = F.transform(options, lambda o: fn.normal(o))
    key = fn.normal(answer)
    sound = (F.size(options) == 4) & ~F.exists(norm, lambda o: o == "") & (F.size(F.array_distinct(norm)) == 4) & F.array_contains(norm, key)
    sizes = F.transform(options, lambda o: F.greatest(F.lit(1), F.size(fn.content_tokens(o))))
    shape = F.when(F.array_max(sizes) <= F.greatest(F.lit(5), F.array_min(sizes) * 4), 1.0).otherwise(0.55)
    number = r"\d|[=+*/^]"
    numeric = F.when(answer.rlike(number) & (F.size(F.filter(options, lambda o: o.rlike(number))) < 3), 0.4).otherwise(1.0)
    to = F.when(F.lower(F.trim(answer)).startswith("to ") & (F.size(F.filter(options, lambda o: F.lower(o).startswith("to "))) < 3), 0.65).otherwise(1.0)
    absurd = r"\b(banana|purple elephant|unicorn|magic|random answer|i don t know|none of the above|all of the above|zzzz)\b"

    def one(o: Column) -> Column:
        o = F.trim(o)
        length = F.when((F.length(o) < 2) | (F.length(o) > 400), 0.25).otherwise(1.0)
        known = F.when(F.arrays_overlap(fn.content_tokens(o), vocabulary), 1.0).otherwise(0.25)
        a, b = F.length(o), F.length(F.trim(answer))
        ratio = F.when(F.greatest(a, b) / F.greatest(F.lit(1), F.least(a, b)) > 5, 0.45).otherwise(1.0)
        return F.when(fn.normal(o).rlike(absurd), 0.0).otherwise(length * known * ratio)

    wrong = F.filter(options, lambda o: fn.normal(o) != key)
    mean = F.aggregate(wrong, F.lit(0.0), lambda s, o: s + one(o)) / 3.0
    return F.when(sound, clamp(shape * numeric * to * mean)).otherwise(0.0)


def scored(rows: DataFrame) -> DataFrame:
    """rows, with the parts of QUALITY as columns, with total."""
    return rows.withColumn("total", half_even(weighted(QUALITY), 4))


def gated(rows: DataFrame) -> DataFrame:
    """rows with reasons: the gates that a question doesn't pass; none where it passes all. A null score is 0."""
    score = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    failed = F.array_compact(F.array(*[F.when(score(name) < least, F.concat(F.lit(f"{name} "), fixed(score(name), 2), F.lit(f"<{least:.2f}"))) for name, least in GATES]))
    return rows.withColumn("reasons", F.array_join(failed, "; "))


def tier(facet: Column, skill: Column) -> Column:
    return F.when((F.coalesce(facet, F.lit("")) != "") | skill.isin(REASONING), 1).when(skill == "understanding", 2).otherwise(3)


def importance(rows: DataFrame) -> DataFrame:
    """rows (signals of INTRINSIC and STRUCTURAL, type, tokens, emphasis_hint, concepts) with importance, to three digits."""
    share = F.lit(STRUCTURAL_SHARE) * F.least(F.lit(1.0), F.col("concepts") / STRUCTURAL_FLOOR)
    hint = F.when(F.col("emphasis_hint") == "high", 0.04).when(F.col("emphasis_hint") == "low", -0.06).otherwise(0.0)
    raw = (1 - share) * weighted(INTRINSIC) + share * weighted(STRUCTURAL) + hint
    explained = F.when(F.col("tokens") < 5, F.least(raw, F.lit(UNEXPLAINED))).otherwise(raw)
    example = F.when(F.col("type") == "example", F.least(explained, F.lit(EXAMPLE))).otherwise(explained)
    fact = F.when((F.col("type") == "fact") & (F.col("tokens") < 18), F.least(example, F.lit(0.5))).otherwise(example)
    return rows.withColumn("importance", half_even(clamp(fact), 3))


def anchored(rows: DataFrame) -> DataFrame:
    """rows (doc_id, concept, importance) rescaled so that the middle of the 3 to 8 leading concepts stands at 0.78; never lowered.

    Where rows have tokens and type, rescaling lifts no concept that isn't explained, and no example, over its ceiling.
    """
    one = Window.partitionBy("doc_id")
    ranked = rows.withColumn("__k", F.row_number().over(one.orderBy(F.desc("importance"), "concept"))).withColumn("__n", F.count("*").over(one))
    leading = F.least(F.col("__n"), F.greatest(F.lit(3), F.least(F.lit(8), F.col("__n"))))
    anchor = F.max(F.when(F.col("__k") == F.floor(leading / 2) + 1, F.col("importance"))).over(one)
    scale = F.when(anchor > 0, F.greatest(F.lit(1.0), 0.78 / anchor)).otherwise(1.0)
    ranked = ranked.withColumn("__scale", scale).withColumn("__new", clamp(F.col("importance") * F.col("__scale")))
    if {"tokens", "type"} <= set(rows.columns):
        ranked = ranked.withColumn("__new", _under_ceilings(F.col("__new")))
    new = F.when(F.col("__scale") > 1, half_even(F.col("__new"), 3)).otherwise(half_even(F.col("importance"), 3))
    return ranked.withColumn("importance", new).drop("__k", "__n", "__scale", "__new")


def _under_ceilings(value: Column) -> Column:
    explained = F.when(F.col("tokens") < 5, F.least(value, F.lit(UNEXPLAINED))).otherwise(value)
    return F.when(F.col("type") == "example", F.least(explained, F.lit(EXAMPLE))).otherwise(explained)


def raised(rows: DataFrame) -> DataFrame:
    """Concepts with degree (central()), their importance reckoned again where they have relations; never lowered.

    The shares are those of a document with structure to show, whatever its size; ceilings hold as before.
    """
    shares = {n: round(w * (1 - STRUCTURAL_SHARE), 4) for n, w in INTRINSIC.items()} | {n: round(w * STRUCTURAL_SHARE, 4) for n, w in STRUCTURAL.items()}
    new = half_even(clamp(F.greatest("importance", _under_ceilings(weighted(shares)))), 3)
    return rows.withColumn("importance", F.when(F.col("degree") > 0, new).otherwise(F.col("importance")))


def leading_concepts(rows: DataFrame, ratio: float = 0.62) -> DataFrame:
    """Of rows (doc_id, concept, importance, value, developed): the developed ones where there are more than six and three of
    them are developed; of more than three, those that reach ratio times the middle of the leading ones, if three do."""
    one = Window.partitionBy("doc_id")
    order = one.orderBy(F.desc("importance"), F.desc("value"), F.lower("concept"))
    n, d = F.count("*").over(one), F.count_if("developed").over(one)
    first = rows.withColumn("__pick", ~((n > 6) & (d >= 3)) | F.col("developed")).filter("__pick")
    ranked = first.withColumn("__k", F.row_number().over(order)).withColumn("__n", F.count("*").over(one))
    lead = F.least(F.col("__n"), F.greatest(F.lit(3), F.least(F.lit(8), F.col("__n"))))
    middle = F.max(F.when(F.col("__k") == F.floor(lead / 2) + 1, F.col("importance"))).over(one)
    good = F.col("importance") >= middle * ratio
    marked = ranked.withColumn("__good", good).withColumn("__m", F.count_if(F.col("__good")).over(one))
    return marked.filter((F.col("__n") <= 3) | (F.col("__m") < 3) | F.col("__good")).drop("__pick", "__k", "__n", "__good", "__m")


def central(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts (doc_id, concept, centrality, importance) with degree, and centrality raised by it: degree / max(3, n / 2).

    edges: (doc_id, source, target), counted at both ends.
    """
    ends = edges.select("doc_id", F.explode(F.array("source", "target")).alias("concept"))
    degree = ends.groupBy("doc_id", "concept").agg(F.count("*").alias("degree"))
    found = concepts.join(degree, ["doc_id", "concept"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    raised = half_even(clamp(F.col("centrality") + F.col("degree") / F.greatest(F.lit(3.0), n * 0.5)), 3)
    return found.withColumn("centrality", F.when(F.col("degree") > 0, raised).otherwise(F.col("centrality")))


def novelty(rows: DataFrame, history: DataFrame) -> DataFrame:
    """rows (quiz_id, id, tokens) with novelty: 1 less the highest similarity with a past question (quiz_id, past).

    Questions and past ones of a quiz meet where they share a token; without any the novelty is 1.
    """
    a = rows.select("quiz_id", "id", F.array_distinct("tokens").alias("ta"), F.explode(F.array_distinct("tokens")).alias("token"))
    b = history.select("quiz_id", F.array_distinct("past").alias("tb"), F.explode(F.array_distinct("past")).alias("token"))
    most = a.join(b, ["quiz_id", "token"]).groupBy("quiz_id", "id").agg(F.max(fn.jaccard(F.col("ta"), F.col("tb"))).alias("most"))
    return rows.join(most, ["quiz_id", "id"], "left").withColumn("novelty", 1 - F.coalesce("most", F.lit(0.0))).drop("most")


def best_of_each(rows: DataFrame) -> DataFrame:
    """Rows (quiz_id, id, score, objective, target, concept, skill, prompt) kept in order of score unless a kept row of the quiz
    has the same objective, target, (concept, skill) or prompt. Each choice bears on the next, so quizzes are taken whole."""

    def run(quiz: pd.DataFrame) -> pd.DataFrame:
        seen: set = set()
        kept = []
        for r in quiz.sort_values(["score", "id"], ascending=[False, True]).itertuples(index=False):
            marks = [(k, v) for k, v in (("o", r.objective), ("t", r.target), ("c", (r.concept, r.skill) if r.concept else None), ("p", r.prompt)) if v]
            if not seen.intersection(marks):
                seen.update(marks)
                kept.append((r.quiz_id, r.id))
        return pd.DataFrame(kept, columns=["quiz_id", "id"])

    columns = ["quiz_id", "id", "score", "objective", "target", "concept", "skill", "prompt"]
    return rows.select(*columns).groupBy("quiz_id").applyInPandas(run, "quiz_id long, id long")


def jitter(seed: int, candidate: object) -> float:
    """0 to 0.008, from the seed and the candidate alone, so that no order of evaluation matters."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{candidate}".encode(), digest_size=8).digest(), "big") / 2.0**64 * 0.008


class _Chooser:
    """One quiz: candidates, what the chosen ones have used up, and the gates in force."""

    def __init__(self, rows: Iterable, seed: int, gates: set[str]):
        self.pool = sorted(rows, key=lambda r: (-r.score, r.id))
        self.seed, self.gates = seed, gates
        self.objectives: set = set()
        self.claims: list[frozenset] = []
        self.counts: dict[str, Counter] = {k: Counter() for k in ("skill", "pattern", "concept", "category", "page", "truth")}
        self.concepts = len({r.concept.casefold() for r in self.pool if r.concept})

    def barred(self, r) -> bool:
        if r.objective and ("objective", r.objective) in self.objectives or r.concept and r.target and ("target", r.concept, r.target) in self.objectives:
            return True
        if "pairs" in self.gates and r.pair and ("pair", r.pair) in self.objectives:
            return True
        claim = frozenset(r.claim)
        if "claims" in self.gates and len(claim) >= 4 and any(len(claim & c) >= 0.7 * len(claim | c) for c in self.claims):
            return True
        again = self.counts["concept"][r.concept.casefold()]
        return "breadth" in self.gates and bool(again) and len(self.counts["concept"]) < self.concepts

    def value(self, r) -> float:
        n = self.counts
        cost = 0.18 * n["skill"][r.skill] + 0.08 * n["pattern"][r.pattern] + 0.45 * n["concept"][r.concept.casefold()]
        cost += (0.05 * n["category"][r.category] if r.category else 0) + sum(0.035 * n["page"][p] for p in r.pages)
        if r.truth is not None:
            own, other = n["truth"][bool(r.truth)], n["truth"][not r.truth]
            if own >= max(1, other):
                cost += 0.16 + 0.30 * abs(own - other)
        return r.score - cost + jitter(self.seed, r.id)

    def take(self, count: int) -> list:
        chosen = []
        while len(chosen) < count:
            free = [r for r in self.pool if not self.barred(r)]
            if not free:
                break
            best = max(free, key=self.value)
            self.pool.remove(best)
            chosen.append(best)
            self.objectives |= {("objective", best.objective), ("target", best.concept, best.target), ("pair", best.pair)}
            if len(best.claim) >= 4:
                self.claims.append(frozenset(best.claim))
            for kind, what in (("skill", best.skill), ("pattern", best.pattern), ("concept", best.concept.casefold()), ("category", best.category)):
                self.counts[kind][what] += 1
            self.counts["page"].update(best.pages)
            if best.truth is not None:
                self.counts["truth"][bool(best.truth)] += 1
        return chosen


def choose(candidates: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """quiz_id, id, place, relaxed: `count` questions per quiz, one at a time, each the best by score less what it repeats.

    candidates: quiz_id, id, score, concept, skill, pattern, objective, target, category, pair (null but for
    comparisons), claim (tokens asserted), pages, truth (null but for true/false). Same objectives and same
    (concept, target) never come twice. Claims of 0.7 similarity, mirrored comparisons and second questions on a
    concept while others have none are barred too, and let in again, in this order, while a quiz falls short.
    """
    relaxable = ("claims", "pairs", "breadth")

    def run(quiz: pd.DataFrame) -> pd.DataFrame:
        rows = [r._replace(claim=[] if r.claim is None else list(r.claim), pages=[] if r.pages is None else list(r.pages), truth=None if pd.isna(r.truth) else bool(r.truth)) for r in quiz.itertuples(index=False)]
        token = random.Random(seed).getrandbits(32)
        best, dropped = [], 0
        for k in range(len(relaxable) + 1):
            found = _Chooser(rows, token, set(relaxable[k:])).take(count)
            if len(found) > len(best):
                best, dropped = found, k
            if len(best) >= count:
                break
        return pd.DataFrame([(r.quiz_id, r.id, i, dropped) for i, r in enumerate(best, 1)], columns=["quiz_id", "id", "place", "relaxed"])

    columns = ["quiz_id", "id", "score", "concept", "skill", "pattern", "objective", "target", "category", "pair", "claim", "pages", "truth"]
    return candidates.select(*columns).groupBy("quiz_id").applyInPandas(run, "quiz_id long, id long, place int, relaxed int")


def plan(targets: DataFrame, count: int, types: list[str], seed: int = 1) -> DataFrame:
    """doc_id, id, place, type: question slots for the knowledge targets of each document.

    targets: doc_id, id, concept, skill, facet, importance, topic, pages, writable (types that can be written).
    Each slot goes to the target of the highest value: importance, tier, preference of skill, a stated facet, and
    what is new in skill, type, topic and page, less what the concept already has while others have nothing.
    Recognition (recall and understanding) is held to 40 % of the quiz where there is reasoning to ask for; a
    concept that has something richer isn't asked by recall. Both rules are let go, in turn, while slots lack.
    """
    order = ["cause_effect", "comparison", "process_order", "application", "analysis", "misconception", "classification", "understanding", "factual_recall"]
    recognition = {"factual_recall", "understanding"}

    def run(doc: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(seed ^ 0x5EEDB10E)
        rows = [(r, [x for x in types if x in set(r.writable)]) for r in doc.sort_values("id").itertuples(index=False)]
        left = [(r, t) for r, t in rows if t]
        grade = lambda r: 1 if r.facet or r.skill in REASONING else 2 if r.skill == "understanding" else 3
        reasoning = sum(r.skill not in recognition for r, _ in left)
        budget = max(round(count * 0.4), 1, count - reasoning) if reasoning else count
        rich = {r.concept for r, _ in left if grade(r) < 3}
        concepts, n = len({r.concept for r, _ in left}), {k: Counter() for k in ("concept", "skill", "type", "topic", "page")}
        wanted, slots = min(24, max(count + 4, 2 * count)), []

        def fill(limit: int, cap: bool, last_resort: bool) -> None:
            while len(slots) < limit:
                best = None
                for r, can in left:
                    easy = r.skill in recognition
                    if easy and cap and sum(s.skill in recognition for s, _ in slots) >= budget or last_resort and grade(r) == 3 and r.concept in rich:
                        continue
                    kind = min(can, key=lambda t: (easy and "mcq" in can and t != "mcq", n["type"][t], types.index(t)))
                    value = 1.6 * r.importance + (1.10, 0.35, 0.0)[grade(r) - 1] + 0.55 * bool(r.facet)
                    value -= 3.0 * n["concept"][r.concept] if len(n["concept"]) < concepts else 0
                    value += 0.30 * (1 - (order.index(r.skill) if r.skill in order else len(order)) / len(order))
                    value += 0.45 / (1 + n["skill"][r.skill]) + 0.20 / (1 + n["type"][kind]) + 0.18 / (1 + n["topic"][r.topic])
                    value += sum(0.06 / (1 + n["page"][p]) for p in list(r.pages)[:2]) + rng.random() * 0.22
                    if best is None or value > best[0]:
                        best = value, r, can, kind
                if best is None:
                    return
                _, r, can, kind = best
                left.remove((r, can))
                slots.append((r, kind))
                for k, what in (("concept", r.concept), ("skill", r.skill), ("type", kind), ("topic", r.topic)):
                    n[k][what] += 1
                n["page"].update(list(r.pages))

        fill(wanted, True, True)
        for cap in (True, False):
            if len(slots) < count:
                fill(count, cap, False)
        return pd.DataFrame([(r.doc_id, r.id, i, kind) for i, (r, kind) in enumerate(slots, 1)], columns=["doc_id", "id", "place", "type"])

    columns = ["doc_id", "id", "concept", "skill", "facet", "importance", "topic", "pages", "writable"]
    dealt = targets.select(*columns).repartition(TASKS * targets.sparkSession.sparkContext.defaultParallelism, "doc_id")  # few bytes, but much work
    return dealt.groupBy("doc_id").applyInPandas(run, "doc_id long, id long, place int, type string")


def funnel(rows: DataFrame) -> DataFrame:
    """quiz_id with counts of planned, passed and rejected questions, and of rejections by gate."""
    by_gate = [F.count_if(F.contains("reasons", F.lit(name + " "))).alias(f"failed_{name}") for name, _ in GATES]
    return rows.groupBy("quiz_id").agg(F.count("*").alias("planned"), F.count_if(F.col("reasons") == "").alias("passed"), F.count_if(F.col("reasons") != "").alias("rejected"), *by_gate)


def audit(questions: DataFrame) -> DataFrame:
    """quiz_id, id, severity, message: data-quality findings on questions (quiz_id, id, kind, prompt, answer, options, pages)."""
    finding = lambda cond, severity, message: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))
    norm = F.transform("options", lambda o: fn.normal(o))
    repeated = F.count("*").over(Window.partitionBy("quiz_id", fn.normal(F.col("prompt")))) > 1
    rows = questions.withColumn("__again", repeated)
    found = F.array_compact(F.array(
        finding(F.trim("prompt") == "", "defect", "empty prompt"),
        finding(F.col("__again"), "defect", "repeated prompt"),
        finding(F.size(fn.furniture(F.col("prompt"))) > 0, "defect", "furniture in prompt"),
        finding(fn.trivial_question(F.col("prompt")), "warning", "trivial prompt"),
        finding((F.col("kind") == "mcq") & (F.size("options") != 4), "defect", "not four options"),
        finding(F.size(F.array_distinct(norm)) < F.size("options"), "defect", "equal options"),
        finding((F.col("kind") == "mcq") & ~F.array_contains(norm, fn.normal(F.col("answer"))), "defect", "answer not among options"),
        finding(F.size("pages") == 0, "warning", "no source page"),
        finding((F.col("kind") == "fill-blank") & (F.regexp_count("prompt", F.lit("_{3,}")) != 1), "defect", "not one blank"),
        finding(F.length("prompt") > 600, "warning", "long prompt"),
    ))
    return rows.select("quiz_id", "id", F.explode(found).alias("f")).select("quiz_id", "id", "f.severity", "f.message")


#: Rounds in which a short quiz is planned anew, and what a round adds to the seed.
ROUNDS, SEED_STEP = 3, 7919


def topped_up(pool: DataFrame, targets: DataFrame, write: Callable[[DataFrame], DataFrame], count: int, types: list[str], seed: int = 1) -> DataFrame:
    """pool (quiz_id, id, concept, objective) with `round`, filled up from targets: 0 for what was there.

    targets: as for plan(), with quiz_id for doc_id, and objective and important. A quiz takes part in a round while
    its pool is short of `count` or lacks an important concept that has targets. Its targets are planned again with
    another seed, without the objectives that the pool holds or an earlier round has tried; write turns planned
    rows (quiz_id, id, place, type) into candidates that passed all gates (quiz_id, id, concept, objective). A
    candidate whose objective the pool has is dropped; of several the smallest id stays. A quiz to which a round
    adds nothing is done; at most three rounds. Each round's rows are a table of the shared folder, so a round
    costs nothing twice. Rows of targets with a null quiz_id or objective count for nothing.
    """
    columns = ["quiz_id", "id", "concept", "objective"]
    held = stored(pool.select(*columns).withColumn("round", F.lit(0)), "pool")
    targets = stored(targets.filter("quiz_id is not null and objective is not null"), "targets")
    tried = held.select("quiz_id", "objective").limit(0)
    done = held.select("quiz_id").limit(0)
    for number in range(1, ROUNDS + 1):
        taken = held.groupBy("quiz_id").agg(F.count("*").alias("n"))
        missing = targets.filter("important").join(held.select("quiz_id", "concept").distinct(), ["quiz_id", "concept"], "left_anti").select("quiz_id").distinct().withColumn("missing", F.lit(True))
        short = targets.select("quiz_id").distinct().join(taken, "quiz_id", "left").join(missing, "quiz_id", "left").filter((F.coalesce("n", F.lit(0)) < count) | F.col("missing").isNotNull()).join(done, "quiz_id", "left_anti").select("quiz_id")
        seen = held.select("quiz_id", "objective").union(tried).distinct()
        free = targets.join(short, "quiz_id", "left_semi").join(seen, ["quiz_id", "objective"], "left_anti")
        slots = plan(free.withColumnRenamed("quiz_id", "doc_id"), count, types, seed + SEED_STEP * number).withColumnRenamed("doc_id", "quiz_id")
        slots = stored(slots, "slots")
        planned = targets.join(slots.select("quiz_id", "id"), ["quiz_id", "id"]).select("quiz_id", "objective")
        first = F.row_number().over(Window.partitionBy("quiz_id", "objective").orderBy("id"))
        new = write(slots).select(*columns).join(held.select("quiz_id", "objective"), ["quiz_id", "objective"], "left_anti").withColumn("__k", first).filter("__k = 1")
        new = stored(new.select(*columns, F.lit(number).alias("round")), "added")
        if new.isEmpty():
            break
        done = stored(done.union(short.join(new.select("quiz_id").distinct(), "quiz_id", "left_anti")), "done")
        tried = stored(tried.union(planned), "tried")
        held = held.union(new)
    return held


class MaterialError(ValueError):
    """A quiz can't be as long as asked: what the documents support is less. Nothing is made up to fill it."""

    def __init__(self, quiz_id: object, requested: int, available: int, reason: str, funnel: dict, quizzes: int):
        super().__init__(f"{quizzes} quizzes fall short; quiz {quiz_id}: {available} of {requested} questions ({reason}); {funnel}")
        self.quiz_id, self.requested, self.available, self.reason, self.funnel, self.quizzes = quiz_id, requested, available, reason, funnel, quizzes


def shortfalls(chosen: DataFrame, asked: DataFrame) -> DataFrame:
    """quiz_id, requested, available, reason, and the counts of the funnel: quizzes (asked) with fewer questions (chosen) than asked for.

    asked: quiz_id, requested, and counts planned, passed, rejected, pages_dropped, image_pages, provider_errors; null
    counts are 0. The document alone is to blame (material) only where no provider failed before anything was
    written (provider), no page was lost in cleaning (pages dropped), and none is an image (image pages).
    """
    counts = ("planned", "passed", "rejected", "pages_dropped", "image_pages", "provider_errors")
    n = chosen.groupBy("quiz_id").agg(F.count("*").alias("available"))
    rows = asked.join(n, "quiz_id", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).filter(F.col("available") < F.col("requested"))
    reason = F.when((F.col("provider_errors") > 0) & (F.col("available") == 0), "provider").when(F.col("pages_dropped") > 0, "pages dropped").when(F.col("image_pages") > 0, "image pages").otherwise("material")
    return rows.select("quiz_id", "requested", "available", reason.alias("reason"), *counts)


def in_full(chosen: DataFrame, asked: DataFrame) -> DataFrame:
    """chosen, if every quiz has as many questions as asked for; else MaterialError with the funnel of the first that hasn't."""
    short = stored(shortfalls(chosen, asked), "shortfalls")
    first = short.orderBy("quiz_id").first()
    if first is None:
        return chosen
    funnel = {k: v for k, v in first.asDict().items() if k not in ("quiz_id", "requested", "available", "reason")}
    raise MaterialError(first["quiz_id"], first["requested"], first["available"], first["reason"], funnel, short.count())
