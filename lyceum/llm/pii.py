"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds select redactions.

Four exact patterns give the base spans, which always stay. Looser patterns, one per kind, propose further,
overlapping spans with few misses. Each proposal is described by a few small integers of format (digits,
separators, checksum, ...) and context (the characters and words around it). Gradient-boosted trees learn
from the corpus which descriptions belong to base spans; a proposal that no base span covers is added if its
score reaches the threshold of its kind, calibrated on the other half of the documents. What decides on base spans
(the checksum, the range of octets) is kept from the trees, so they judge by format and context, not by the rule.

Spans are worked on BLOCK at a time, so the work on a text grows with its spans, not with their square.

Everything that touches text or proposals is DataFrame functions. The trees are fitted on the distinct
descriptions with their counts: a table whose size the domains of the features bound (at most
MOST_DESCRIPTIONS rows, however large the corpus), and become a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import cut, held

KINDS = ("email", "ip", "card", "phone")

# The base patterns of the contract. Possessive repeats give the same matches without backtracking, as what
# follows each repeat is never in its class; an email can only begin where no letter of its class stands
# before it, or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators.
LOOSE = {
    "email": r"[^\s@<>()\[\]\x22',;:]++\x20?(?:@|\(at\)|\[at\])\x20?[^\s@<>()\[\]\x22',;:]++",
    "ip": r"[0-9]{1,4}(?:\x20?\.\x20?[0-9]{1,4}){3}",
    "card": r"[0-9](?:[\x20./-]{0,2}[0-9]){11,18}",
    "phone": r"(?:\+|00)?\x20?\(?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_CUES = r"(?i)(?:mail|tel|phone|call|fax|mobile|card|visa|iban|host|server|addr|contact|ip)[^\n]{0,12}$"

#: Features of a proposal, with the number of values of each.
FEATURES = {"kind": 4, "digits": 8, "separator": 5, "plus": 2, "domain_dots": 3, "before": 4, "after": 4, "cue": 2}
MOST_DESCRIPTIONS = math.prod(FEATURES.values())
#: Spans of a text worked on at once.
BLOCK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _holds(kind: str, match: Column) -> Column:
    """The condition on a base match; a failing match is dropped."""
    if kind == "ip":
        return match.rlike(_OCTETS)
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _worth_a_look(text: Column, kind: str, loose: bool) -> Column:
    if kind == "email":
        at = F.contains(text, F.lit("@"))
        return at | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")) if loose else at
    return F.contains(text, F.lit("+")) if kind == "phone" and not loose else text.rlike("[0-9]")


_SPAN = "array<struct<start:int,kind:int,end:int,match:string,before:string,after:string>>"


def _blocks(items: Column, size: int = BLOCK) -> Column:
    """The numbers, from 0, of the blocks that an array is cut into."""
    n = F.ceil(F.size(items) / F.lit(size)).cast("int")
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _passed(items: Column, kind: str, of, join, step, of_block=lambda before, part: F.lit(0)) -> Column:
    """What a pass over items gathers: step(at, item, own) gives an array of none or some.

    at is join of `of` of all items before, and own is of_block(at its beginning, its items) of the item's block.
    First the blocks get what is before them, then each block gathers its own, so nothing long is copied again
    and again: the work grows with the items.
    """
    size = 64
    part = lambda i: F.slice(items, i * size + 1, F.lit(size))
    totals = F.transform(_blocks(items, size), lambda i: F.aggregate(part(i), F.lit(0), lambda n, x: join(n, of(x))))

    def block(before: Column, i: Column) -> Column:
        def gathered(own: Column) -> Column:
            start = F.struct(before.alias("at"), F.array().cast(kind).alias("out"))
            within = lambda s, x: F.struct(join(s["at"], of(x)).alias("at"), F.concat(s["out"], step(s["at"], x, own)).alias("out"))
            return F.aggregate(part(i), start, within, lambda s: s["out"])

        return _let(of_block(before, part(i)), gathered)

    before = lambda t: F.transform(t, lambda _, i: F.aggregate(F.slice(t, F.lit(1), i), F.lit(0), lambda n, x: join(n, x)))
    return F.flatten(F.transform(_let(totals, before), block))


def _matches(text: Column, kind: str, loose: bool) -> Column:
    """Spans of the leftmost matches that don't overlap: start, kind, end (code points, end exclusive), match, and
    what stands around: up to 16 characters before, from the match before on, and one after.

    What stands between the matches gives their places; only matches that hold are gathered.
    """
    pattern = F.lit((LOOSE if loose else BASE)[kind])
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"))

    def described(match: Column, i: Column, f: Column) -> Column:
        gap, following = F.get(f["gaps"], i), F.concat(F.get(f["gaps"], i + 1), F.coalesce(F.get(f["matches"], i + 1), F.lit("")))
        before = F.when(F.length(gap) >= 16, F.right(gap, F.lit(16))).otherwise(F.right(F.concat(F.coalesce(F.get(f["matches"], i - 1), F.lit("")), gap), F.lit(16)))
        around = [before.alias("before"), F.left(following, F.lit(1)).alias("after")] if loose else [F.lit("").alias("before"), F.lit("").alias("after")]
        return F.struct(F.length(gap).alias("gap"), match.alias("match"), *around)

    def step(at: Column, pair: Column, _: Column) -> Column:
        start = at + pair["gap"]
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(pair["match"])).alias("end"), pair["match"].alias("match"), pair["before"].alias("before"), pair["after"].alias("after"))
        return F.array(span) if loose else F.when(_holds(kind, pair["match"]), F.array(span)).otherwise(F.array().cast(_SPAN))

    pairs = _let(found, lambda f: F.transform(f["matches"], lambda match, i: described(match, i, f)))
    spans = _let(pairs, lambda p: _passed(p, _SPAN, lambda x: x["gap"] + F.length(x["match"]), lambda a, b: a + b, step))
    return F.when(_worth_a_look(text, kind, loose), spans).otherwise(F.array().cast(_SPAN))


def _class_of(character: Column) -> Column:
    return F.when(character == "", 0).when(character.rlike(r"^\s"), 1).when(character.rlike(r"^[\p{L}\p{N}_]"), 3).otherwise(2)


def _describe(span: Column, base: Column) -> Column:
    match, digits, before = span["match"], _digits(span["match"]), span["before"]
    seps = F.regexp_replace(match, "[^\x20./()-]", "")
    return F.struct(
        span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end"),
        F.least(F.lit(7), F.greatest(F.lit(0), F.ceil((F.length(digits) - 5) / 2))).cast("int").alias("digits"),
        F.when(seps == "", 0).when(seps.rlike("^ +$"), 1).when(seps.rlike("^-+$"), 2).when(seps.rlike(r"^\.+$"), 3).otherwise(4).alias("separator"),
        match.startswith("+").cast("int").alias("plus"),
        F.least(F.lit(2), F.length(F.regexp_replace(F.regexp_extract(match, r"(?:@|\(at\)|\[at\])(.*)$", 1), r"[^.]", ""))).alias("domain_dots"),
        _class_of(F.substring(before, -1, 1)).alias("before"),
        _class_of(span["after"]).alias("after"),
        before.rlike(_CUES).cast("int").alias("cue"),
        F.exists(base, lambda b: (b["start"] == span["start"]) & (b["end"] == span["end"]) & (b["kind"] == span["kind"])).cast("int").alias("is_base"),
        F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"])).alias("covered"),
    )


def with_spans(docs: DataFrame) -> DataFrame:
    """row (the columns of docs), text (empty for null), base (the base spans, in order) and proposed (described proposals)."""
    spare = held(docs).select("row", F.coalesce(F.col("row.text"), F.lit("")).alias("text"))
    text = F.col("text")
    spare = spare.withColumn("base", F.array_sort(F.concat(*[_matches(text, k, False) for k in KINDS])))
    spare = spare.withColumn("loose", F.array_sort(F.concat(*[_matches(text, k, True) for k in KINDS])))

    def block(i: Column) -> Column:
        """The described proposals of a block; of the base spans only those around the block are compared."""
        some = F.slice("loose", i * BLOCK + 1, F.lit(BLOCK))
        least, most = F.array_min(F.transform(some, lambda s: s["start"])), F.array_max(F.transform(some, lambda s: s["end"]))
        near = _let(F.struct(least.alias("a"), most.alias("b")), lambda r: F.filter("base", lambda b: (b["start"] < r["b"]) & (b["end"] > r["a"])))
        return _let(near, lambda n: F.transform(some, lambda s: _describe(s, n)))

    return spare.withColumn("proposed", F.flatten(F.transform(_blocks(F.col("loose")), block))).drop("loose")


@dataclass
class Forest:
    """trees: (feature, value, left, right), a test `feature <= value`, or a number; thresholds by kind, None to add nothing."""

    trees: list
    thresholds: list[float | None]

    def column(self, of) -> Column:
        """The summed score as a column; of(feature) gives the feature's column."""

        def one(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(of(tree[0]) <= tree[1], one(tree[2])).otherwise(one(tree[3]))

        return reduce(lambda a, b: a + b, map(one, self.trees), F.lit(0.0))

    def score(self, row) -> float:
        def one(tree) -> float:
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        return sum(map(one, self.trees))


def fit(rows: Sequence[dict], rounds: int = 25, depth: int = 3, rate: float = 0.4, damp: float = 1.0, precision: float = 0.9) -> Forest:
    """Boosted trees (second-order, logistic loss) from descriptions with counts.

    rows: the features, half (0 to fit, 1 to calibrate), n and positive. The threshold of a kind is the lowest
    score at and above which at least `precision` of the calibrating proposals are base spans; None if there is none.
    """
    learn = [r for r in rows if r["half"] == 0 and r["n"]] or [r for r in rows if r["n"]]
    total = sum(r["n"] for r in learn)
    trees: list = []
    if total and 0 < sum(r["positive"] for r in learn) < total:
        scores = [0.0] * len(learn)

        def grow(members: list[int], slopes: list[tuple[float, float]], left: int):
            g, h = sum(slopes[i][0] for i in members), sum(slopes[i][1] for i in members)
            best = (1e-6, None, None)
            for f, size in FEATURES.items() if left else ():
                sums = [[0.0, 0.0] for _ in range(size)]
                for i in members:
                    sums[learn[i][f]][0] += slopes[i][0]
                    sums[learn[i][f]][1] += slopes[i][1]
                gl = hl = 0.0
                for v in range(size - 1):
                    gl, hl = gl + sums[v][0], hl + sums[v][1]
                    gain = gl * gl / (hl + damp) + (g - gl) ** 2 / (h - hl + damp) - g * g / (h + damp)
                    if 0 < hl < h and gain > best[0]:
                        best = gain, f, v
            if best[1] is None:
                return rate * g / (h + damp)
            _, f, v = best
            low = [i for i in members if learn[i][f] <= v]
            high = [i for i in members if learn[i][f] > v]
            return (f, v, grow(low, slopes, left - 1), grow(high, slopes, left - 1)) if low and high else rate * g / (h + damp)

        for _ in range(rounds):
            slopes = []
            for r, s in zip(learn, scores):
                p = 1 / (1 + math.exp(-max(-35.0, min(35.0, s))))
                slopes.append((r["positive"] - r["n"] * p, max(1e-9, r["n"] * p * (1 - p))))
            trees.append(grow(list(range(len(learn))), slopes, depth))
            one = Forest(trees[-1:], [])
            scores = [s + one.score(r) for r, s in zip(learn, scores)]
    forest = Forest(trees, [])
    judge = [r for r in rows if r["half"] == 1 and r["n"]] or learn
    for kind in range(len(KINDS)):
        found, n, positive = None, 0, 0
        scored = sorted(((forest.score(r), r["n"], r["positive"]) for r in judge if r["kind"] == kind), reverse=True)
        for k, (s, a, b) in enumerate(scored):
            n, positive = n + a, positive + b
            if positive >= precision * n and (k + 1 == len(scored) or scored[k + 1][0] < s):
                found = s
        forest.thresholds.append(found if trees else None)
    return forest


def train(spans: DataFrame) -> Forest:
    """Fit on proposals (doc, proposed) of all documents; only counts per distinct description reach the driver."""
    one = spans.select(F.pmod(F.xxhash64("doc"), F.lit(2)).cast("int").alias("half"), F.explode("proposed").alias("p"))
    counts = one.groupBy("half", *[F.col("p")[f].alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), F.sum(F.col("p")["is_base"]).alias("positive"))
    rows = [r.asDict() for r in counts.collect()]  # at most 2 * MOST_DESCRIPTIONS rows
    return fit(sorted(rows, key=lambda r: [r[f] for f in ("half", *FEATURES)]))


_BARE = "array<struct<start:int,kind:int,end:int>>"


def select_spans(forest: Forest) -> Column:
    """All spans (start, kind, end), in order: base ones, and added ones.

    Added are proposals that no base span covers and whose score reaches the threshold of their kind. In the
    order of their starts, one that overlaps the last replaces it if its score is higher, and else goes.
    """
    scored = F.transform("proposed", lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"), p["covered"].alias("covered"), forest.column(lambda f: p[f]).alias("score")))
    bar = lambda kind: F.element_at(F.array(*[F.lit(t).cast("double") for t in forest.thresholds]), kind + 1)
    good = F.filter(scored, lambda p: ~p["covered"] & F.coalesce(p["score"] >= bar(p["kind"]), F.lit(False)))
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))

    def step(state: Column, s: Column) -> Column:
        last = F.get(state, F.size(state) - 1)
        apart = (F.size(state) == 0) | (s["start"] >= last["end"])
        replaced = F.when(s["score"] > last["score"], F.array_append(F.slice(state, F.lit(1), F.size(state) - 1), s)).otherwise(state)
        return F.when(apart, F.array_append(state, s)).otherwise(replaced)

    # Blocks are swept one by one; of what overlaps at their borders the earlier stays.
    none = F.array().cast("array<struct<start:int,kind:int,end:int,covered:boolean,score:double>>")
    sweep = lambda found: F.flatten(F.transform(_blocks(found), lambda i: F.aggregate(F.slice(found, i * BLOCK + 1, F.lit(BLOCK)), none, step)))
    apart = lambda at, s, _: F.when(s["start"] >= at, F.array(bare(s))).otherwise(F.array().cast(_BARE))
    added = _let(_let(good, sweep), lambda swept: _passed(swept, _BARE, lambda s: s["end"], F.greatest, apart))
    return F.array_sort(F.concat(F.transform("base", bare), added))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda kind: F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans and spans (as text) for each row of docs.

    A null or empty text has no spans. Null and repeated doc_ids come back as they are; very long texts are
    read whole; an empty table gives an empty result; only doc_id and text are read. The spans are written once
    as a table, so the corpus is read and matched once.
    """
    one = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    kept = cut(one.select(F.col("row.doc_id").alias("doc_id"), F.col("row.doc_id").alias("doc"), "base", "proposed"), "pii-spans")
    forest = train(kept)
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return kept.select("doc_id", *counts, written(F.col("base")).alias("base_spans"), written(select_spans(forest)).alias("spans"))


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data in text replaced by its kind in brackets, as [EMAIL].

    All rows and columns stay, whatever their names. Overlapping spans become one mark, of the first. Null
    texts stay null; texts without spans stay as they are; an empty table stays empty.
    """
    trained = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    forest = train(cut(trained.select(F.col("row.doc_id").alias("doc"), "proposed"), "pii-proposals"))
    marked = with_spans(docs).withColumn("spans", select_spans(forest))
    text = F.col("text")
    name = lambda kind: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), kind + 1)

    def own(before: Column, part: Column) -> Column:
        """The text of a block: substrings of it cost less than of the whole."""
        last = F.greatest(before, F.array_max(F.transform(part, lambda s: s["end"])))
        return F.struct(before.alias("at"), F.substring(text, before + 1, last - before).alias("text"))

    def step(at: Column, span: Column, here: Column) -> Column:
        new = F.array(F.substring(here["text"], at - here["at"] + 1, span["start"] - at), name(span["kind"]))
        return F.when(span["start"] >= at, new).otherwise(F.array().cast("array<string>"))

    pieces = _let(F.col("spans"), lambda spans: _passed(spans, "array<string>", lambda s: s["end"], F.greatest, step, own))
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))
    clean = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(clean)
    return marked.select(*[clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
