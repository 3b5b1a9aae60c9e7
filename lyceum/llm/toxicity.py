"""Toxicity severity by cumulative-link (proportional odds) regression on sparse text features.

P(grade <= k) = logistic(threshold[k] - w.x): one weight vector serves all ordered thresholds. Features are
the words of a text and their beginnings of four to six letters (so inflected and compounded forms of a stem
count together); the value is log(1 + distinct words that have the feature). The expected severity is the
sum over k of P(grade > k); a document is rejected if P(grade > 0) reaches `reject_at`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import cut

#: The fit sees about so many labelled rows of grade 0 at most, and so many of higher grades. It is the only part
#: that samples; rows are chosen by a hash of their id. Everything else covers all documents.
MOST_CLEAN, MOST_TOXIC = 9_000, 5_000
#: Features whose document frequencies differ most between toxic and clean rows.
MOST_FEATURES = 4_000
LEAST_Z = 4.5
BEGINNINGS = (4, 5, 6)
#: Words whose features a task remembers.
MEMORY = 50_000

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Severity:
    """weights by feature, and thresholds in rising order; without thresholds every text has severity 0."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        counts: Counter[str] = Counter()
        known = self._known
        for word in words_of(text):
            found = known.get(word)
            if found is None:
                if len(known) > MEMORY:
                    known.clear()
                found = known[word] = tuple(f for f in features_of(word) if f in self.weights)
            if found:
                counts.update(found)
        return sum(self.weights[f] * float(np.log1p(n)) for f, n in sorted(counts.items()))

    def above(self, score: float) -> list[float]:
        """P(grade > k) for each k."""
        return [float(_logistic(np.array(score - t))) for t in self.thresholds]


def fit(texts: list[str | None], grades: list[int], row_weights: list[float], steps: int = 400, ridge: float = 1e-4) -> Severity:
    """The model for texts with grades 0, 1, 2, ...; grades without rows are passed over."""
    present = sorted(set(grades))
    if len(present) < 2:
        return Severity()
    y = np.searchsorted(present, grades)
    weight = np.asarray(row_weights, dtype=float)
    # Words and features as numbers, so that the sample takes a few MB: the features of word w are flat[bounds[w]:bounds[w + 1]].
    words: dict[str, int] = {}
    docs = [np.array(sorted(words.setdefault(w, len(words)) for w in words_of(t)), dtype=np.int64) for t in texts]
    names: dict[str, int] = {}
    lists = [[names.setdefault(f, len(names)) for f in features_of(w)] for w in words]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    flat = np.fromiter((f for x in lists for f in x), dtype=np.int64, count=int(bounds[-1]))
    del words, lists

    def found_in(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of a document, and of how many of its words."""
        n = bounds[doc + 1] - bounds[doc]
        return np.unique(flat[np.repeat(bounds[doc] - np.cumsum(n) + n, n) + np.arange(n.sum())], return_counts=True)

    # Selection by how far the two document frequencies lie apart, in standard errors.
    frequency = np.zeros((2, len(names)))
    for doc, grade in zip(docs, y):
        frequency[int(grade > 0), found_in(doc)[0]] += 1
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y > 0).sum()))
    p = frequency.sum(axis=0) / (n0 + n1)
    z = np.abs(frequency[0] / n0 - frequency[1] / n1) / np.sqrt(np.maximum(1e-12, p * (1 - p) * (1 / n0 + 1 / n1)))
    of = np.array(list(names), dtype=object)
    good = np.flatnonzero((frequency.sum(axis=0) >= 3) & (z >= LEAST_Z)).tolist()
    good = sorted(good, key=lambda f: (-z[f], of[f]))[:MOST_FEATURES]
    chosen = [of[f] for f in good]
    if not chosen:
        return Severity()
    column = np.full(len(names), -1)
    column[good] = np.arange(len(good))
    rows, columns, values = [], [], []
    for i, doc in enumerate(docs):
        features, n = found_in(doc)
        here = column[features] >= 0
        rows.append(np.full(int(here.sum()), i))
        columns.append(column[features[here]])
        values.append(np.log1p(n[here]))
    rows, columns, values = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
    del docs, flat, bounds
    k = len(present) - 1
    share = [weight[y > j].sum() / weight.sum() for j in range(k)]
    start = [float(-np.log(s / (1 - s))) for s in share]
    # Thresholds stay ordered: the first is free, the others are the one before plus exp(gap).
    param = np.concatenate([np.zeros(len(chosen)), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(param), np.zeros_like(param)
    total = weight.sum()

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([p[len(chosen) : len(chosen) + 1], np.exp(p[len(chosen) + 1 :])]))

    for step in range(1, steps + 1):
        w = param[: len(chosen)]
        score = np.bincount(rows, values * w[columns], minlength=len(y))
        cut = np.concatenate([[-np.inf], thresholds(param), [np.inf]])
        upper, lower = _logistic(cut[y + 1] - score), _logistic(cut[y] - score)
        upper, lower = np.where(y == k, 1.0, upper), np.where(y == 0, 0.0, lower)
        chance = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        by_score = weight * (up - low) / total
        by_cut = np.array([-(weight * up)[y == j].sum() + (weight * low)[y == j + 1].sum() for j in range(k)]) / total
        tail = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate([np.bincount(columns, values * by_score[rows], minlength=len(chosen)) + ridge * w, tail[:1], tail[1:] * np.exp(param[len(chosen) + 1 :])])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        param = param - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    # A grade that has no rows between two others has no threshold of its own.
    return Severity({f: float(v) for f, v in zip(chosen, param) if abs(v) > 1e-6}, thresholds(param).tolist())


def graded(toxic: Column, quality: Column) -> Column:
    """Three grades from the labels: 0 for what isn't toxic, 1 for toxic text, 2 for toxic text of bad quality as well."""
    return F.when(toxic > 0, F.when(quality == 0, 2).otherwise(1)).otherwise(toxic.cast("int"))


def train(docs: DataFrame, labels: DataFrame, grade: Column) -> Severity:
    """Fit on a bounded sample of labelled documents.

    labels: doc_id and what `grade` needs. The chosen labels (about MOST_CLEAN + MOST_TOXIC ids at most, by a
    hash of the id) are broadcast to the documents, and one task fits the model on the rows found. Labels with a null id or
    grade are passed over; a doc_id with several labels has the highest; without labels, or without both
    toxic and clean ones, the model gives every text severity 0.
    """
    all_ = labels.select(F.col("doc_id").alias("__id"), grade.cast("int").alias("__grade")).dropna().groupBy("__id").agg(F.max("__grade").alias("__grade"))
    n = {bool(r["toxic"]): r["n"] for r in all_.groupBy((F.col("__grade") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    parts = []
    for toxic, most in ((False, MOST_CLEAN), (True, MOST_TOXIC)):
        if n.get(toxic):
            share = min(1.0, most / n[toxic])
            part = all_.filter((F.col("__grade") > 0) == F.lit(toxic)).filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
            parts.append(part.withColumn("__weight", F.lit(1 / share)))
    if len(parts) < 2:
        return Severity()
    sample = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select(F.col("doc_id").alias("__doc"), "text").join(sample, F.col("__doc") == F.col("__id")).select("__doc", "text", "__grade", "__weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: dict[int, tuple[str, int, float]] = {}  # of rows that repeat a doc_id the smallest text
        for batch in batches:
            for doc, text, given, weight in zip(*[c.to_pylist() for c in batch.columns]):
                row = (text or "", given, weight)
                one[doc] = min(one.get(doc, row), row)
        chosen = [one[doc] for doc in sorted(one)]
        model = fit([r[0] for r in chosen], [r[1] for r in chosen], [r[2] for r in chosen])
        names, values = [*model.weights, *[None] * len(model.thresholds)], [*model.weights.values(), *model.thresholds]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["feature", "value"])

    sample_rows = cut(rows, "toxicity-sample")  # found by all tasks; only the bounded sample goes to one
    found = sample_rows.coalesce(1).mapInArrow(run, "feature string, value double").collect()  # at most MOST_FEATURES rows and the thresholds
    return Severity({r["feature"]: r["value"] for r in found if r["feature"] is not None}, sorted(r["value"] for r in found if r["feature"] is None))


def severities(docs: DataFrame, model: Severity, reject_at: float = 0.35) -> DataFrame:
    """(doc_id, severity, p_toxic, rejected) for each row of docs; null and empty texts have no features.

    severity is the expected grade, p_toxic the chance of a grade above 0. Rows that repeat a doc_id, or have
    none, are judged one by one; very long texts are read whole; an empty table gives an empty result; only
    doc_id and text are read.
    """
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Severity(weights, thresholds)
        for batch in batches:
            above = [own.above(own.score(t.as_py())) for t in batch.column(1)] if thresholds else [[0.0]] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sum(p) for p in above], pa.float64()), pa.array([p[0] for p in above], pa.float64()), pa.array([p[0] >= reject_at for p in above], pa.bool_())],
                ["doc_id", "severity", "p_toxic", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, rejected boolean")


def without_toxic(docs: DataFrame, model: Severity, reject_at: float = 0.35) -> DataFrame:
    """docs without the rows whose text the model rejects; all columns stay, whatever their names, in one pass."""
    weights, thresholds = model.weights, model.thresholds
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Severity(weights, thresholds)
        for batch in batches:
            stay = [own.above(own.score(t.as_py()))[0] < reject_at for t in batch.column(at)]
            mask = pa.array(stay, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns], batch.schema.names)

    return docs.mapInArrow(run, docs.schema) if thresholds else docs
