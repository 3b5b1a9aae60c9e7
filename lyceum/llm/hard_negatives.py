"""Hard negatives by product quantisation with stored residual norms.

A vector is kept as one codeword for each subspace and the length of what the codeword leaves out there. With the
inner products of an anchor's parts with all codewords in tables, a row's score is known up to

    |score - sum of table entries| <= sum over subspaces of |anchor's part| * |residual|,

so no row that may belong to a result is ever left out: rows whose bounds reach the window, and the best that
surely lie inside it, go on to exact integer products, which alone decide. Codebooks come from a bounded sample
and change the work only.

Rows are dealt out in shards by a hash, anchors in blocks; a task holds one shard and one block and sends back the
best of each window. A first round looks into one shard of sixteen: the last place found there is a floor for the
second, which looks into all, so that what shards send doesn't grow with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.llm.ann import _k_means, _nearest
from lyceum.llm.shared import cut

#: Rows that the codebooks are fitted on, about, and bytes of them at most, whatever their length.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
SUBSPACES, CODEWORDS = 16, 256
#: Rows of a shard; anchors of a block; one shard in so many gives the floors.
LEAST_SHARD, MOST_SHARD, BLOCK, FIRST_LOOK = 4_096, 65_536, 4_096, 16
_NONE_LOW, _NONE_HIGH = -(1 << 63), (1 << 63) - 1
_WINDOWS = "array<struct<tag:long,low:long,high:long,floor:long>>"


class Codes:
    """Codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        parts = min(SUBSPACES, sample.shape[1])
        bounds = [sample.shape[1] * i // parts for i in range(parts + 1)]
        self.parts = [slice(a, b) for a, b in zip(bounds, bounds[1:])]
        self.books = [_k_means(np.ascontiguousarray(sample[:, p]), min(CODEWORDS, len(sample)), rng) for p in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and residual norms rounded up."""
        codes = np.stack([_nearest(x[:, p], book) for p, book in zip(self.parts, self.books)], axis=1).astype(np.uint8)
        norms = np.stack([np.sqrt(((x[:, p] - book[codes[:, m]]) ** 2).sum(1)) for m, (p, book) in enumerate(zip(self.parts, self.books))], axis=1)
        return codes, np.nextafter((norms * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))

    def bounds(self, asked: np.ndarray, codes: np.ndarray, norms: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each product of asked with the coded rows can't fall below or pass; slack: what rounding may add."""
        near = sum((asked[:, p] @ book.T)[:, codes[:, m]] for m, (p, book) in enumerate(zip(self.parts, self.books)))
        lengths = np.stack([np.sqrt((asked[:, p] ** 2).sum(1)) for p in self.parts], axis=1)
        off = lengths @ norms.T.astype(np.float64) + slack[:, None]
        return near - off, near + off


def products(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of one integer vector with some rows: in double precision where no sum can round."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    if float(np.abs(asked).max()) * float(np.abs(rows).max()) * rows.shape[1] < 2**53:
        return (rows.astype(np.float64) @ asked.astype(np.float64)).astype(np.int64)
    return rows @ asked  # 64-bit integers; usable() keeps every sum below 2^63


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _look(codes: Codes, entries: pa.Table, asks: pa.Table, k: int, same: bool) -> pa.Table:
    """The k best of a shard in each window of each anchor of a block."""
    take = lambda t, name: t.column(name).combine_chunks()
    dim = codes.parts[-1].stop
    whole = lambda t, name: np.frombuffer(b"".join(take(t, name).to_pylist()), dtype=np.int64).reshape(-1, dim)
    ids, labels, v = np.asarray(take(entries, "vec_id")), np.asarray(take(entries, "label")), whole(entries, "v")
    code = np.frombuffer(b"".join(take(entries, "code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
    norm = np.frombuffer(b"".join(take(entries, "norm").to_pylist()), dtype=np.float32).reshape(len(ids), -1)
    anchors, own, q = np.asarray(take(asks, "anchor_id")), np.asarray(take(asks, "label")), whole(asks, "q")
    windows = take(asks, "windows").to_pylist()
    longest = np.sqrt((v.astype(np.float64) ** 2).sum(1)).max()
    out: list[tuple[int, int, int, int]] = []
    step = max(1, min(256, 2_000_000 // len(ids)))
    for start in range(0, len(anchors), step):
        part = slice(start, start + step)
        asked = q[part].astype(np.float64)
        low, high = codes.bounds(asked, code, norm, 1e-9 * np.sqrt((asked**2).sum(1)) * longest + 1e-6)
        for i in range(len(asked)):
            at = start + i
            fits = (labels == own[at]) == same
            fits &= ids != anchors[at]
            for w in windows[at]:
                least = max(w["low"], w["floor"])
                near = np.flatnonzero(fits & (high[i] >= least) & (low[i] <= w["high"]))
                sure = low[i][near][high[i][near] <= w["high"]]  # inside for certain, if above the low end too
                sure = sure[sure >= w["low"]]
                if len(sure) > k:
                    near = near[high[i][near] >= np.partition(sure, len(sure) - k)[len(sure) - k]]
                scores = products(q[at], v[near])
                inside = (scores >= least) & (scores <= w["high"])
                near, scores = near[inside], scores[inside]
                best = best_of(ids[near], scores, k)
                out += zip([int(anchors[at])] * len(best), [w["tag"]] * len(best), ids[near[best]].tolist(), scores[best].tolist())
    columns = list(zip(*out)) if out else [[], [], [], []]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "tag", "vec_id", "score"])


def _best_in_windows(entered: DataFrame, shards: int, asks: DataFrame, blocks: int, codes: Codes, k: int, same: bool) -> DataFrame:
    """(anchor_id, tag, vec_id, score, rank): the k best rows inside each window of asks, of the anchor's label or of others.

    entered: (vec_id, label, v, code, norm, shard, block), each row once for each block; asks: (anchor_id, label, q,
    block, windows).
    """
    look = lambda entries, asked: _look(codes, entries, asked, k, same) if entries.num_rows and asked.num_rows else _look_nothing()

    def round_(rows: DataFrame, asked: DataFrame, every: int) -> DataFrame:
        dealt = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1), F.lit(every))))
        hits = rows.filter(F.col("shard") % every == 0).groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(look, "anchor_id long, tag long, vec_id long, score long")
        place = F.row_number().over(Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id"))
        return hits.withColumn("rank", place).filter(F.col("rank") <= k)

    floors = round_(entered, asks, FIRST_LOOK).filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("floors"))
    raised = F.transform("windows", lambda w: w.withField("floor", F.coalesce(F.element_at("floors", w["tag"]), w["floor"])))
    return round_(entered, asks.join(floors, "anchor_id", "left").withColumn("windows", raised).drop("floors"), 1)


def _look_nothing() -> pa.Table:
    return pa.table([pa.array([], pa.int64())] * 4, names=["anchor_id", "tag", "vec_id", "score"])


def as_integers(v: Column, factor: int = 256) -> Column:
    """Each component times factor, rounded down."""
    return F.transform(v.cast("array<double>"), lambda x: F.floor(x * F.lit(float(factor))))


def usable(v: Column) -> Column:
    """True for vectors that take part: with components, none of them null, not finite, or so large that a product may pass 63 bits."""
    most = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(v), F.lit(1))) / 256
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    vectors: (vec_id, embedding, label); anchors: a condition on vec_id. Components become floor(256 x), scores are
    exact integer inner products. An anchor's positives are its first `positives` other rows of the same label; for
    each, the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score are returned. Higher scores come first, ties by the smaller vec_id. Fewer rows, fewer results.

    Rows with a null vec_id, label or vector, without components, or with a component that is null, not finite or
    beyond what 63 bits hold (about 2^19 at 64 dimensions) take no part; zero vectors do, with score 0. Vectors of
    different length don't meet: each length (there are few) is worked on alone. Of rows that repeat a vec_id, the
    one with the smallest label, then vector, counts. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), as_integers(F.col("embedding")).alias("v"))
    rows = cut(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*"), "negatives-rows")
    found = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():
        found = found.union(_mine(rows.filter(F.size("v") == r["dim"]), r["dim"], r["n"], anchors, positives, negatives, low, high))
    return found


def _mine(rows: DataFrame, dim: int, n: int, anchors: Column, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    most = max(CODEWORDS, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    chosen = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / n))
    sample = rows.filter(chosen).select("vec_id", "v").toArrow() if n > most else rows.select("vec_id", "v").toArrow()
    sample = sample if sample.num_rows else rows.limit(1).select("vec_id", "v").toArrow()
    sample = sample.take(np.argsort(np.asarray(sample["vec_id"])))
    codes = Codes(np.asarray(sample["v"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim))

    def enter(batches):
        for batch in batches:
            x = np.asarray(batch.column(2).flatten(), dtype=np.int64).reshape(-1, dim)
            code, norm = codes.encode(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r.tobytes() for r in a], pa.binary()) for a in (x, code, norm)]], ["vec_id", "label", "v", "code", "norm"])

    shards = max(1, math.ceil(n / max(LEAST_SHARD, min(MOST_SHARD, n // 64))))
    asked = rows.filter(anchors).count()
    blocks = max(1, math.ceil(asked / BLOCK))
    entered = rows.mapInArrow(enter, "vec_id long, label long, v binary, code binary, norm binary")
    entered = cut(entered.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), "negatives-index")
    asks = entered.filter(anchors).select(F.col("vec_id").alias("anchor_id"), "label", F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int").alias("block"))
    asks = cut(asks, "negatives-anchors")
    entered = entered.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    everything = F.expr(f"array(named_struct('tag', 0L, 'low', {_NONE_LOW + 1}L, 'high', {_NONE_HIGH}L, 'floor', {_NONE_LOW + 1}L))").cast(_WINDOWS)
    near = cut(_best_in_windows(entered, shards, asks.withColumn("windows", everything), blocks, codes, positives, True), "negatives-positives")
    # low s <= 100 x <= high s: whole numbers x from ceil(low s / 100) to floor(high s / 100); none if s is below 0.
    s = F.col("score").cast("decimal(20,0)")
    ends = near.filter("score >= 0").withColumns({"low": F.ceil(s * low / 100).cast("long"), "high": F.floor(s * high / 100).cast("long")}).filter("low <= high")
    window = F.struct(F.col("vec_id").alias("tag"), "low", "high", F.lit(_NONE_LOW + 1).alias("floor"))
    ends = ends.groupBy("anchor_id").agg(F.collect_list(window).alias("windows"))
    hits = _best_in_windows(entered, shards, asks.join(ends.withColumn("windows", F.col("windows").cast(_WINDOWS)), "anchor_id"), blocks, codes, negatives, False)
    pairs = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hits = hits.select("anchor_id", F.col("tag").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hits.join(pairs, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
