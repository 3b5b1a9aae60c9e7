"""Approximate nearest neighbours: an inverted file with product-quantised residuals, and exact reranking.

Equal vectors are one node, which keeps its k + 1 smallest ids: a query takes no more, its own left out. Coarse
centroids and the codebooks of the residuals are fitted on a bounded sample; every node is indexed: its cell, a
code of one byte per subspace, the length of what the code leaves out, and the vector itself for the reranking.
A query looks into the cells nearest to it and ranks their nodes by asymmetric distance tables (inner products of
the query with all codewords, added up by code). How far that is from the true product, in parts of the
query's length times the length left out, is measured on the sample; every node that may reach the last place
within that gets its exact product. The number of cells is the smallest that reaches `recall` on sample queries
with codes and reranking, and as many more as a query needs for k ids.

The index is dealt out in shards: small cells share one, a large cell is spread over several. A query goes to
the shards of its cells with the cells it looks into there, many queries to a shard in blocks. A task holds one
shard and one block, so neither hot cells nor many queries gather in one task. A query's shards take turns, the
nearest alone, then four times as many each turn: the k-th best found so far is a floor, below which no shard sends
anything back. So a query costs about k rows a turn, with turns by the logarithm of its shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyceum.llm.shared import cut, usable_vector

#: The fit sees about so many vectors at most, those whose hash of the id is below the share that this makes.
SAMPLE = 40_000
#: Cells: so many times the square root of the nodes, and at most one for each so many vectors of the sample.
CELLS_BY_ROOT, LEAST_SAMPLE = 4, 32
SUBSPACES, CODEWORDS = 16, 256
#: Rows of a shard: at least LEAST_SHARD, and more where that would make over MOST_SHARDS shards; queries of a block.
LEAST_SHARD, MOST_SHARDS, BLOCK = 2_048, 10_000, 4_096
#: A turn ends with so many times the shards that a query has seen by the turn before.
TURN = 4
#: Share of products whose error by codes is larger than the one reckoned with.
MISSED = 1e-5
#: Queries of the sample that the fit tries, and so many at once: a table of those by the whole sample is in memory.
_TRIALS, _TRIALS_AT_ONCE = 400, 16


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    x = x.astype(np.float32)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centroids)
        order = np.argsort(near, kind="stable")
        present, starts, n = np.unique(near[order], return_index=True, return_counts=True)
        centroids[present] = np.add.reduceat(x[order], starts, axis=0) / n[:, None]
    return centroids.astype(np.float64)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 2048] @ centroids.T - half, axis=1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, int)


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]
    probes: int
    error: float  # error of a product by codes that all but MISSED stay below, in parts of both lengths

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def parts(self) -> list[slice]:
        bounds = [self.dim * i // len(self.books) for i in range(len(self.books) + 1)]
        return [slice(a, b) for a, b in zip(bounds, bounds[1:])]

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[cells]
        return np.stack([_nearest(rest[:, p], book) for p, book in zip(self.parts(), self.books)], axis=1).astype(np.uint8)

    def left_out(self, x: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lengths of what the codes leave out."""
        rest = x - self.centroids[cells]
        return np.sqrt(sum(((rest[:, p] - book[codes[:, m]]) ** 2).sum(1) for m, (p, book) in enumerate(zip(self.parts(), self.books))))

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        return [queries[:, p] @ book.T for p, book in zip(self.parts(), self.books)]

    def cells_of(self, queries: np.ndarray, held: np.ndarray, least: int) -> list[np.ndarray]:
        """The cells to look into, by the inner product with their centroids: `probes`, or until they hold `least` ids."""
        order = np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")
        enough = (np.cumsum(held[order], axis=1) < least).sum(1) + 1
        return [cells[:n].astype(np.int32) for cells, n in zip(order, np.maximum(enough, self.probes))]


def fit(sample: np.ndarray, rows: int, k: int = 20, recall: float = 0.95, seed: int = 7) -> Index:
    """Centroids and codebooks from a sample of a table of `rows`; on the sample also the error of the codes and the cells to look into."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(int(CELLS_BY_ROOT * np.sqrt(rows)), len(sample) // LEAST_SAMPLE))
    index = Index(_k_means(sample, cells, rng), [], cells, 1.0)
    near = _nearest(sample, index.centroids)
    some = rng.choice(len(sample), min(len(sample), 16_384), replace=False)
    rest = sample[some] - index.centroids[near[some]]
    index.books = [np.zeros((1, 1))] * min(SUBSPACES, sample.shape[1])
    index.books = [_k_means(np.ascontiguousarray(rest[:, p]), min(CODEWORDS, len(rest)), rng) for p in index.parts()]
    trial = rng.choice(len(sample), min(_TRIALS, len(sample)), replace=False)
    codes = index.codes(sample, near)
    off = index.left_out(sample, near, codes)
    blocks = [trial[i : i + _TRIALS_AT_ONCE] for i in range(0, len(trial), _TRIALS_AT_ONCE)]
    largest = max(np.abs(sample[block] @ sample.T).max() for block in blocks)
    # Of the errors only those from the quantile on are kept, so that no table of all trials by the whole sample stands in memory.
    place = (len(trial) * len(sample) - 1) * (1 - MISSED)
    tail = len(trial) * len(sample) - int(place)
    errors, needed = np.zeros(0), []  # needed: the rank of the cell that holds each neighbour
    for block in blocks:
        queries = sample[block]
        exact = queries @ sample.T
        by_centroid = queries @ index.centroids.T
        around = by_centroid[:, near]
        for m, t in enumerate(index.tables(queries)):
            around += t[:, codes[:, m]]
        scale = np.sqrt((queries**2).sum(1))[:, None] * np.maximum(off, 1e-12)[None, :]
        errors = np.concatenate([errors, (np.abs(exact - around) / np.maximum(scale, 1e-9 * largest)).ravel()])
        errors = np.partition(errors, len(errors) - tail)[len(errors) - tail :] if len(errors) > tail else errors
        exact[np.arange(len(block)), block] = -np.inf
        best = np.argsort(-exact, axis=1)[:, : min(k, len(sample) - 1)]
        order = np.argsort(np.argsort(-by_centroid, axis=1), axis=1)
        needed.append(np.take_along_axis(order, near[best], axis=1))
    errors.sort()
    index.error = float(min(1.0, errors[0] + (place - int(place)) * (errors[min(1, len(errors) - 1)] - errors[0])))
    needed = np.concatenate(needed)
    reached = np.cumsum(np.bincount(needed.ravel(), minlength=cells)) / max(1, needed.size)
    index.probes = int(np.searchsorted(reached, recall)) + 1 if needed.size else cells
    index.probes = min(index.probes, cells)
    return index


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


_OUT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors found for each query, by exact inner product in
    double precision, ties to the smaller vec_id; a query's own id is no candidate.

    vectors and queries: (vec_id, embedding). Vectors that are null, zero, or hold null or non-finite
    components take no part; nor do null ids. A query's candidates are the vectors of its length: each
    length has an index of its own (lengths are few, one for each model that made vectors). Of rows that
    repeat an id, the one with the smallest vector counts. Without vectors the result is empty.
    """
    spark = vectors.sparkSession
    one = lambda df: df.filter(F.col("vec_id").isNotNull() & usable_vector(F.col("embedding"))).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("v"))
    base, asked = cut(one(vectors), "ann-vectors"), cut(one(queries), "ann-asked")
    found = [_search(base.filter(F.size("v") == dim), asked.filter(F.size("v") == dim), dim, k, recall) for dim in sorted(r["dim"] for r in base.select(F.size("v").alias("dim")).distinct().collect())]
    hits = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for one_length in found:
        hits = hits.union(one_length)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(base: DataFrame, asked: DataFrame, dim: int, k: int, recall: float) -> DataFrame:
    """(query_id, vec_id, score): the k best for each query; base and asked (vec_id, v) of one length."""
    spark = base.sparkSession
    # Equal vectors are one node; the window drops what is beyond the k + 1 smallest ids before the shuffle.
    first = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    ids = base.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    nodes = cut(ids.groupBy(F.xxhash64("v").alias("h"), "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "v"), "ann-nodes")
    rows = nodes.count()
    # The sample: each partition sends its share of SAMPLE rows, however many partitions there are.
    chosen = F.pmod(F.xxhash64(F.col("ids")[0], F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / rows))
    sample = nodes.filter(chosen).select(F.col("ids")[0].alias("id"), "v").toArrow()
    if not sample.num_rows:
        sample = nodes.limit(1).select(F.col("ids")[0].alias("id"), "v").toArrow()
    sample = sample.take(np.argsort(np.asarray(sample["id"])))
    index = fit(_matrix(sample["v"].combine_chunks(), dim), rows, k, recall)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            cells = _nearest(x, index.centroids)
            codes = index.codes(x, cells)
            coded = [pa.array(cells, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(index.left_out(x, cells, codes), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *coded], ["ids", "v", "cell", "code", "off"])

    entered = cut(nodes.mapInArrow(enter, "ids array<long>, v array<double>, cell int, code binary, off double"), "ann-index")
    # Shards, from the sizes of the cells: a row for each cell.
    counted = {r["cell"]: (r["n"], r["ids"]) for r in entered.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}
    shard_rows = max(LEAST_SHARD, rows // MOST_SHARDS)
    held = np.zeros(len(index.centroids), dtype=np.int64)
    layout, filled, at = {}, 0, 0
    for cell in sorted(counted):
        n, held[cell] = counted[cell]
        if filled and filled + n > shard_rows:
            at, filled = at + 1, 0
        spread = -(-n // shard_rows)
        layout[cell] = (at, spread)
        at, filled = (at, filled + n) if spread == 1 else (at + spread, 0)
    places = F.broadcast(spark.createDataFrame([(c, *s) for c, s in layout.items()], "cell int, low int, spread int"))  # a row for each cell
    entered = entered.join(places, "cell").withColumn("shard", F.col("low") + F.pmod(F.xxhash64(F.col("ids")[0]), F.col("spread")).cast("int")).drop("low", "spread")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, shards, looked, turns = [], [], [], []
            for i, cells in enumerate(index.cells_of(_matrix(batch.column(1), dim), held, k + 1)):
                by_shard: dict[int, list[int]] = {}
                for cell in cells.tolist():
                    low, spread = layout.get(cell, (0, 0))
                    for shard in range(low, low + spread):
                        by_shard.setdefault(shard, []).append(cell)
                row += [i] * len(by_shard)
                shards += by_shard
                looked += by_shard.values()
                turns += [_turn(place) for place in range(len(by_shard))]
            some = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(shards, pa.int32()), pa.array(looked, pa.list_(pa.int32())), pa.array(turns, pa.int32())], ["query_id", "q", "shard", "cells", "turn"])

    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).mapInArrow(ask, "query_id long, q array<double>, shard int, cells array<int>, turn int")
    asked = cut(asked, "ann-queries")

    def look(entries: pa.Table, questions: pa.Table) -> pa.Table:
        found = _look(index, entries, questions, k) if entries.num_rows and questions.num_rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    best = spark.createDataFrame([], "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    for turn in range(1 + (asked.agg(F.max("turn")).first()[0] or 0)):
        floors = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k).select("query_id", "floor")
        now = asked.filter(F.col("turn") == turn).drop("turn").join(floors, "query_id", "left")
        found = best.union(_asked_of_shards(entered, now, look))
        best = cut(found.withColumn("place", place).filter(F.col("place") <= k).drop("place"), "ann-best")
    return best


def _turn(place: int) -> int:
    """The turn in which a query looks into its shard at a place of its order, from 0."""
    turn, seen = 0, 1
    while place >= seen:
        turn, seen = turn + 1, seen * TURN
    return turn


def _asked_of_shards(entered: DataFrame, asked: DataFrame, look: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """(query_id, vec_id, score): what shards (entered) hold for the queries (asked) that look into them, a block of queries at a time."""
    blocks = cut(asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), "ann-blocks")
    entered = entered.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    return entered.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(look, "query_id long, vec_id long, score double")


def _look(index: Index, entries: pa.Table, questions: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one shard for each query of one block, those below the query's floor (null: none) left out."""
    entries, questions = entries.combine_chunks(), questions.combine_chunks()
    take = lambda t, name: t.column(name).combine_chunks()
    lists, cells = take(entries, "ids"), np.asarray(take(entries, "cell"))
    ids, bounds = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
    vectors, off = _matrix(take(entries, "v"), index.dim), np.asarray(take(entries, "off"))
    codes = np.frombuffer(b"".join(take(entries, "code").to_pylist()), dtype=np.uint8).reshape(len(cells), -1)
    query_ids, queries = np.asarray(take(questions, "query_id")), _matrix(take(questions, "q"), index.dim)
    looked = [set(c) for c in take(questions, "cells").to_pylist()]
    lengths = np.sqrt((queries**2).sum(1))
    floors = np.array([-np.inf if x is None else x for x in take(questions, "floor").to_pylist()])
    slack = 1e-9 * lengths * np.sqrt((vectors**2).sum(1)).max()  # more than the sums can be rounded by
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    members = {int(c): np.flatnonzero(cells == c) for c in np.unique(cells)}
    step = max(1, min(256, 2_000_000 // len(cells)))  # bounded memory, whatever the shard
    for start in range(0, len(query_ids), step):
        part = slice(start, start + step)
        tables = index.tables(queries[part])
        products = np.full((len(queries[part]), len(cells)), -np.inf)
        for cell, rows in members.items():
            asking = np.array([i for i, c in enumerate(looked[part]) if cell in c], dtype=int)
            if len(asking):
                products[np.ix_(asking, rows)] = (queries[part][asking] @ index.centroids[cell])[:, None] + sum(t[asking][:, codes[rows, m]] for m, t in enumerate(tables))
        for i, around in enumerate(products, start):
            floor = floors[i] - slack[i]
            error = index.error * lengths[i] * off + slack[i]
            rows = _within_reach(around, error, k)
            rows = rows[around[rows] + error[rows] >= floor]
            scores = vectors[rows] @ queries[i]
            best = _within_reach(scores, slack[i], k)  # besides the best, what rounding may tie with them
            best = best[scores[best] >= floor]
            rows, scores = rows[best], scores[best]
            n = bounds[rows + 1] - bounds[rows]
            at = np.repeat(bounds[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found, scores = ids[at], np.repeat(scores, n)
            found, scores = found[(other := found != query_ids[i])], scores[other]
            order = np.lexsort((found, -scores))[:k]
            out.append((np.full(len(order), query_ids[i]), found[order], scores[order]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _within_reach(around: np.ndarray, error: np.ndarray | float, k: int) -> np.ndarray:
    """Places whose true value may be among the k + 1 largest (one may be the query itself); -inf is never one."""
    low = around - error
    last = np.partition(low, len(low) - k - 1)[len(low) - k - 1] if len(low) > k + 1 else -np.inf
    return np.flatnonzero((around + error >= last) & (around > -np.inf))
