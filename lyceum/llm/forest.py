"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors of a label again and again near the median of a random projection. Vectors near a
split go to both sides (spill), so a pair of near vectors rarely parts; that it parts in all of several trees is
rarer by orders of magnitude. Within a leaf, vectors are compared exactly, in blocks; a pair counts in the
first leaf that it shares, so links are counted once without a row for any pair, and leaves hand on only
spanning links, whose components are the groups.

Trees grow from the table: a pass splits every leaf of more than LEAF vectors up to LEVELS times, at quantiles
of a sample of that leaf, fitted leaf by leaf in tasks. So leaves stay as small however large the table, and
nothing but the number of open leaves reaches the driver. Labels of up to LEAF vectors need no tree. A leaf
whose vectors mostly lie within the spill (a group of near copies) isn't split, which would only double it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.blocks import in_units, spread_labels, strips
from lyceum.llm.components import connected_components
from lyceum.llm.shared import cut, usable_vector

#: Vectors of a leaf above which it is split.
LEAF = 2_048
#: Splits of a leaf in one pass, and the vectors that place them.
LEVELS, LEAF_SAMPLE = 8, 4_096
#: Half the width of the spill band, in standard deviations that the projected gap of a pair at the threshold has.
SPILL = 0.3
#: Where a leaf may be split.
QUANTILES = (0.5, 0.4, 0.6, 0.3, 0.7)
#: Share of a leaf in the band from which it isn't split.
SOLID = 0.5
#: There are so many trees that a pair at the threshold, which a split parts with a chance of about 1 - STAYS, is
#: missed by all with a chance of MISS.
STAYS, MISS = 0.93, 5e-4
_MIX = (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15)


def trees_for(n: Column) -> Column:
    """The number of trees for n vectors of a label: one if they fit a leaf, more as trees get deeper."""
    depth = F.ceil(F.log2(n / F.lit(LEAF)))
    return F.when(depth <= 0, 1).otherwise(F.ceil(F.log(F.lit(MISS)) / F.log(1 - F.pow(F.lit(STAYS), depth)))).cast("int")


@lru_cache(maxsize=64)
def _directions(leaf: int, inner: int, dim: int) -> np.ndarray:
    """The projections of a leaf's inner nodes, in heap order (children of i: 2i+1, 2i+2); the name of the leaf is the seed."""
    found = np.random.default_rng(leaf & ((1 << 64) - 1)).standard_normal((inner, dim))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _band(threshold: float, dim: int) -> float:
    return SPILL * np.sqrt(max(0.0, 2 - 2 * threshold) / dim)


def medians(unit: np.ndarray, leaf: int, n: int, threshold: float) -> np.ndarray:
    """Where the inner nodes split, from a sample of unit vectors of a leaf that has n; NaN where a node isn't split."""
    levels = max(1, min(LEVELS, int(np.ceil(np.log2(n / LEAF)))))
    found = np.full(2**levels - 1, np.nan)
    directions, band = _directions(leaf, len(found), unit.shape[1]), _band(threshold, unit.shape[1])
    members = {0: np.arange(len(unit))}
    for node in range(len(found)):
        rows = members.pop(node, np.zeros(0, int))
        if len(rows) < 8 or n * len(rows) / len(unit) <= LEAF:
            continue
        at = unit[rows] @ directions[node]
        # Of several places the one with the fewest vectors around it, so that a tight group isn't cut or doubled.
        places = np.quantile(at, QUANTILES)
        around = np.array([(np.abs(at - place) < band).mean() for place in places])
        middle = places[np.argmin(around + 0.1 * np.abs(np.array(QUANTILES) - 0.5))]
        low = at < middle
        if around.min() < SOLID and low.any():
            found[node] = middle
            members[2 * node + 1], members[2 * node + 2] = rows[low], rows[~low]
    return found


def descend(unit: np.ndarray, leaf: int, found: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray]]:
    """(node, rows in it) of unit vectors; a row may be in several nodes."""
    directions, band = _directions(leaf, len(found), unit.shape[1]), _band(threshold, unit.shape[1])
    ends, open_ = [], [(0, np.arange(len(unit)))]
    while open_:
        node, rows = open_.pop()
        if not len(rows):
            continue
        if node >= len(found) or np.isnan(found[node]):
            ends.append((node, rows))
            continue
        at = unit[rows] @ directions[node] - found[node]
        open_ += [(2 * node + 1, rows[at < band]), (2 * node + 2, rows[at > -band])]
    return ends


def _child(leaf: int, node: int) -> int:
    """The name of a new leaf: 64 bits that tell it from all others."""
    x = ((leaf & ((1 << 64) - 1)) * _MIX[1] + node + 1) & ((1 << 64) - 1)
    x = ((x ^ (x >> 32)) * _MIX[0]) & ((1 << 64) - 1)
    x ^= x >> 29
    return x - (1 << 64) if x >> 63 else x


def _vectors(column: pa.Array | pa.ChunkedArray, rows: np.ndarray | None = None) -> np.ndarray:
    """A matrix of unit length rows, of vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column if rows is None else column.take(pa.array(rows))
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _split(open_: DataFrame, big: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, leaf, final) of the rows of big leaves, after up to LEVELS splits; final where a leaf can't be split."""
    inside = open_.join(big, "leaf").join(nodes.select("node", "v"), "node")
    chosen = F.pmod(F.xxhash64("node", "leaf"), F.lit(1 << 30)) < F.lit(float(1 << 30) * LEAF_SAMPLE) / F.col("n")

    def fit(rows: pa.Table) -> pa.Table:
        leaf, n = rows["leaf"][0].as_py(), rows["n"][0].as_py()
        found = medians(_vectors(rows["v"], np.argsort(np.asarray(rows["node"]))), leaf, n, threshold)
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "medians": pa.array([found], pa.list_(pa.float64()))})

    fitted = cut(inside.filter(chosen).groupBy("leaf").applyInArrow(fit, "leaf long, medians array<double>"), "forest-medians")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4_000):
                batch = whole.slice(start, 4_000)
                leaves, ids = np.asarray(batch.column(1)), np.asarray(batch.column(0))
                node, leaf, final = [], [], []
                for name in np.unique(leaves).tolist():
                    rows = np.flatnonzero(leaves == name)
                    found = batch.column(3)[int(rows[0])].as_py()
                    ends = descend(_vectors(batch.column(2), rows), name, np.array(found), threshold) if found else [(0, np.arange(len(rows)))]
                    for end, some in ends:
                        node.append(ids[rows[some]])
                        leaf.append(np.full(len(some), _child(name, end) if end else name))
                        final.append(np.full(len(some), end == 0))
                columns = [np.concatenate(c) if c else np.zeros(0) for c in (node, leaf, final)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2].astype(bool))], ["node", "leaf", "final"])

    down = inside.join(fitted, "leaf", "left").select("node", "leaf", "v", "medians")
    return down.mapInArrow(place, "node long, leaf long, final boolean")


def leaves_of(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, leaf): the leaves of all trees that each node (node, label, v) is in."""
    group = [F.col("label"), F.size("v").alias("dim")]
    sizes = nodes.groupBy(*group).agg(F.count("*").alias("n")).select(F.col("label").alias("l"), F.col("dim").alias("d"), trees_for(F.col("n")).alias("trees"))
    rooted = nodes.select("node", *group).join(sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
    rooted = rooted.select("node", "label", "dim", F.explode(F.sequence(F.lit(1), F.col("trees"))).alias("tree"))
    open_ = cut(rooted.select("node", F.xxhash64(F.col("label").cast("string"), "dim", "tree").alias("leaf")), "forest-open")
    done: list[DataFrame] = []
    while True:
        big = cut(open_.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF), "forest-big")
        if big.isEmpty():  # each pass halves what it can, so passes are as many as the logarithm of the table has eights of
            return reduce(DataFrame.union, done, open_)
        done.append(open_.join(big, "leaf", "left_anti").select("node", "leaf"))
        split = cut(_split(open_, big, nodes, threshold), "forest-open")
        done.append(split.filter("final").select("node", "leaf"))
        open_ = split.filter("not final").select("node", "leaf")


def _compare(unit: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, links counted here, and the smallest node that it reaches within the unit, of nodes that have either.

    Rows that share the first of all their leaves met there, so only the others are compared.
    """
    lists = unit["leaves"].combine_chunks()
    here = unit["leaf"][0].as_py()
    first = np.asarray(lists.flatten())[np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()]  # leaves are in order
    order = np.lexsort((np.asarray(unit["node"]), first))
    first = first[order]
    x = np.asarray(unit["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(order), -1)[order]
    norms = np.sqrt((x * x).sum(axis=1))
    part = np.asarray(unit["part"])[order]
    apart = unit["unit_a"][0].as_py() != unit["unit_b"][0].as_py()
    linked = np.zeros((len(x), len(x)), dtype=bool)
    bounds = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(x)]
    for low, high in zip(bounds, bounds[1:]):
        others = [slice(0, len(x))] if first[low] == here else [slice(0, low), slice(high, len(x))]
        for start in range(low, high, 512):
            strip = slice(start, min(start + 512, high))
            for other in others:
                near = (x[strip] @ x[other].T) / np.outer(norms[strip], norms[other]) >= threshold
                linked[strip, other] = near & (part[strip, None] != part[None, other]) if apart else near
    np.fill_diagonal(linked, False)
    some = np.flatnonzero(linked.any(axis=1))  # the rest has nothing to say
    some = some[np.argsort(np.asarray(unit["node"])[order[some]])]
    linked, order = linked[np.ix_(some, some)], order[some]
    ids, copies = np.asarray(unit["node"])[order], np.asarray(unit["copies"])[order].astype(np.float64)
    lists = lists.take(pa.array(order))
    owner, values = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
    owner, values = owner[values < here], values[values < here]
    by_leaf = np.argsort(values, kind="stable")
    counted = linked.copy()
    for rows in np.split(owner[by_leaf], np.flatnonzero(np.diff(values[by_leaf])) + 1):
        if len(rows) > 1:
            counted[np.ix_(rows, rows)] = False  # met in an earlier leaf
    counts = np.concatenate([counted[strip] @ copies for strip in strips(len(ids))]) if len(ids) else np.zeros(0)
    return ids, counts.astype(np.int64), ids[spread_labels(linked)]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Links are between vectors of equal, not null labels and equal lengths with a cosine (in double precision)
    of at least threshold. n_links counts the other vec_ids linked directly; component_id is the smallest
    vec_id reachable. Vectors that are null, zero or hold null or non-finite components, and rows without a
    label, link with nothing: 0 links, their own component, kept. Rows with a null vec_id come back with 0
    links, a null component_id, and kept. Of rows that repeat a vec_id the smallest (label, vector) counts,
    and each row gets its result. Equal vectors become one node with a number of copies before any
    comparison. An empty table gives an empty result; other columns are not read.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable_vector(F.col("embedding")))
    one = good.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("label", F.col("embedding").cast(kind).alias("v"))).alias("m"))
    one = cut(one.select("vec_id", "m.label", "m.v"), "forest-vectors")
    nodes = cut(one.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "forest-nodes")
    placed = cut(leaves_of(nodes, threshold), "forest-leaves")
    listed = nodes.join(placed.groupBy("node").agg(F.array_sort(F.collect_list("leaf")).alias("leaves")), "node")
    units = in_units(placed, ["leaf"], F.col("node")).join(listed, "node")

    def look(table: pa.Table) -> pa.Table:
        found = _compare(table, threshold)
        return pa.table({"node": pa.array(found[0], pa.int64()), "links": pa.array(found[1], pa.int64()), "root": pa.array(found[2], pa.int64())})

    seen = units.groupBy("label", "leaf", "unit_a", "unit_b").applyInArrow(look, "node long, links long, root long")
    seen = cut(seen, "forest-links")
    links = seen.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(seen.select(F.col("node").alias("a"), F.col("root").alias("b")))
    by_node = nodes.join(links, "node", "left").join(groups, "node", "left")
    by_node = by_node.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    by_id = one.join(by_node, ["label", "v"]).select(F.col("vec_id").alias("id"), "n_links", "component_id")
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(by_id, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
