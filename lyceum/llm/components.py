"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import cut, fresh_path, remove

#: A node is a hub if it has more than this share of all links (and more than LEAST_HUB): at most 1 / HUB_SHARE nodes.
HUB_SHARE, LEAST_HUB = 0.001, 200


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over links (a, b): each batch's nodes with the smallest that they reach within it."""
    for batch in batches:
        ends = pa.concat_arrays([batch.column(0), batch.column(1)]).dictionary_encode()
        names = ends.dictionary
        order = pc.sort_indices(names)
        rank = np.empty(len(names), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        a, b = rank[ends.indices.to_numpy()].reshape(2, -1)
        labels = np.arange(len(names))
        while True:
            low = np.minimum(labels[a], labels[b])
            new = labels.copy()
            for at in (a, b, labels[a], labels[b]):
                np.minimum.at(new, at, low)
            new = new[new]
            if (new == labels).all():
                break
            labels = new
        tied = np.flatnonzero(labels != np.arange(len(names)))
        names = names.take(order)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(tied)), names.take(pa.array(labels[tied]))], ["a", "b"])


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components, as few as the rows that stand together in a batch allow. No shuffle."""
    kind = links.schema["a"].dataType.simpleString()
    return links.select("a", "b").mapInArrow(spanning, f"a {kind}, b {kind}")


def _with_least(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """rows (k, x) with m of least (a row per k), null where it has none.

    The rows of hubs, keys with more than `most` rows, meet a broadcast copy, so they stay where they are.
    """
    hubs = F.broadcast(rows.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("k"))
    rest = rows.join(hubs, "k", "left_anti").join(least, "k", "left")
    return rest.union(rows.join(hubs, "k", "left_semi").join(F.broadcast(least.join(hubs, "k", "left_semi")), "k", "left").select("k", "x", "m"))


def _step(links: DataFrame, most: int) -> DataFrame:
    """A large star and a small star over links (u, v) with u > v.

    Large: every node sends its larger neighbours to the smallest node that it knows. Small: it sends its
    smaller neighbours, and itself, to the smallest of them.
    """
    least = links.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    large = _with_least(links.select(F.col("v").alias("k"), F.col("u").alias("x")), least, most)
    large = large.select(F.col("x").alias("u"), F.coalesce("m", "k").alias("v")).distinct()
    least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    small = _with_least(large.select(F.col("u").alias("k"), F.col("v").alias("x")), least, most)
    return small.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable.

    Node ids may be of any type that Spark orders. Links of a node with itself and null ends count for
    nothing; an empty link table gives an empty result. Links that stand together are contracted before the
    first shuffle. Each round is four aggregations, which combine before the shuffle, and two joins, from
    which hubs are taken out: these are at most 1 / HUB_SHARE nodes, so what is broadcast is bounded. Nothing
    is collected but counts and a checksum. A round's table is deleted once the next is written.
    """
    spark = links.sparkSession
    now = contracted(links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))))
    path = fresh_path(spark, "links")
    now = cut(now.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links", path)
    state = None
    for _ in range(rounds):
        before, state = state, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))).first()
        if state == before or not state[0]:
            break
        old, path = path, fresh_path(spark, "links")
        now = cut(_step(now, max(LEAST_HUB, int(HUB_SHARE * state[0]))), "links", path)
        remove(spark, old)
    else:
        raise RuntimeError(f"components didn't settle within {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
