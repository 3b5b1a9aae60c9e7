"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits over word shingles. To find all pairs within `distance` bits without comparing
all pairs, the bits are cut into `segments` parts: two fingerprints at that distance agree in one part up to
floor(distance / segments) bits. Every fingerprint is entered in one table per segment under its exact
segment value; every fingerprint also asks each table for the small Hamming ball around its own value, and
each match is verified on all 64 bits. Links aren't handed on as pairs: what matches is contracted to spanning
links where it stands, and keys with many entries are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.blocks import in_units, spread_labels, strips
from lyceum.llm.components import connected_components, contracted
from lyceum.llm.shared import cut, held

#: Entries of a table key from which its members are compared in blocks; below it a join compares them.
FULL_KEY = 64
#: Fingerprints up to which three tables (2^21 keys, balls of radius 1) are used; beyond, two (2^32 keys, radius 2).
MOST_IN_THREE = 1 << 26


def simhash64(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text as a signed 64-bit integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts, ends[k - 1 :].tolist())), dtype="<u8", count=len(starts))
    votes = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        votes += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row of docs; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash64(t.as_py(), words_per_shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _ball(value: Column, width: int, radius: int) -> Column:
    """The values within radius bits whose lowest differing bit is 0 in value.

    Of two segment values that differ, exactly one sees the other so: each pair is met from one side.
    """
    masks = []
    for i in range(width if radius else 0):
        masks.append((1 << i, 1 << i))
        if radius > 1:
            masks += [(1 << i, 1 << i | 1 << j) for j in range(i + 1, width)]
    found = F.array(*[F.struct(F.lit(low).cast("long").alias("low"), F.lit(all_).cast("long").alias("all")) for low, all_ in masks]) if masks else None
    if found is None:
        return F.array().cast("array<bigint>")
    return F.transform(F.filter(found, lambda m: value.bitwiseAND(m["low"]) == 0), lambda m: value.bitwiseXOR(m["all"]))


def _table_key(segment: int, value: Column) -> Column:
    return F.lit(segment << 40).cast("long").bitwiseOR(value)


def _ask_ball(segment: int, ball: Column) -> Column:
    return F.transform(ball, lambda v: F.struct(_table_key(segment, v).alias("key"), F.lit(False).alias("same")))


def _compare(unit: pa.Table, distance: int) -> pa.Table:
    """Spanning links of a unit: those who ask a key against its entries."""
    node, fp, same, part = (np.asarray(unit[c].combine_chunks().to_numpy(zero_copy_only=False)) for c in ("node", "fp", "same", "part"))
    order = np.argsort(node)
    node, fp, same, part = node[order], fp[order].view(np.uint64), same[order].astype(bool), part[order]
    entries = np.flatnonzero(same)
    linked = np.empty((len(node), len(entries)), dtype=bool)
    apart = unit["unit_a"][0].as_py() != unit["unit_b"][0].as_py()
    for strip in strips(len(node)):
        linked[strip] = np.bitwise_count(fp[strip, None] ^ fp[None, entries]) <= distance
        if apart:
            linked[strip] &= part[strip, None] != part[None, entries]
    labels = spread_labels(linked, entries) if len(entries) else np.arange(len(node))
    tied = np.flatnonzero(labels != np.arange(len(node)))
    return pa.table({"a": pa.array(node[tied], pa.int64()), "b": pa.array(node[labels[tied]], pa.int64())})


def close_links(nodes: DataFrame, distance: int = 4, segments: int | None = None) -> DataFrame:
    """Links (a, b) between node ids that tie together whoever differs in at most `distance` bits.

    nodes: (node, fp) with distinct fp. The links have the components of all such pairs, and each is between
    nodes of one component; they aren't all pairs. segments: number of tables; by default three up to
    MOST_IN_THREE fingerprints and two beyond, so that keys hold few entries that don't match. Either is exact.
    """
    segments = segments or (3 if nodes.count() <= MOST_IN_THREE else 2)
    if distance // segments > 2:
        raise ValueError("balls of a radius over 2 are too large; use more segments")
    bounds = [64 * s // segments for s in range(segments + 1)]
    entries, asks = [], []
    for s, (low, high) in enumerate(zip(bounds, bounds[1:])):
        value = _segment(F.col("fp"), low, high - low)
        entries.append(_table_key(s, value))
        asks.append(F.array(F.struct(_table_key(s, value).alias("key"), F.lit(True).alias("same"))))
        asks.append(_ask_ball(s, _ball(value, high - low, distance // segments)))
    index = nodes.select(F.explode(F.array(*entries)).alias("key"), F.col("node").alias("b"), F.col("fp").alias("fb"))
    probe = nodes.select(F.explode(F.concat(*asks)).alias("ask"), "node", "fp").select("ask.key", "ask.same", "node", "fp")
    probe = cut(probe, "simhash-asked")  # read by three joins
    full = cut(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > FULL_KEY).select("key"), "simhash-full-keys")
    asking = probe.join(full, "key", "left_anti").select(F.col("key").alias("asked"), "same", F.col("node").alias("a"), F.col("fp").alias("fa"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance
    met = asking.join(index, (F.col("asked") == F.col("key")) & near & (~F.col("same") | (F.col("fa") < F.col("fb"))))
    units = in_units(probe.join(full, "key", "left_semi"), ["key"], F.col("node"))
    dense = units.groupBy("key", "unit_a", "unit_b").applyInArrow(lambda unit: _compare(unit, distance), "a long, b long")
    return contracted(met.select("a", "b")).union(dense)


def near_duplicates(docs: DataFrame, distance: int = 4, words_per_shingle: int = 4, seed: int = 42, segments: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    Documents of one fingerprint become one node before any search, so a group of copies of any size costs
    one node. component_id is the smallest doc_id reachable by links of at most `distance` bits, the
    document's own included. Null and empty texts have fingerprint 0 and link like any other. Rows with a
    null doc_id are returned and can't stand for a group: one that has no other row has a null component_id.
    Repeated rows are returned as often as they came. Very long texts are read whole, in pieces. Other
    columns, whatever their names, are not read.
    """
    fps = cut(fingerprints(docs, words_per_shingle, seed), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    groups = connected_components(close_links(nodes.filter("node is not null"), distance, segments))
    by_fp = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without the near-duplicates: of each component the document with the smallest doc_id stays.

    All columns of docs are kept, whatever their names. Rows that repeat one doc_id are one document and stay
    together; rows with a null doc_id stay.
    """
    gone = near_duplicates(docs, **how).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = held(docs)
    return rows.join(cut(gone, "simhash-gone"), F.col("row.doc_id").cast("long") == F.col("gone"), "left_anti").select("row.*")
