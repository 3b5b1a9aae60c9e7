"""Benchmark decontamination by winnowing.

Of every window of `window` consecutive words the smallest hash of its k-grams (k = (window + 1) // 2) is kept, on
both sides alike, so a document that shares a whole window with a benchmark item shares its fingerprint: no shared
span of `window` words or more is missed. Fingerprints of the items go into a Bloom filter of bounded size;
documents send on only the windows whose fingerprint it may hold, once per document with the places where they
stand. These meet the windows of the items by fingerprint, and the match is extended by comparing the whole
windows, word by word. An item of fewer words is one window, whose fingerprint is the hash of all its words; the
lengths that occur, fewer than `window`, are looked for one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.shared import cut
from lyceum.llm.word_arrays import filter_of, gram_hashes, hashes, letters_and_digits, slices, words

_FOUND = "array<struct<fp:long,span:string,size:int,starts:array<int>>>"


def fingerprints(word_hashes: np.ndarray, size: int, window: int) -> np.ndarray:
    """The fingerprint of each run of `size` words: the smallest k-gram hash of a full window, else the hash of the run."""
    if size < window:
        return gram_hashes(word_hashes, size)
    k = (window + 1) // 2
    grams = gram_hashes(word_hashes, k)
    n = max(0, len(word_hashes) - window + 1)
    found = grams[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(found, grams[j : j + n], out=found)
    return found


def _spans(vocabulary: pa.Array, ids: np.ndarray, starts: np.ndarray, size: int) -> pa.Array:
    """The words from each start on, joined by spaces."""
    columns = [vocabulary.take(pa.array(ids[starts + j])) for j in range(size)]
    return pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string())


def _item_windows(window: int):
    """For mapInArrow over (item_id, text): every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = letters_and_digits()
        for batch in batches:
            for first, rows in slices(batch.column(1)):
                w = words(batch.column(1).slice(first, rows), classes)
                own = w.per_doc(rows)
                h = hashes(w.vocabulary)[w.ids] if len(w.ids) else np.zeros(0, np.uint64)
                begins = np.concatenate([[0], np.cumsum(own)])[:-1]
                for size in sorted({min(int(n), window) for n in own if n}):
                    fits = own >= window if size == window else own == size
                    starts = np.flatnonzero(fits[w.doc] & (np.arange(len(w.ids)) - begins[w.doc] <= own[w.doc] - size))
                    fp = fingerprints(h, size, window)[starts]
                    ids = batch.column(0).take(pa.array(first + w.doc[starts]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64)), _spans(w.vocabulary, w.ids, starts, size).cast(pa.string()), pa.array(np.full(len(starts), size), pa.int32())], ["item", "fp", "span", "size"])

    return run


def _found_windows(wanted, sizes: list[int], window: int):
    """For mapInArrow over (text): n_words, and the windows whose fingerprint the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, held = letters_and_digits(), wanted.value
        for batch in batches:
            for first, rows in slices(batch.column(0)):
                w = words(batch.column(0).slice(first, rows), classes)
                own = w.per_doc(rows)
                h = hashes(w.vocabulary)[w.ids] if len(w.ids) else np.zeros(0, np.uint64)
                begins = np.concatenate([[0], np.cumsum(own)])[:-1]
                parts = []
                for size in sizes:
                    fp = fingerprints(h, size, window)
                    new = np.concatenate([[True], fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, bool)
                    hit = held.holds(fp[new])[np.cumsum(new) - 1] if len(fp) else new  # neighbours share most fingerprints
                    starts = np.flatnonzero(hit)
                    starts = starts[w.doc[starts] == w.doc[starts + size - 1]]
                    parts += zip(w.doc[starts].tolist(), fp[starts].view(np.int64).tolist(), _spans(w.vocabulary, w.ids, starts, size).to_pylist(), [size] * len(starts), (starts - begins[w.doc[starts]]).tolist())
                found: dict[int, dict[tuple[int, str, int], list[int]]] = {}
                for doc, fp, span, size, start in parts:
                    found.setdefault(doc, {}).setdefault((fp, span, size), []).append(start)
                hits = [[{"fp": k[0], "span": k[1], "size": k[2], "starts": s} for k, s in found.get(i, {}).items()] for i in range(rows)]
                kind = pa.list_(pa.struct([("fp", pa.int64()), ("span", pa.string()), ("size", pa.int32()), ("starts", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([*[c.slice(first, rows) for c in batch.columns[1:]], pa.array(own.astype(np.int64)), pa.array(hits, kind)], [*batch.schema.names[1:], "n_words", "found"])

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (their ids): a row for each row of docs.

    docs: (doc_id, text); items: (item_id, text); other columns aren't read. Words are runs of letters, digits and
    all beyond ASCII, A-Z in lower case. A word is hit if it lies inside any occurrence of a window of an item.
    Null and empty texts have no words; an item without words, or with a null item_id, takes no part. Rows that
    repeat a doc_id are judged one by one, null doc_ids too; rows that repeat an item_id are one item with the
    windows of all. Item ids are listed as strings, each once, in the order of their bytes. Without items no
    document is hit; without documents the result is empty.

    Windows that exactly the same items hold are one set, so a document meets each set once, whatever the number
    of copies among items. Which fingerprints exist is broadcast as a filter of bounded size, nothing else.
    """
    spark = docs.sparkSession
    named = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    held = named.mapInArrow(_item_windows(window), "item string, fp long, span string, size int")
    held = held.groupBy("fp", "span", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))
    held = cut(held.withColumn("set", F.sha2(F.to_json("items"), 256)), "winnow-items")
    sizes = sorted(r["size"] for r in held.select("size").distinct().collect())  # at most `window`
    wanted = spark.sparkContext.broadcast(filter_of(held.select(F.col("fp").alias("h")).distinct()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("text", "doc_id").mapInArrow(_found_windows(wanted, sizes, window), f"doc_id {kind}, n_words long, found {_FOUND}")
    found = cut(found.withColumn("row", F.monotonically_increasing_id()), "winnow-found")  # numbers hold once written
    hits = found.select("row", F.explode("found").alias("f")).select("row", "f.*")
    hits = cut(hits.join(held.select("fp", "span", "size", "set"), ["fp", "span", "size"]).select("row", "size", "starts", "set"), "winnow-hits")
    # Words covered: intervals in order, each counts from where the last ended.
    ends = F.transform("starts", lambda s: F.struct(s.alias("a"), (s + F.col("size")).alias("b")))
    step = lambda t, x: F.struct((t["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], t["b"]))).cast("long").alias("n"), F.greatest(t["b"], x["b"]).alias("b"))
    covered = hits.select("row", ends.alias("ends")).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends"))
    covered = covered.select("row", F.aggregate("ends", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("b")), step)["n"].alias("n_hit"))
    listed = hits.select("row", "set").distinct().join(held.select("set", "items").dropDuplicates(["set"]), "set")
    listed = listed.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = found.select("row", "doc_id", "n_words").join(covered, "row", "left").join(listed, "row", "left")
    rows = rows.withColumns({"items": F.coalesce("items", F.array().cast("array<string>")), "n_hit": F.coalesce("n_hit", F.lit(0).cast("long"))})
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs that hold no window of any item; columns as they came, rows with null doc_id judged as others.

    Rows that repeat a doc_id go or stay together.
    """
    bad = contamination(docs.select("doc_id", "text"), items, window).filter("contaminated").select(F.struct("doc_id").alias("key")).distinct()
    row = docs.select(F.struct("*").alias("row")).withColumn("key", F.struct(F.col("row.doc_id").alias("doc_id")))
    return row.join(bad, row["key"].eqNullSafe(bad["key"]), "left_anti").select("row.*")
