"""Passages that repeat: paragraphs by MinHash banding, and passages inside paragraphs by anchored windows.

A paragraph is a line of at least LEAST_WORDS words, or a run of shorter lines (hard-wrapped text) that together
have as many: such a run ends at a blank line once it has enough words, and at a longer line. Shorter lines that
stand alone between longer ones are no paragraph. Its five-word shingles give a MinHash signature, whose bands are tuned for a recall of candidates. Paragraphs that collide in a band are joined to a cluster of
candidates (by star links, so a bucket of any size costs one link a member); within a cluster the exact
Jaccard similarity decides, in blocks, and the components of verified links are the classes.

A passage that sits inside longer paragraphs, or runs over several, is found by its windows: wherever the
hash of a shingle is the smallest among its neighbours, LEAST_WORDS words from there on are an entry. Any
passage of LEAST_PASSAGE = LEAST_WORDS + NEIGHBOURS - 1 words holds the same entry wherever it stands. Equal entries
link, and where they end a run they are made longer word by word, as long as the longer window stands elsewhere
too. A passage goes on for less than NEIGHBOURS words beyond its first and last entry, so this reaches its ends.
Runs of fewer than LEAST_PASSAGE words would be found or not by their hashes, so they are left out.

Words are runs of characters other than space and U+0009 to U+000D; A-Z count as a-z.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyceum.llm.blocks import in_units, spread_labels
from lyceum.llm.components import connected_components
from lyceum.llm.shared import cut

LEAST_WORDS = 24
NEIGHBOURS = 27
LEAST_PASSAGE = LEAST_WORDS + NEIGHBOURS - 1
SHINGLE = 5
#: The table of paragraphs to verify goes to every task up to so many rows (about 50 bytes each); else it is joined by shuffle.
MOST_BROADCAST = 400_000

#: Surroundings of entries compared at once, on average (about 300 bytes each).
BUCKET = 10_000

#: Bytes of a text, and hashes of a table, worked on at once.
_PIECE = 1 << 20
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ENTRY, _PARAGRAPH, _WITHIN, _AGAIN = 0, 1, 2, 3
_ROWS = "kind int, doc_id long, a long, b long, start int, stop int, word int, bands array<long>"


def tuned_bands(similarity: float, recall: float = 0.995, rows: int = 3) -> int:
    """The smallest number of bands of `rows` hashes that collide at `similarity` with the given probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


class _Powers:
    """Powers of two odd numbers and of their inverses modulo 2^64, as long as the longest text so far."""

    def __init__(self):
        self.n = 0

    def up_to(self, n: int) -> None:
        if n > self.n:
            self.n = max(1 << 12, 1 << n.bit_length())
            self.power, self.inverse = [], []
            for odd in _ODD:
                for of, into in ((odd, self.power), (pow(odd, -1, 1 << 64), self.inverse)):
                    steps = np.full(self.n, of, dtype=np.uint64)
                    steps[0] = 1
                    into.append(np.multiply.accumulate(steps))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) over each full window."""
    have = 1
    while 2 * have <= width:
        x = of(x[:-have], x[have:])
        have *= 2
    return of(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _runs(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of start, united where they touch."""
    reach = np.maximum.accumulate(stops)
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    return starts[at], np.maximum.reduceat(stops, at)


def _paragraphs(low: np.ndarray, high: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each paragraph, from the words and the number of each line that has any."""
    if (high - low >= LEAST_WORDS).all():
        return low, high
    out, start, end, before = [], -1, -1, -1
    for i, j, at in zip(low.tolist(), high.tolist(), line.tolist()):
        long = j - i >= LEAST_WORDS
        if start >= 0 and (long or at > before + 1 and end - start >= LEAST_WORDS):
            out.append((start, end))
            start = -1
        if long:
            out.append((i, j))
        else:
            start, end = (i if start < 0 else start), j
        before = at
    if start >= 0:
        out.append((start, end))
    i, j = np.array(out, dtype=np.int64).reshape(-1, 2).T
    enough = j - i >= LEAST_WORDS
    return i[enough], j[enough]


class Reader:
    """Entries and paragraphs of texts."""

    def __init__(self, bands: int, rows: int):
        self.powers, self.bands, self.rows = _Powers(), bands, rows
        rng = np.random.default_rng(5)
        self.scale = rng.integers(1, 1 << 63, size=bands * rows, dtype=np.uint64) | np.uint64(1)

    def words(self, text: str):
        """Word hashes, code-point starts and ends, and lines of the words."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
        blank = np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]])
        starts = np.flatnonzero(blank[:-1] & ~blank[1:])
        ends = np.flatnonzero(~blank[:-1] & blank[1:])
        places = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        lines = np.cumsum(raw == 10)[starts] if len(starts) else starts
        hashes, i = np.empty(len(starts), dtype=np.uint64), 0
        while i < len(starts):  # in pieces, so that a very long text needs no more powers than its longest word
            low = starts[i]
            j = int(np.searchsorted(starts, low + _PIECE))
            piece = raw[low : ends[j - 1]]
            self.powers.up_to(len(piece) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * self.powers.power[0][: len(piece)], dtype=np.uint64)])
            at, to = starts[i:j] - low, ends[i:j] - low
            hashes[i:j] = _mixed((sums[to] - sums[at]) * self.powers.inverse[0][at] + (to - at).astype(np.uint64))
            i = j
        return hashes, places[starts].astype(np.int32), places[ends].astype(np.int32), lines

    def shingles(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) - SHINGLE + 1
        total = np.zeros(n, dtype=np.uint64)
        for j in range(SHINGLE):
            total += hashes[j : j + n] * self.powers.power[0][j]
        return _mixed(total)

    def digests(self, hashes: np.ndarray):
        """A function of ends (i, j): two 64-bit digests of the words between."""
        self.powers.up_to(len(hashes) + 1)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * p[: len(hashes)], dtype=np.uint64)]) for p in self.powers.power]
        return lambda i, j: [_mixed((s[j] - s[i]) * inverse[i] + (j - i).astype(np.uint64)).view(np.int64) for s, inverse in zip(sums, self.powers.inverse)]

    def read(self, text: str):
        """Yields (kind, a, b, start, stop, word, bands) as arrays; word is the first one's number, bands is None but for paragraphs."""
        with np.errstate(over="ignore"):
            hashes, starts, ends, lines = self.words(text)
            n = len(hashes)
            if n < LEAST_WORDS:
                return
            digests = self.digests(hashes)
            shingles = self.shingles(hashes)
            within: list[tuple[np.ndarray, np.ndarray]] = []

            def first_of_each(i: np.ndarray, j: np.ndarray):
                a, b = digests(i, j)
                _, first = np.unique(a, return_index=True)
                if len(first) < len(a):
                    again = np.ones(len(a), dtype=bool)
                    again[first] = False
                    within.append((starts[i[again]], ends[j[again] - 1]))
                first.sort()
                return a[first], b[first], i[first], j[first]

            width = min(NEIGHBOURS, len(shingles))
            least = _sliding(shingles, width, np.minimum)
            padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
            anchors = np.flatnonzero(shingles == _sliding(padded, width, np.maximum))
            anchors = anchors[anchors + LEAST_WORDS <= n]
            if len(anchors):
                a, b = digests(anchors, anchors + LEAST_WORDS)
                again = np.ones(len(a), dtype=bool)
                again[np.unique(a, return_index=True)[1]] = False
                for kind, at in ((_ENTRY, ~again), (_AGAIN, again)):
                    yield kind, a[at], b[at], starts[anchors[at]], ends[anchors[at] + LEAST_WORDS - 1], anchors[at].astype(np.int32), None
            low = np.concatenate([[0], np.flatnonzero(np.diff(lines)) + 1])
            high = np.concatenate([low[1:], [n]])
            low, high = _paragraphs(low, high, lines[low])
            if len(low):
                a, b, i, j = first_of_each(low, high)
                edges = np.stack([i, j - SHINGLE + 1], axis=1).ravel()
                some = np.append(shingles, np.uint64(0xFFFFFFFFFFFFFFFF))
                least = np.empty((len(self.scale), len(a)), dtype=np.uint64)
                step = max(1, _PIECE // len(some))  # so many hashes at once that memory stays bounded
                for k in range(0, len(self.scale), step):
                    value = some[None, :] * self.scale[k : k + step, None]
                    value ^= value >> np.uint64(31)
                    least[k : k + step] = np.minimum.reduceat(value, edges, axis=1)[:, ::2]
                joined = np.tile(np.arange(self.bands, dtype=np.uint64)[:, None], (1, len(a)))
                for r in range(self.rows):
                    joined = joined * np.uint64(_ODD[1]) + least[r :: self.rows]
                yield _PARAGRAPH, a, b, starts[i], ends[j - 1], i.astype(np.int32), np.ascontiguousarray(_mixed(joined).T).view(np.int64)
            if within:
                i, j = (np.concatenate(x) for x in zip(*within))
                order = np.argsort(i, kind="stable")
                i, j = _runs(i[order], j[order])
                none = np.zeros(len(i), dtype=np.int64)
                yield _WITHIN, none, none, i, j, none.astype(np.int32), None


def _read(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(bands, rows)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                parts = [[] for _ in range(7)]
                lists, offsets, size = [], [np.zeros(1, np.int32)], 0
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for kind, a, b, i, j, word, signature in reader.read(text.as_py() or ""):
                        for part, x in zip(parts, (np.full(len(a), kind, np.int32), np.full(len(a), doc_id, np.int64), a, b, i, j, word)):
                            part.append(x)
                        step = 0 if signature is None else signature.shape[1]
                        if step:
                            lists.append(signature.ravel())
                        offsets.append(size + step * np.arange(1, len(a) + 1, dtype=np.int32))
                        size += step * len(a)
                if parts[0]:
                    columns = [pa.array(np.concatenate(p)) for p in parts]
                    values = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.concatenate(offsets)), values)], ["kind", "doc_id", "a", "b", "start", "stop", "word", "bands"])

    named = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ROWS)


def candidate_clusters(paragraphs: DataFrame) -> DataFrame:
    """(node, component): clusters of paragraphs, by `a`, that bands tie together. A false tie is harmless here."""
    keys = paragraphs.select("a", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("a").alias("leader"), F.max("a").alias("last")).filter("leader < last").select("key", "leader")
    return connected_components(keys.join(buckets, "key").filter("a <> leader").select("a", F.col("leader").alias("b")))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cluster, node and the distinct shingles of the paragraphs wanted (doc_id, start, stop, a, b, node, cluster)."""
    by_doc = wanted.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("cluster", "node", "a", "b", "start", "stop")).alias("__wanted"))
    by_doc = F.broadcast(by_doc) if wanted.count() <= MOST_BROADCAST else by_doc
    found = docs.join(by_doc, F.col("doc_id") == F.col("__doc")).select("text", "__wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(1, 1)
        with np.errstate(over="ignore"):
            for batch in batches:
                clusters, nodes, sets = [], [], []
                for text, wants in zip(batch.column(0), batch.column(1)):
                    hashes, starts, ends, _ = reader.words(text.as_py() or "")
                    digests = reader.digests(hashes)
                    for w in wants.as_py():
                        i, j = np.searchsorted(starts, w["start"]), np.searchsorted(ends, w["stop"]) + 1
                        if SHINGLE <= j - i and j <= len(hashes) and [x[0] for x in digests(np.array([i]), np.array([j]))] == [w["a"], w["b"]]:
                            clusters.append(w["cluster"])
                            nodes.append(w["node"])
                            sets.append(np.unique(reader.shingles(hashes[i:j])).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int64()), pa.array(nodes, pa.string()), pa.array(sets, pa.list_(pa.int64()))], ["cluster", "node", "shingles"])

    return found.mapInArrow(run, "cluster long, node string, shingles array<long>")


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Word hashes and steps (code points from edge to edge) of the up to NEIGHBOURS - 1 words on either side of the entries wanted (doc_id, start, a, b, left, right).

    at and to are the entry's start and stop, word its first word's number; a and b digest it with the nearest word of that side.
    Entries whose surroundings an earlier place of their text has in full go as far as these: they come united, as spans (at, to)
    from one word to the end of another (word, end), without words. end is null where surroundings are to be compared.
    """
    by_doc = wanted.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("a", "b", "start", "left", "right")).alias("__wanted"))
    by_doc = F.broadcast(by_doc) if wanted.count() <= MOST_BROADCAST else by_doc
    found = docs.join(by_doc, F.col("doc_id") == F.col("__doc")).select(F.col("__doc").alias("doc_id"), "text", "__wanted")

    names = ["doc_id", "at", "to", "word", "end", "before", "a", "b", "words", "steps"]

    def around(reader: Reader, doc_id: int, text: str, wants: pa.StructArray) -> Iterator[pa.RecordBatch]:
        hashes, starts, ends, _ = reader.words(text)
        digests = reader.digests(hashes)
        a, b, start, left, right = (np.asarray(wants.field(k).to_numpy(zero_copy_only=False)) for k in range(5))
        order = np.argsort(start, kind="stable")
        a, b, start, left, right = (x[order] for x in (a, b, start, left, right))
        i = np.searchsorted(starts, start)
        fits = i + LEAST_WORDS <= len(hashes)
        a, b, i, left, right = (x[fits] for x in (a, b, i, left, right))
        same = np.logical_and(*(x == y for x, y in zip(digests(i, i + LEAST_WORDS), (a, b))))  # rows that repeat a doc_id may differ
        i, left, right = i[same], left[same], right[same]
        for before, here in ((True, i[left & (i > 0)]), (False, i[right & (i + LEAST_WORDS < len(hashes))])):
            stop = here + LEAST_WORDS
            n = np.minimum(NEIGHBOURS - 1, here if before else len(hashes) - stop)
            low, high = (here - n, stop) if before else (here, stop + n)
            again = np.ones(len(here), dtype=bool)
            again[np.unique(digests(low, high)[0], return_index=True)[1]] = False
            if again.any():
                i, j = _runs(starts[low[again]], ends[high[again] - 1])
                none = np.zeros(len(i), dtype=np.int64)
                columns = [np.full(len(i), doc_id, np.int64), i, j, np.searchsorted(starts, i).astype(np.int32), (np.searchsorted(ends, j) + 1).astype(np.int32), np.full(len(i), before), none, none]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([[]] * len(i), pa.list_(pa.int64())), pa.array([[]] * len(i), pa.list_(pa.int32()))], names)
            here, stop, n = here[~again], stop[~again], n[~again]
            offsets = np.concatenate([[0], np.cumsum(n)])
            step = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
            at = np.repeat(here, n) - 1 - step if before else np.repeat(stop, n) + step
            onward = starts[at + 1] - starts[at] if before else ends[at] - ends[at - 1]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (hashes[at].view(np.int64), onward)]
            columns = [np.full(len(here), doc_id, np.int64), starts[here], ends[stop - 1], here.astype(np.int32), pa.nulls(len(here), pa.int32()), np.full(len(here), before), *digests(here - before, stop + (not before))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(1, 1)
        with np.errstate(over="ignore"):
            for batch in batches:
                for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                    yield from around(reader, doc_id, text.as_py() or "", batch.column(2)[k].values)

    return found.mapInArrow(run, "doc_id long, at int, to int, word int, end int, before boolean, a long, b long, words array<long>, steps array<int>")


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal rows, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.logical_or.reduce([np.diff(c[order]) != 0 for c in columns])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.concatenate([[0], np.cumsum(new)])
    return out


def _as_far_as_shared(rows: pa.Table) -> pa.Table:
    """Entries with their surroundings as far as they stand elsewhere too: what an earlier place has, and what only later documents have."""
    known = rows.filter(pc.is_valid(rows["end"]))
    out = [pa.table({"doc_id": known["doc_id"], "start": known["at"], "stop": known["to"], "word": known["word"], "end": known["end"], "first": known["doc_id"], "kept": pa.array(np.zeros(len(known), dtype=bool))})]
    rows = rows.filter(pc.is_null(rows["end"])).combine_chunks()
    if not len(rows):
        return out[0]
    doc, at, to, word, before, a, b = (np.asarray(rows[c].combine_chunks().to_numpy(zero_copy_only=False)) for c in ("doc_id", "at", "to", "word", "before", "a", "b"))
    lists = [rows[c].combine_chunks() for c in ("words", "steps")]
    words, steps = (np.asarray(x.flatten()) for x in lists)
    onward = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    n = np.asarray(lists[0].value_lengths())
    first_word = np.concatenate([[0], np.cumsum(n)])[:-1]
    place = _numbered(doc, at)
    doc_of = np.empty(place.max() + 1, dtype=np.int64)
    doc_of[place] = doc
    alive, group = np.arange(len(doc)), _numbered(before.astype(np.int64), a, b)
    reach = np.zeros((2, len(doc)), dtype=np.int64)
    first = np.full((2, len(doc)), np.iinfo(np.int64).max)
    for e in range(1, NEIGHBOURS):
        least, most = np.full(group.max() + 1, len(doc)), np.full(group.max() + 1, -1)
        np.minimum.at(least, group, place[alive])
        np.maximum.at(most, group, place[alive])
        leader, last = least[group], most[group]
        gone = place[alive] > leader
        kept = ~gone & (doc_of[last] > doc[alive])
        for k, here in ((0, gone), (1, kept)):
            reach[k, alive[here]] = e
            first[k, alive[here]] = np.minimum(first[k, alive[here]], doc_of[leader[here]])
        more = (leader < last) & (n[alive] > e)
        alive, group = alive[more], group[more]
        if not len(alive):
            break
        group = _numbered(group, words[first_word[alive] + e])
    for k in (0, 1):
        i = np.flatnonzero(reach[k])
        far = (onward[first_word[i] + reach[k, i]] - onward[first_word[i]]).astype(np.int32)
        span = {"start": at[i] - before[i] * far, "stop": to[i] + ~before[i] * far}
        numbers = {"word": (word[i] - before[i] * reach[k, i]).astype(np.int32), "end": (word[i] + LEAST_WORDS + ~before[i] * reach[k, i]).astype(np.int32)}
        out.append(pa.table({"doc_id": doc[i], **span, **numbers, "first": first[k, i], "kept": np.full(len(i), k == 1)}))
    return pa.concat_tables(out)


def _entries(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, start, stop, first, kept): passages of at least LEAST_PASSAGE words around entries that stand elsewhere too, to their ends."""
    entries = found.filter(F.col("kind").isin(_ENTRY, _AGAIN)).select("a", "b", "doc_id", "start", "stop", "word", (F.col("kind") == _AGAIN).alias("again"))

    held = entries.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("again").cast("int")).alias("repeated"))
    kept = (F.col("doc_id") == F.col("first")) & ~F.col("again")  # no document or place comes before
    shared = entries.join(held.filter("first < last or repeated > 0"), ["a", "b"]).withColumn("kept", kept).filter(~kept | (F.col("first") < F.col("last")))
    numbers = [F.min("word").alias("word"), F.max("end").alias("end")]
    outer = [f(F.struct("a", "b"), F.struct("start", "a", "b")).alias(n) for f, n in ((F.min_by, "leftmost"), (F.max_by, "rightmost"))]
    runs = cut(_united(shared.withColumn("end", F.col("word") + LEAST_WORDS), numbers + outer), "passages-runs", tidy=True)
    ends = runs.select("leftmost.*", F.lit(True).alias("left"), F.lit(False).alias("right")).union(runs.select("rightmost.*", F.lit(False), F.lit(True))).groupBy("a", "b").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    # What stands elsewhere as a part of a longer run counts as well, so all places of such entries are wanted.
    wanted = cut(entries.join(ends, ["a", "b"]).select("doc_id", "start", "a", "b", "left", "right").distinct(), "passages-ends", tidy=True)
    sides = wanted.agg(F.sum(F.col("left").cast("int") + F.col("right").cast("int"))).first()[0] or 0
    # By the nearest word too, so places of a common entry are apart unless they go on alike.
    buckets = max(1, sides // BUCKET)
    dealt = F.when(F.col("end").isNull(), F.xxhash64("before", "a", "b")).otherwise(F.xxhash64("doc_id", "at"))
    around = _surroundings(docs, wanted).withColumn("bucket", F.pmod(dealt, F.lit(buckets)))
    longer = around.groupBy("bucket").applyInArrow(_as_far_as_shared, "doc_id long, start int, stop int, word int, end int, first long, kept boolean")
    longer = cut(longer, "passages-longer", tidy=True)  # the texts that were shuffled to find them go
    every = runs.select("doc_id", "start", "stop", "word", "end", "first", "kept").union(longer)
    return _united(every, numbers).filter(F.col("end") - F.col("word") >= LEAST_PASSAGE).select("doc_id", "start", "stop", "first", "kept")


def _united(spans: DataFrame, more: list | None = None) -> DataFrame:
    """Spans (doc_id, start, stop, first, kept) united where they touch, with the smallest first of each run."""
    in_order = Window.partitionBy("doc_id", "kept").orderBy("start", "stop", "first")
    reach = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = opened.withColumn("run", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "kept", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first").alias("first"), *(more or []))


def _compare(unit: pa.Table, similarity: float) -> pa.Table:
    """Spanning links of a unit: each node with the smallest that it reaches there."""
    nodes = np.array(unit["node"].to_pylist(), dtype=object)
    lists = unit["shingles"].combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets)).astype(np.float64)
    owner = np.repeat(np.arange(len(nodes)), sizes.astype(int))
    names, columns, counts = np.unique(np.asarray(lists.flatten()), return_inverse=True, return_counts=True)
    shared = counts[columns] > 1
    keep, columns = np.unique(columns[shared], return_inverse=True)
    owner = owner[shared]
    common = np.zeros((len(nodes), len(nodes)))
    order = np.argsort(columns, kind="stable")
    columns, owner = columns[order], owner[order]
    for low in range(0, len(keep), 4096):  # bounded memory, whatever the number of shingles
        here = slice(np.searchsorted(columns, low), np.searchsorted(columns, low + 4096))
        matrix = np.zeros((len(nodes), min(4096, len(keep) - low)), dtype=np.float32)
        matrix[owner[here], columns[here] - low] = 1
        common += matrix @ matrix.T
    linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if unit["unit_a"][0].as_py() != unit["unit_b"][0].as_py():
        part = np.asarray(unit["part"])
        linked &= part[:, None] != part[None, :]
    labels = spread_labels(linked)
    tied = np.flatnonzero(labels != np.arange(len(nodes)))
    return pa.table({"a": pa.array(nodes[tied].tolist(), pa.string()), "b": pa.array(nodes[labels[tied]].tolist(), pa.string())})


def repeats(docs: DataFrame, similarity: float = 0.8, recall: float = 0.995, rows: int = 3) -> DataFrame:
    """(doc_id, start, stop, first_doc_id, kept): paragraphs, and passages of at least LEAST_PASSAGE words, that stand
    in several documents, or again in their own.

    start and stop are code points, stop exclusive; spans that touch are united. In the document with the
    smallest doc_id that holds a passage, or a paragraph of its class, the passage is kept; elsewhere it goes,
    as do repeats within a document. first_doc_id is the smallest such document over the united spans.
    Documents without repeats have no rows. Null and empty texts and rows with a null doc_id take no part;
    rows that repeat a doc_id are one document; only doc_id and text are read.
    """
    found = cut(_read(docs, tuned_bands(similarity, recall, rows), rows), "passages")
    by_entry = _entries(docs, found)
    paragraphs = found.filter(F.col("kind") == _PARAGRAPH)
    classes = cut(paragraphs.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "passages-paragraphs", tidy=True)
    near = _verified(docs, paragraphs, classes, similarity)
    hexes = F.concat(F.hex("a"), F.lit("-"), F.hex("b"))
    tied = classes.join(near.select(F.col("a").alias("na"), F.col("b").alias("nb"), "component"), (F.col("a") == F.col("na")) & (F.col("b") == F.col("nb")), "left")
    tied = cut(tied.select("a", "b", "first", "last", F.coalesce("component", hexes).alias("component")), "passages-classes", tidy=True)
    ends = tied.groupBy("component").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first < last").select("component", "first")
    by_class = tied.select("a", "b", "component").join(ends, "component").select("a", "b", "first")
    by_paragraph = paragraphs.select("a", "b", "doc_id", "start", "stop").join(by_class, ["a", "b"]).select("doc_id", "start", "stop", "first")
    within = found.filter(F.col("kind") == _WITHIN).select("doc_id", "start", "stop", F.col("doc_id").alias("first"), F.lit(False).alias("kept"))
    spans = by_paragraph.withColumn("kept", F.col("doc_id") == F.col("first")).union(within).union(by_entry)
    return _united(spans).select("doc_id", "start", "stop", F.col("first").alias("first_doc_id"), "kept")


def _verified(docs: DataFrame, paragraphs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, component): paragraphs that an exact Jaccard similarity ties to others, and the smallest node they reach."""
    clusters = candidate_clusters(paragraphs).select(F.col("node").alias("c"), F.col("component").alias("cluster"))
    one_each = classes.join(clusters, F.col("a") == F.col("c")).select("a", "b", "first", "cluster")
    where = paragraphs.select(F.col("a").alias("pa"), F.col("b").alias("pb"), "doc_id", "start", "stop")
    wanted = one_each.join(where, (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")) & (F.col("first") == F.col("doc_id")))
    node = F.concat(F.hex("a"), F.lit("-"), F.hex("b")).alias("node")
    wanted = cut(wanted.select("doc_id", "start", "stop", "a", "b", node, "cluster").distinct(), "passages-wanted", tidy=True)
    sets = cut(_sets(docs, wanted).dropDuplicates(["node"]), "passages-sets", tidy=True)
    units = in_units(sets, ["cluster"], F.col("node"), block=256)
    links = units.groupBy("cluster", "unit_a", "unit_b").applyInArrow(lambda t: _compare(t, similarity), "a string, b string")
    groups = connected_components(links)
    number = lambda part: F.conv(F.substring_index("node", "-", part), 16, -10).cast("long")
    return groups.select(number(1).alias("a"), number(-1).alias("b"), "component")


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs with the passages that repeats() doesn't keep taken out of their texts; all columns stay."""
    gone = repeats(docs, **how).filter(~F.col("kept")).groupBy(F.col("doc_id").alias("__doc")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__gone"))
    found = docs.join(gone, F.col("doc_id") == F.col("__doc"), "left")
    text = F.col("text")

    def step(state, span):
        piece = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), F.array_append(state["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("__gone", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.col("__gone").isNull(), text).otherwise(clean)).select(*docs.columns)
