"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over a window of 16 bytes cuts texts where their content says so, so texts that share a
passage share most of its chunks. Documents are brought together by the smallest hash among their chunks
(copies always meet, near copies with the probability of their chunk overlap); Spark splits parts that grow
too large, so a group of copies of any size is spread over tasks and each task encodes a chunk once.

A chunk is encoded between its first and last safe boundary: a place between a visible character and a blank,
where no token can reach across. What stands outside is a join: the end of one chunk and the beginning of the
next are encoded again as one window, which grows over chunks without a safe boundary, until both its
ends are places on which the encodings left and right agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lyceum.llm import vocabulary
from lyceum.llm.shared import together

WINDOW_DOUBLINGS = 4
CHUNK_BITS = 9  # 512 bytes on average
SMALLEST, LARGEST = 64, 8192
#: Chunks remembered per task.
MEMORY = 60_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), dtype="<u8")
_FIRST = re.compile(r"\S(?=[ \n\t])")
_LAST = re.compile(r".*\S(?=[ \n\t])", re.DOTALL)


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of UTF-8 data end; the last end is len(data). Never within a code point."""
    values = np.frombuffer(data, dtype=np.uint8)
    if len(values) <= SMALLEST:
        return [len(values)] if len(values) else []
    rolling = _GEAR[values]
    factor, width = _PRIME, 1
    with np.errstate(over="ignore"):
        for _ in range(WINDOW_DOUBLINGS):
            rolling[width:] = rolling[width:] + factor * rolling[:-width]
            factor, width = factor * factor, 2 * width
    starts = (values & 0xC0) != 0x80
    marked = np.flatnonzero((rolling[:-1] >> np.uint64(64 - CHUNK_BITS)) == 0) + 1
    marked = marked[starts[marked]]
    ends, at = [], 0
    for p in [*marked.tolist(), len(values)]:
        while p - at > LARGEST:
            at += LARGEST
            while not starts[at]:
                at -= 1
            ends.append(at)
        if p - at >= SMALLEST or p == len(values) and p > at:
            ends.append(p)
            at = p
    return ends


class ChunkCoder:
    def __init__(self, path: str):
        self.words = vocabulary.load(path)
        self.known: dict[bytes, tuple[str, bytes | None, str]] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.words.coder.encode_ordinary(text), dtype="<u4").tobytes()

    def chunk(self, data: bytes) -> tuple[str, bytes | None, str]:
        """Text before the first safe boundary, ids up to the last, text after it; ids are None where there is none."""
        key = xxhash.xxh3_128_digest(data)
        found = self.known.get(key)
        if found is None:
            text = data.decode("utf-8", "surrogatepass")
            first = _FIRST.search(text)
            if first is None:
                found = text, None, ""
            else:
                low, high = first.end(), _LAST.match(text).end()
                found = text[:low], self.ids(text[low:high]), text[high:]
            if len(self.known) >= MEMORY:
                for old in list(self.known)[: MEMORY // 2]:
                    del self.known[old]
            self.known[key] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.words.parts(text)):
            if k % 2:
                out.append(np.array([self.words.specials[part]], dtype="<u4").tobytes())
                continue
            data, at, window = part.encode("utf-8", "surrogatepass"), 0, ""
            for end in chunk_ends(data):
                head, body, tail = self.chunk(data[at:end])
                at, window = end, window + head
                if body is not None:
                    out += [self.ids(window), body]
                    window = tail
            if window:
                out.append(self.ids(window))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.words.coder.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist()).decode("utf-8", "replace")


def with_copies_together(docs: DataFrame) -> DataFrame:
    """docs (columns doc_id and text first), dealt out so that documents that share chunks tend to meet in one task."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            least = []
            for value in batch.column(1):
                data, at, low = (value.as_py() or "").encode("utf-8", "surrogatepass"), 0, (1 << 64) - 1
                for end in chunk_ends(data):
                    low, at = min(low, digest(data[at:end])), end
                least.append(low >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*names, "least chunk"])

    marked = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("least chunk", LongType())]))
    return together(marked, "`least chunk`").select(*[F.col(f"`{n}`") for n in names])


def _named(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for each row of docs, ids as little-endian unsigned 32-bit integers; a null text is empty.

    Null and repeated doc_ids come back as they are; other columns are not read. An empty table gives an empty
    result; very long texts are encoded whole.
    """
    path = path or vocabulary.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkCoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.encode(t.as_py() or "") for t in batch.column(1)], pa.binary())], ["doc_id", "ids"])

    return with_copies_together(_named(docs)).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) for each row of (doc_id, ids); null ids are empty."""
    path = path or vocabulary.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkCoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(t.as_py() or b"") for t in batch.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, carry: Sequence[str] = (), with_ids: bool = False) -> DataFrame:
    """(doc_id, columns of carry, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again, in one pass.

    with_ids adds ids, an array of integers. A null text is empty; null and repeated doc_ids come back as they
    are; an empty table gives an empty result; very long texts are encoded whole; columns that carry doesn't
    name are not read.
    """
    path = path or vocabulary.default_path()
    rows = _named(docs, carry)
    kept = [rows.schema["doc_id"], *[rows.schema[c] for c in carry]]
    made = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    made += [StructField("ids", ArrayType(IntegerType()))] if with_ids else []
    schema = StructType([*kept, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkCoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                coded = [coder.encode(value.as_py() or "") for value in batch.column(1)]
                counts = np.array([len(ids) // 4 for ids in coded], dtype=np.int64)
                of_ids = [hashlib.sha256(ids).hexdigest() for ids in coded]
                of_text = [hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest() for ids in coded]
                columns = [batch.column(0), *batch.columns[2:], pa.array(counts), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return with_copies_together(rows).mapInArrow(run, schema)
