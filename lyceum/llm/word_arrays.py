"""Words of a column of texts as numpy arrays: which are equal, which document and piece each stands in.

Texts are read as the UTF-8 bytes that Arrow holds. What separates words is always ASCII here, so a table of 256
byte classes tells words from the rest, and the bytes of longer code points belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SEPARATOR, _WORD, _BREAK = 0, 1, 2
#: Bytes of text worked on at once, but for a longer text, which is worked on alone.
SLICE = 4 << 20
#: Multipliers of the hashes: odd, without structure.
_STEP, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def letters_and_digits() -> np.ndarray:
    """Byte classes for words of a-z, 0-9 and everything beyond ASCII."""
    classes = np.full(256, _SEPARATOR, dtype=np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        classes[low : high + 1] = _WORD
    return classes


def between(separators: bytes, breaks: bytes) -> np.ndarray:
    """Byte classes for words of everything but separators and breaks; a break ends a piece besides."""
    classes = np.full(256, _WORD, dtype=np.uint8)
    classes[list(separators)] = _SEPARATOR
    classes[list(breaks)] = _BREAK
    return classes


@dataclass
class Words:
    """The words of some texts, in order."""

    ids: np.ndarray  # place in vocabulary
    vocabulary: pa.Array  # distinct words, as bytes in lower case
    doc: np.ndarray  # row of the text, ascending
    piece: np.ndarray  # number of the piece; no two texts share one

    def per_doc(self, texts: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=texts)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first, rows) of runs of texts of `most` bytes at most, or of one text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, last - first
        first = last


def words(texts: pa.Array, classes: np.ndarray) -> Words:
    """The words of string or binary texts, A-Z in lower case; null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    low = _LOWER[data]
    kind = classes[low]
    inside = kind == _WORD
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins here
    edge[offsets] = True
    edge[-1] = True
    starts_here, ends_here = inside.copy(), inside.copy()
    starts_here[1:] &= ~inside[:-1] | edge[1:-1]
    ends_here[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    piece = doc + np.searchsorted(np.flatnonzero(kind == _BREAK), starts)  # both rise, so it rises where either does
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(low[inside]))])
    coded = packed.dictionary_encode()
    return Words(np.asarray(coded.indices, dtype=np.int64), coded.dictionary, doc, piece)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits, one to one."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some binary values."""
    values = values.cast(pa.large_binary())
    lengths = np.asarray(pc.binary_length(values), dtype=np.int64)
    if not len(values) or not lengths.sum():
        return mixed(lengths.astype(np.uint64))
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    powers = np.cumprod(np.full(lengths.max(), _MIX_A))
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
    return mixed(sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]] + lengths.astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """For hashes of words in order, a hash of each n that stand together."""
    size = max(0, len(words) - n + 1)
    found = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        found = found * _STEP + words[j : j + size]
    return mixed(found)


@dataclass
class Filter:
    """A Bloom filter of fixed size: says no only of hashes that were never entered."""

    bits: np.ndarray

    def holds(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), dtype=bool)
        mask = np.uint64(len(self.bits) * 64 - 1)
        for shift in (0, 32):
            place = (x >> np.uint64(shift)) & mask
            found &= ((self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
        return found


#: Bits of a filter: so many for each entry, but at most 2^28 (32 MB). A fuller filter lets more pass that isn't
#: in it; what uses one decides by a join or a count afterwards.
_BITS_EACH, _LEAST_BITS, _MOST_BITS = 32, 16, 28


def filter_of(entries: DataFrame) -> Filter:
    """The filter of a table of hashes (h long). Bits are set by an aggregation; at most 2^22 words reach the driver."""
    size = min(_MOST_BITS, max(_LEAST_BITS, int(entries.count() * _BITS_EACH).bit_length()))
    mask = F.lit((1 << size) - 1)
    place = entries.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("place"))
    set_bits = place.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), dtype=np.uint64)
    bits[np.asarray(set_bits["at"], dtype=np.int64)] = np.asarray(set_bits["bits"], dtype=np.int64).view(np.uint64)
    return Filter(bits)
