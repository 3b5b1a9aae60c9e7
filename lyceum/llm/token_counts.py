"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

Within a piece that the splitting pattern yields, a BPE encoding is valid exactly if each two adjacent tokens
are: merging their joined bytes gives the two back. So the encoding of a prefix ends in the one token whose
pair with the encoding before it is valid, and count[i] = count[i - len(last[i])] + 1. Pieces that white
space separates don't affect each other; the counts of a text are the running sum of the counts of its units
(white space and what follows up to the next white space), which recur and are computed once per worker.

The table holds, for each text, the difference of the counts at successive prefixes (in code points). From it
truncation and budget questions are answered by sums, without encoding anything again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm import vocabulary

#: Units, pieces and prefixes remembered per worker; beyond it the older half is forgotten.
MEMORY = 300_000
#: Longer units and pieces are computed each time, so that memory is bounded.
LONGEST_REMEMBERED = 64

# White space as the splitting pattern sees it: without U+001C to U+001F, which Python counts in.
_UNIT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_BLANKS = re.compile(r"[^\S\x1c-\x1f]*")
_BLANKS_IN_A_ROW = re.compile(r"\s\s")
_CONTRACTIONS = {"'re", "'ve", "'ll"}


def _shrink(memory: dict) -> None:
    for old in list(memory)[: MEMORY // 2]:
        del memory[old]


class PrefixCounter:
    def __init__(self, path: str):
        self.words = vocabulary.load(path)
        self.token = {i: token for token, i in self.words.ranks.items()}
        self.units: dict[str, tuple[int, bytes]] = {}
        self.pieces: dict[str, tuple[int, bytes]] = {}
        self.ends: dict[bytes, tuple[int, int, bytes]] = {}  # prefix of a piece: number of tokens, last token, steps
        self.pairs: dict[int, bool] = {}

    def _valid(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives the two back; left is -1 at the beginning."""
        found = self.pairs.get((left + 1) << 20 | right)
        if found is None:
            if len(self.pairs) > MEMORY:
                _shrink(self.pairs)
            both = [left, right] if left >= 0 else [right]
            found = self.pairs[(left + 1) << 20 | right] = self.words.merge(b"".join([self.token[i] for i in both])) == both
        return found

    def _end(self, prefix: bytes, ends: dict[bytes, tuple[int, int, bytes]]) -> tuple[int, int, bytes]:
        """Number of tokens, last token and steps of the prefix of a piece: found by the one last token that fits."""
        found = ends.get(prefix)
        if found is None:
            rank, n = self.words.ranks.get, len(prefix)
            before = self._end(prefix[:-1], ends) if n > 1 else (0, -1, b"")
            for j in range(n - 1, max(-1, n - 1 - self.words.longest), -1):
                token = rank(prefix[j:])
                if token is not None:
                    count, left, _ = before if j == n - 1 else self._end(prefix[:j], ends) if j else (0, -1, b"")
                    if self._valid(left, token):
                        found = ends[prefix] = count + 1, token, before[2] + (count + 1 - before[0]).to_bytes(2, "little", signed=True)
                        break
        return found

    def piece(self, text: str) -> tuple[int, bytes]:
        """The number of tokens of a piece, and the differences of the counts at its prefixes."""
        found = self.pieces.get(text)
        if found is not None:
            return found
        data = text.encode("utf-8", "surrogatepass")
        short = len(data) <= LONGEST_REMEMBERED
        total, steps = self._end(data, self.ends)[::2] if short else self._long(data)
        if len(data) > len(text):  # only prefixes that end with a code point
            kept, step = array("h"), 0
            for one, following in zip(array("h", steps), [*data[1:], 0]):
                step += one
                if following & 0xC0 != 0x80:
                    kept.append(step)
                    step = 0
            steps = kept.tobytes()
        if text in _CONTRACTIONS:  # cut within, it is an apostrophe and a letter
            steps = array("h", [1, 1, total - 2]).tobytes()
        found = total, steps
        if short:
            self.pieces[text] = found
            if len(self.pieces) > MEMORY:
                _shrink(self.pieces)
            if len(self.ends) > MEMORY:
                _shrink(self.ends)
        return found

    def _long(self, data: bytes) -> tuple[int, bytes]:
        """The same recurrence for a long piece, in arrays of its own."""
        rank, longest = self.words.ranks.get, self.words.longest
        count, last = [0] * (len(data) + 1), [-1] * (len(data) + 1)
        for i in range(1, len(data) + 1):
            for j in range(i - 1, max(-1, i - 1 - longest), -1):
                token = rank(data[j:i])
                if token is not None and self._valid(last[j], token):
                    count[i], last[i] = count[j] + 1, token
                    break
        return count[-1], np.diff(np.array(count)).astype("<i2").tobytes()

    def unit(self, text: str) -> tuple[int, bytes]:
        """The same for a unit: blanks and what follows them up to the next blank."""
        found = self.units.get(text)
        if found is None:
            pieces = [self.piece(p) for p in self.words.splitter.findall(text)]
            total, steps = sum(p[0] for p in pieces), b"".join([p[1] for p in pieces])
            blanks = _BLANKS.match(text).end()
            if blanks > 1:  # a prefix that ends in blanks has all of them in one piece
                counts = counts_of(steps)
                counts[:blanks] = counts_of(self.piece(text[:blanks])[1])
                steps = np.diff(counts, prepend=0).astype("<i2").tobytes()
            found = total, steps
            if len(text) <= LONGEST_REMEMBERED:
                self.units[text] = found
                if len(self.units) > MEMORY:
                    _shrink(self.units)
        return found

    def text(self, text: str) -> tuple[int, bytes]:
        """The number of tokens of a text, and the differences of the counts at its prefixes as 16-bit integers."""
        parts = self.words.parts(text)
        if len(parts) == 1:
            if _BLANKS_IN_A_ROW.search(text):
                get, slow, found = self.units.get, self.unit, _UNIT.findall(text)
            else:  # then no prefix splits otherwise than the whole text
                get, slow, found = self.pieces.get, self.piece, self.words.splitter.findall(text)
            found = [get(u) or slow(u) for u in found]
            return sum(x[0] for x in found), b"".join([x[1] for x in found])
        total, counts = 0, [np.zeros(0, dtype=np.int64)]
        for k in range(0, len(parts), 2):  # a cut special string is ordinary text, joined to what stands before
            special = parts[k + 1] if k + 1 < len(parts) else ""
            here = np.cumsum(np.frombuffer(b"".join(self.unit(u)[1] for u in _UNIT.findall(parts[k] + special)), dtype="<i2").astype(np.int64)) + total
            total += sum(self.unit(u)[0] for u in _UNIT.findall(parts[k]))
            if special:
                total += 1
                here[-1] = total
            counts.append(here)
        return total, np.diff(np.concatenate(counts), prepend=0).astype("<i2").tobytes()


@lru_cache(maxsize=2)
def counter_of(path: str) -> PrefixCounter:
    """One counter per Python worker; what it remembers serves the tasks that follow."""
    return PrefixCounter(path)


def counts_of(steps: bytes) -> np.ndarray:
    """The token count of every prefix, from one code point on."""
    return np.cumsum(np.frombuffer(steps, dtype="<i2").astype(np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most budget tokens."""
    fitting = np.flatnonzero(counts_of(steps) <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


def prefix_table(docs: DataFrame, path: str | None = None, budgets: Sequence[int] = ()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fits (for each budget the code points of the longest prefix within it), steps.

    One row per row of docs, in one pass without a shuffle. A null text counts as empty: no bytes, no tokens.
    Null and repeated doc_ids are returned as they come; other columns are not read. steps is the table of
    prefix counts: two bytes for each code point.
    """
    path = path or vocabulary.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                n_bytes, n_tokens, fits, steps = [], [], [], []
                for value in batch.column(1):
                    text = value.as_py() or ""
                    n, s = counter.text(text)
                    n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                    n_tokens.append(n)
                    steps.append(s)
                    fits.append([len(s) // 2 if n <= b else longest_within(s, b) for b in budgets])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fits, pa.list_(pa.int64())), pa.array(steps, pa.binary())],
                    ["doc_id", "n_bytes", "n_tokens", "fits", "steps"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fits array<long>, steps binary")


def answer(table: DataFrame, budget: int | None = None, at: int | None = None) -> DataFrame:
    """Questions to a stored table: fit_chars, the longest prefix within budget; tokens_at, the count of the first `at` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit, there = [], []
            for value in batch.column(1):
                counts = counts_of(value.as_py() or b"")
                fitting = np.flatnonzero(counts <= budget) if budget is not None else []
                fit.append(None if budget is None else int(fitting[-1]) + 1 if len(fitting) else 0)
                there.append(None if at is None else int(counts[min(at, len(counts)) - 1]) if at and len(counts) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fit, pa.int64()), pa.array(there, pa.int64())], ["doc_id", "fit_chars", "tokens_at"])

    return table.select("doc_id", "steps").mapInArrow(run, "doc_id long, fit_chars long, tokens_at long")
