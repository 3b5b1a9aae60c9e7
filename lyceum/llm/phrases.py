"""Phrase collocations from word-id suffix arrays.

Each task turns its texts into ids of words, a shard of them at a time, sorts the suffixes of the shard by prefix
doubling, and reads the counts of its phrases off the intervals of equal prefixes (LCP). Shards send a row per
phrase, which are merged by language and phrase. As no phrase is more frequent than its parts, words are counted
first, then pairs of words, then what is longer; what can't reach `least` ends a phrase in the next pass. Which
words and pairs may reach it is told by Bloom filters of bounded size, so a full filter costs work, never a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.llm.shared import cut
from lyceum.llm.word_arrays import between, filter_of, gram_hashes, hashes, mixed, slices, words

#: Words of a shard; a longer text is a shard of its own.
SHARD = 600_000
#: Bytes of text that are cut into words at once.
SLICE = 1 << 20
_CLASSES = between(b" \t", b".,;:!?\n\x0b\x0c\r")
_WIDE = np.uint64(0xD1342543DE82EF95)


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids that aren't 0, sorted by the `depth` ids from there on, and how many each has in common with the one before it.

    Ids behind a 0 or behind the end don't count. The ranks of prefixes of double the length come from the
    ranks of two neighbours, until they reach `depth`.
    """
    padded = np.concatenate([ids, np.zeros(2 * depth, dtype=np.int64)])
    rank, known = padded, 1
    while known < depth:
        pairs = np.where(padded[: len(rank) - known] == 0, 0, rank[:-known] * (rank.max() + 1) + rank[known:])
        rank = np.unique(pairs, return_inverse=True)[1]
        known *= 2
    order = np.argsort(rank[: len(ids)], kind="stable")
    order = order[ids[order] != 0]
    common = np.zeros(len(order), dtype=np.int64)
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for j in range(depth):
        here = padded[order + j]
        same &= (here[1:] == here[:-1]) & (here[1:] != 0)
        common[1:] += same
    return order, common


def phrase_counts(ids: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ids with 0 between pieces: (n, places, counts) of the distinct phrases of n ids, by intervals of the suffix array."""
    order, common = suffix_array(ids, most)
    padded = np.concatenate([ids, np.zeros(most, dtype=np.int64)])
    whole = np.ones(len(order), dtype=bool)
    for n in range(1, most + 1):
        whole &= padded[order + n - 1] != 0
        if n >= least:
            first = np.flatnonzero(whole & (common < n))
            # An interval ends where the next begins, or where shorter suffixes stand between.
            counts = np.add.reduceat(whole.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            yield n, order[first], counts


def _pair_key(words_: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return mixed(words_ ^ (langs * _WIDE))


def _counted(least: int, most: int, good_words=None, good_pairs=None):
    """For mapInArrow over (lang, text): lang, phrase and count of the phrases of least to most words of each shard."""

    def emit(shard: list[tuple[np.ndarray, np.ndarray, np.ndarray]], vocabulary: pa.Array, langs: list[str]) -> Iterator[pa.RecordBatch]:
        """shard: (word, lang, whether it follows the word before in one piece) of each slice; it is emptied at once."""
        word, lang, joined = (np.concatenate(x) for x in zip(*shard))
        shard.clear()
        keys, ids = np.unique(lang * np.int64(len(vocabulary) + 1) + word, return_inverse=True)
        del word, lang
        key_word, key_lang = keys % (len(vocabulary) + 1), keys // (len(vocabulary) + 1)
        h = _pair_key(hashes(vocabulary)[key_word], hashes(pa.array(langs, pa.large_string()))[key_lang])
        good = good_words.value.holds(h) if good_words else np.ones(len(keys), dtype=bool)
        joined = joined[1:]
        if good_pairs:
            joined = joined & good[ids[1:]] & good[ids[:-1]] & good_pairs.value.holds(gram_hashes(h[ids], 2))
        # A 0 after each word that isn't joined to the next, and in place of words that can't be frequent.
        at = np.arange(len(ids)) + np.concatenate([[0], np.cumsum(~joined)])
        row = np.zeros(at[-1] + 2, dtype=np.int64)
        row[at] = np.where(good[ids], ids + 1, 0)
        del at, ids, joined, h
        for n, places, counts in phrase_counts(row, least, most):
            for i in range(0, len(places), 100_000):
                own, told = places[i : i + 100_000], counts[i : i + 100_000]
                parts = [vocabulary.take(pa.array(key_word[row[own + j] - 1])) for j in range(n)]
                text = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(key_lang[row[own] - 1])), text.cast(pa.large_string()).cast(pa.string()), pa.array(told)], ["lang", "phrase", "f"])
        pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = [], 0
        vocabulary, langs = pa.array([], pa.large_binary()), {}
        for batch in batches:
            for first, rows in slices(batch.column(1), SLICE):
                found = words(batch.column(1).slice(first, rows), _CLASSES)
                if not len(found.ids):
                    continue
                if size and size + len(found.ids) > SHARD:
                    yield from emit(shard, vocabulary, list(langs))
                    shard, size, vocabulary, langs = [], 0, pa.array([], pa.large_binary()), {}
                own = [langs.setdefault(x, len(langs)) for x in batch.column(0).slice(first, rows).to_pylist()]
                both = pa.concat_arrays([vocabulary, found.vocabulary]).dictionary_encode()
                vocabulary = both.dictionary
                follows = np.concatenate([[False], found.piece[1:] == found.piece[:-1]])
                shard.append((np.asarray(both.indices, dtype=np.int32)[-len(found.vocabulary) :][found.ids], np.array(own, dtype=np.int32)[found.doc], follows))
                size += len(found.ids)
        if size:
            yield from emit(shard, vocabulary, list(langs))

    return run


def _hashed(n: int):
    """For mapInArrow over (lang, phrase): the hash that a phrase of n words has in the passes over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words(batch.column(1), _CLASSES)
            langs = hashes(batch.column(0).cast(pa.large_string()))
            h = _pair_key(hashes(found.vocabulary)[found.ids], langs[found.doc])
            h = gram_hashes(h, n)[::n] if n > 1 else h
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return run


def frequencies(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n): occurrences of words; (lang, phrase, size, f): phrases of 1 to `longest` words that occur `least` times."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    count = lambda *how: texts.mapInArrow(_counted(*how), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    told = lambda table, n: spark.sparkContext.broadcast(filter_of(table.select("lang", "phrase").mapInArrow(_hashed(n), "h long")))
    every = cut(count(1, 1), "phrases-words")
    found = [every.filter(F.col("f") >= least)]
    good_words = told(found[0], 1)
    if longest > 1:
        found.append(cut(count(2, 2, good_words).filter(F.col("f") >= least), "phrases-pairs"))
    if longest > 2:
        found.append(cut(count(3, longest, good_words, told(found[1], 2)).filter(F.col("f") >= least), "phrases-longer"))
    both = reduce(DataFrame.union, found).withColumn("size", F.size(F.split("phrase", " ")))
    return every.groupBy("lang").agg(F.sum("f").alias("n")), both


def _exact(x: Column) -> Column:
    return x.cast("decimal(28,0)")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, share: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language whose words stand together for a reason.

    docs: (lang, text); other columns aren't read. Texts are split at . , ; : ! ? and line ends into pieces, and
    those at spaces and tabs into words, A-Z in lower case; phrases don't cross pieces. A candidate is a phrase of 2
    to `longest` words that occurs a >= least times. Cut after its first k words it scores
    floor(2000000 a / (l + r)), l and r being the counts of both parts; the lowest cut counts, the first of equals.
    Candidates inside a longer candidate with at least `share` percent of their count go. Order: score, then a,
    downwards, then the phrase by its bytes. Null and empty texts have no words, null languages are `und`; repeated
    rows count as often as they stand; an empty table gives an empty result.
    """
    totals, found = frequencies(docs, least, longest)
    candidates = found.filter("size > 1").withColumnRenamed("f", "a")
    split = F.split("phrase", " ")
    piece = lambda low, n: F.array_join(F.slice(split, low, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), piece(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("part"))))
    parts = cuts.select("lang", "phrase", "a", "k", sides.alias("s")).select("lang", "phrase", "a", "k", "s.*")
    counts = found.select("lang", F.col("phrase").alias("part"), "f")
    halves = parts.join(counts, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("CAST(2000000 AS DECIMAL(8,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = halves.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(split, i, n), " "))))
    longer = candidates.filter("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("within").isNull() | (_exact(F.col("within")) * 100 < _exact(F.col("a")) * share))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
