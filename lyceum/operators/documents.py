"""Page-structured documents: units, cleaning, terms, sentences, grounding, similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.sources.shared import stored


def units(docs: DataFrame) -> DataFrame:
    """doc_id, page, text: the parts behind [Page N] marks; a text without marks is page 1; blank parts go.

    What stands before the first mark belongs to no page.
    """
    marked = F.col("text").rlike(r"\[Page \d+\]")
    parts = F.when(marked, F.filter(F.split("text", r"(?=\[Page \d+\])"), lambda p: p.rlike(r"^\[Page \d+\]"))).otherwise(F.array("text"))
    rows = docs.select("doc_id", F.explode(parts).alias("part"))
    page = F.coalesce(F.regexp_extract("part", r"^\[Page (\d+)\]", 1).try_cast("int"), F.lit(1))
    clean = F.regexp_replace(F.regexp_replace("part", r"^\[Page \d+\]", ""), r"^\s+|\s+$", "")
    return rows.select("doc_id", page.alias("page"), clean.alias("text")).filter("text <> ''")


def lines(docs: DataFrame, lines_per_page: int | None = None) -> DataFrame:
    """doc_id, page, line_no, line; without pages of their own, so many lines make a page."""
    keep = ["doc_id"] if lines_per_page else ["doc_id", "page"]
    rows = docs.select(*keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return rows.withColumn("page", (F.floor(F.col("line_no") / lines_per_page) + 1).cast("int")) if lines_per_page else rows


def repeated_keys(rows: DataFrame, least_pages: int = 2) -> DataFrame:
    """doc_id, key: keys of lines that stand on at least two pages of a document."""
    keyed = rows.select("doc_id", "page", fn.line_key(F.col("line")).alias("key")).filter(F.length("key") >= 2)
    return keyed.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= least_pages)


def cleaned(rows: DataFrame, keys_of_cleaned: bool = False, most_words: int = 15) -> DataFrame:
    """doc_id, page, text: pages without furniture and without short lines that repeat on other pages; empty pages go.

    The keys that repeat are those of the raw lines, or, as the second variant has it, of the cleaned ones.
    """
    # A generator, as Spark would work out the cleaned line again for each filter and column behind it.
    clean = rows.select("*", F.explode(F.array(fn.clean_line(F.col("line")))).alias("clean"))
    repeated = repeated_keys(clean.select("doc_id", "page", F.col("clean").alias("line")) if keys_of_cleaned else rows)
    kept = clean.withColumn("key", fn.line_key(F.col("clean"))).filter(F.length("key") >= 2)
    marked = kept.join(repeated.select("doc_id", "key", F.lit(True).alias("again")), ["doc_id", "key"], "left")
    left = marked.filter(F.col("again").isNull() | (F.size(F.split(F.trim("clean"), r"\s+")) > most_words))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "clean"))), lambda x: x["clean"]), "\n")
    return left.groupBy("doc_id", "page").agg(text.alias("text"))


def budgeted(pages: DataFrame, budget: int) -> DataFrame:
    """doc_id, page, kept: characters each page may keep of a budget for the document.

    Each page is cut to its share (400 at least) and takes it while any of the budget is left.
    """
    one = Window.partitionBy("doc_id")
    share = F.greatest(F.lit(400), F.floor(F.lit(budget) / F.count("*").over(one)))
    rows = pages.withColumn("own", F.least(F.length("text").cast("long"), share))
    before = F.coalesce(F.sum("own").over(one.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("doc_id", "page", F.greatest(F.lit(0), F.least(F.col("own"), F.lit(budget) - before)).alias("kept"))


def browser_tokens(text: Column, stop: list[str]) -> Column:
    """Words of three letters and more, without the stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z'-]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(sorted(set(stop))))


def term_frequencies(rows: DataFrame, tokens: Column, *by: str) -> DataFrame:
    return rows.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def scored_sentences(rows: DataFrame, tokens: Column) -> DataFrame:
    """rows (doc_id, ord, sentence) with score: the mean frequency, in the document, of the sentence's tokens."""
    # Dealt by document once, as arrays; tokens are counted and added up where their document lies.
    flat = rows.select("doc_id", "ord", tokens.alias("t")).repartition("doc_id").select("doc_id", "ord", F.explode("t").alias("token")).filter("token is not null")
    tf = F.count("*").over(Window.partitionBy("doc_id", "token"))
    sums = flat.withColumn("tf", tf).groupBy("doc_id", "ord").agg(F.sum("tf").alias("sum"), F.count("*").alias("n"))
    found = rows.join(sums, ["doc_id", "ord"], "left")
    return found.withColumn("score", F.coalesce(F.col("sum") / F.col("n"), F.lit(0.0))).drop("sum", "n")


def top_sentences(rows: DataFrame, tokens: Column, k: int = 12) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord"))
    return scored_sentences(rows, tokens).withColumn("place", place).filter(F.col("place") <= k)


def key_bigrams(pages: DataFrame, tokens: Column, least: int = 2, k: int = 10) -> DataFrame:
    """doc_id, term, n, place: pairs of neighbouring tokens of a page, in capitals, most frequent first, ties by text."""
    # Dealt by document once, as arrays: counting and ranking need no other shuffle, where pairs would carry each word twice.
    row = pages.select("doc_id", tokens.alias("t")).repartition("doc_id")
    pairs = F.when(F.size("t") >= 2, F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    n = row.select("doc_id", F.explode(pairs).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))
    return n.withColumn("place", place).filter(F.col("place") <= k).withColumn("term", F.initcap("term"))


def contained_sets(small: DataFrame, large: DataFrame) -> DataFrame:
    """small_id, large_id where all tokens of the one are among the other's: (id, tokens) each.

    Equal tokens meet by an equi-join; each small set enters with its rarest token only, and the sets are
    compared whole for those few.
    """
    rows = large.select(F.col("id").alias("large_id"), F.array_distinct("tokens").alias("have"))
    words = rows.select("large_id", F.explode("have").alias("token"))
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    wanted = small.select(F.col("id").alias("small_id"), F.array_distinct("tokens").alias("need")).filter(F.size("need") > 0)
    rare = wanted.select("small_id", F.explode("need").alias("token")).join(df, "token", "left")
    rare = rare.groupBy("small_id").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"))
    near = rare.join(words, "token").select("small_id", "large_id").join(wanted, "small_id").join(rows, "large_id")
    return near.filter(F.size(F.array_except("need", "have")) == 0).select("small_id", "large_id")


#: Counters by which tokens are put in order of rarity, and bits of a set's signature; both change the work only.
COUNTERS, SIGNATURE = 1 << 20, 192


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """token, k, n, p, s0 to s2, for each of the rarest tokens of a set (k, tokens) that similar sets share one of.

    Tokens are hashes, in order of how often their counter is met; any order does, as long as it is one for all. p is
    the place in that order, n the size, s0 to s2 the bits of all tokens. What nobody else has stays at home.
    """
    hashed = sets.select("k", F.transform("tokens", lambda w: F.xxhash64(w)).alias("tokens"))
    met = hashed.select(F.explode("tokens").alias("h")).groupBy(F.col("h").bitwiseAND(COUNTERS - 1).cast("int").alias("at")).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[met["at"]] = met["n"]
    words = SIGNATURE // 64

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            h, row = np.asarray(lists.flatten()), np.repeat(np.arange(len(n)), n)
            bit = (h >> 20 & 0xFFFFF) % SIGNATURE
            signs = np.zeros((len(n), words), np.uint64)
            np.bitwise_or.at(signs, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
            often = counts[h & (COUNTERS - 1)]
            order = np.lexsort((h, often, row))
            h, often = h[order], often[order]  # row is in order already
            p = np.arange(len(h)) - (np.cumsum(n) - n)[row]
            keep = (p <= (n - np.ceil(n * threshold - 1e-9))[row]) & (often > 1)
            row = row[keep]
            columns = {"token": h[keep].astype(np.int32), "k": np.asarray(batch.column("k"))[row], "n": n[row].astype(np.int32), "p": p[keep].astype(np.int32)}
            columns |= {f"s{i}": signs[row, i].view(np.int64) for i in range(words)}
            yield pa.RecordBatch.from_pydict(columns)

    return hashed.mapInArrow(cut, "token int, k long, n int, p int, " + ", ".join(f"s{i} long" for i in range(words)))


def _near(sets: DataFrame, threshold: float) -> DataFrame:
    """x, y: pairs of sets (k, tokens) that may be similar, by bounds that no similar pair fails.

    Sizes must fit, and so must what is left behind the first token that both share, and the bits that one set has
    and the other lacks.
    """
    prefix = _prefixes(sets, threshold).repartition("token")
    other = prefix.select("token", *[F.col(c).alias(f"o_{c}") for c in prefix.columns if c != "token"])
    n, o = F.col("n"), F.col("o_n")
    need = F.ceil((n + o) * (threshold / (1 + threshold)) - 1e-9)
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{x}s{i}").bitwiseAND(F.bitwise_not(f"{y}s{i}"))) for i in range(SIGNATURE // 64)), F.lit(0))
    fits = (F.col("k") < F.col("o_k")) & (n >= o * threshold - 1e-9) & (o >= n * threshold - 1e-9) & (F.least(n - F.col("p"), o - F.col("o_p")) >= need)
    return prefix.join(other, "token").filter(fits & (lacks("", "o_") <= n - need) & (lacks("o_", "") <= o - need)).select(F.col("k").alias("x"), F.col("o_k").alias("y")).distinct()


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity for ids a < b whose token sets have at least this Jaccard similarity: (id, tokens).

    Tokens are put in order of rarity; two similar sets share a token among the first n - ceil(t n) + 1 of each,
    so only those prefixes are joined, without the sets. These meet for the few pairs that pass all bounds, each set
    as one text, which takes a third of the room of an array.
    """
    sets = rows.select("id", F.array_distinct("tokens").alias("tokens")).filter(F.size("tokens") > 0)
    sets = stored(sets.select("id", F.array_join("tokens", "\0").alias("text"), F.monotonically_increasing_id().alias("k")), "sets")
    near = stored(_near(sets.select("k", F.split("text", "\0").alias("tokens")), threshold), "near")
    wanted = near.select(F.explode(F.array("x", "y")).alias("k")).distinct()
    wanted = stored(sets.join(wanted, "k", "left_semi").select("k", "id", "text"), "wanted")
    side = lambda k: wanted.select(F.col("k").alias(k), F.struct("id", "text").alias(f"of_{k}"))
    # Tokens of a set are distinct, so what both have tells how many there are in all.
    tokens = lambda k: F.split(f"of_{k}.text", "\0")
    both = F.size(F.array_intersect(tokens("x"), tokens("y")))
    found = near.join(side("x"), "x").join(side("y"), "y").withColumn("similarity", both / (F.size(tokens("x")) + F.size(tokens("y")) - both))
    found = found.filter(F.col("similarity") >= threshold - 1e-12)
    return found.select(F.least("of_x.id", "of_y.id").alias("a"), F.greatest("of_x.id", "of_y.id").alias("b"), "similarity")


def grounded(quotes: DataFrame, pages: DataFrame, least_tokens: int = 4) -> DataFrame:
    """quote_id, doc_id, page: pages that hold a quote, as runs of content tokens, or hold it together with the next page.

    quotes (quote_id, text), pages (doc_id, page, text). Page p and page p + 1 join only if p + 1 exists, and the
    find is at p. A quote enters with its first tokens as a key that equals a run of tokens of the page.
    """
    k = least_tokens
    q = quotes.select("quote_id", fn.content_tokens(F.col("text")).alias("qt")).filter(F.size("qt") >= k)
    q = q.select("quote_id", F.array_join("qt", " ").alias("quote"), F.array_join(F.slice("qt", 1, k), " ").alias("key")).filter(F.length("quote") >= 6)
    p = pages.select("doc_id", "page", fn.content_tokens(F.col("text")).alias("t"))
    order = Window.partitionBy("doc_id").orderBy("page")
    nxt = F.when(F.lead("page").over(order) == F.col("page") + 1, F.lead("t").over(order))
    p = p.withColumn("both", F.concat("t", F.coalesce(nxt, F.array().cast("array<string>"))))
    runs = F.when(F.size("both") >= k, F.transform(F.sequence(F.lit(1), F.size("both") - k + 1), lambda i: F.array_join(F.slice("both", i, k), " ")))
    keyed = p.select("doc_id", "page", F.explode(F.array_distinct(runs)).alias("key"))  # narrow rows; texts join the few that meet
    met = keyed.join(q.select("quote_id", "key"), "key").select("quote_id", "doc_id", "page").distinct()
    found = met.join(q.select("quote_id", "quote"), "quote_id").join(p.select("doc_id", "page", F.array_join("both", " ").alias("hay")), ["doc_id", "page"])
    return found.filter(F.contains("hay", F.col("quote"))).select("quote_id", "doc_id", "page")


def first_kept(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Rows (group, ord, id, tokens) of which no earlier kept row of the group is as similar: the first of near copies stays.

    The rule isn't transitive and depends on the order, so links alone can't say it; the kept rows of a group
    are built up in order, in an array that holds only kept token sets.
    """
    lists = rows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "tokens"))).alias("rows"))
    none = F.array().cast(rows.select(F.array(F.struct("ord", "id", "tokens")).alias("x")).schema["x"].dataType)
    same = lambda a, b: (fn.jaccard(a, b) >= threshold) | ((F.size(a) == 0) & (F.size(b) == 0))
    kept = F.aggregate("rows", none, lambda acc, r: F.when(F.exists(acc, lambda k: same(k["tokens"], r["tokens"])), acc).otherwise(F.array_append(acc, r)))
    return lists.select("group", F.explode(kept).alias("k")).select("group", "k.ord", "k.id")


def closest_concepts(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """scope, id, concept, score: for each question the concept of its scope that has most of its words; null where none shares one.

    questions: (scope, id, text); concepts: (scope, ord, concept). Words are what stands between other than letters,
    digits and _, in lower case, the empty ones at the ends included; a word that a concept repeats counts again.
    Of equals the first by ord wins. They meet by scope and word; null texts have no words.
    """
    parts = lambda c: F.split(F.lower(c), r"\W+", -1)
    asked = questions.select("scope", "id", F.explode(F.array_distinct(parts(F.col("text")))).alias("word"))
    named = concepts.select("scope", "ord", "concept", F.explode(parts(F.col("concept"))).alias("word"))
    scores = asked.join(named, ["scope", "word"]).groupBy("scope", "id", "ord", "concept").agg(F.count("*").alias("score"))
    best = scores.groupBy("scope", "id").agg(F.max_by("concept", F.struct("score", -F.col("ord"))).alias("concept"), F.max("score").alias("score"))
    return questions.select("scope", "id").join(best, ["scope", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))
