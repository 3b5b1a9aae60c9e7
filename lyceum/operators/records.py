"""Smaller rules over records: ordered unions, first failing gates, lenient parsing, sessions, retrieval."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions.study import half_even


def union_first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts; of equal keys that of the earliest part stays."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)])
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__part"))).filter("__n = 1").drop("__part", "__n")


def union_last_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """The values of the latest part, at the place where the key came first (column place)."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)])
    one = Window.partitionBy(key)
    rows = rows.withColumn("place", F.min("__part").over(one)).withColumn("__n", F.row_number().over(one.orderBy(F.desc("__part"))))
    return rows.filter("__n = 1").drop("__part", "__n")


def first_reason(gates: list[tuple[Column, str]]) -> Column:
    """The name of the first gate that fails (a condition that holds means failure); null where none does."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for failed, name in gates])


def safe_pages(raw: Column, pages: Column, most: int = 10) -> Column:
    """Texts as page numbers: what isn't one, or isn't in the document, goes; distinct, at most ten, in order met."""
    numbers = F.transform(raw, lambda x: F.trim(x).try_cast("int"))
    return F.slice(F.array_distinct(F.filter(numbers, lambda p: p.isNotNull() & (p >= 1) & (p <= pages))), 1, most)


def json_object(text: Column) -> Column:
    """The JSON object of an answer that may stand in a code fence or between other words."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def status_class(code: Column) -> Column:
    return F.when(code == 429, "rate-limit").when(code.isin(401, 403), "auth").when(code == 404, "missing").when(code.isin(408, 504), "timeout").when(code >= 500, "server").when(code >= 400, "request").otherwise("ok")


def retry_after(raw: Column) -> Column:
    """Seconds to wait, not below 0; null for what isn't a number."""
    seconds = F.trim(raw).try_cast("double")
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def allowed_upload(name: Column, size: Column, most: int = 15 << 20) -> Column:
    return F.lower(F.trim(name)).endswith(".pdf") & (size > 0) & (size <= most)


def name_stem(word: Column) -> Column:
    """Plural endings off: ies to y, es after s, x, z, ch and sh, and s but not ss."""
    return (
        F.when(word.rlike(r"^.{2,}ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike(r"(s|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike(r"^.{3,}[^s]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def completion_stamps(ops: DataFrame, total: int) -> DataFrame:
    """Marks and unmarks of lessons (student_id, course, lesson, done, seq) replayed per student and course.

    Columns: completed lessons at the end, pct (halves to even), and completed_seq: when the present run of having
    all lessons began; null while below 100 %, as falling below clears it.
    """
    lesson = Window.partitionBy("student_id", "course", "lesson").orderBy("seq")
    before = F.coalesce(F.lag("done").over(lesson), F.lit(False))
    delta = F.col("done").cast("int") - before.cast("int")
    one = Window.partitionBy("student_id", "course").orderBy("seq")
    rows = ops.withColumn("delta", delta).withColumn("n", F.sum("delta").over(one))
    full = F.col("n") >= total
    rows = rows.withColumn("opens", full & ~F.coalesce(F.lag(F.col("n") >= total).over(one), F.lit(False)))
    last = rows.groupBy("student_id", "course").agg(F.max_by("n", "seq").alias("done"), F.max(F.when(F.col("opens"), F.col("seq"))).alias("opened"))
    pct = half_even(F.col("done") / total * 100, 0)
    return last.select("student_id", "course", "done", pct.alias("pct"), F.when(pct >= 100, F.col("opened")).alias("completed_seq"))


#: Queries and vectors that a task of nearest compares, and queries at once within it.
QUERY_BLOCK, VECTOR_BLOCK, _AT_ONCE = 2_048, 8_192, 128


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, similarity, place: the k nearest by cosine within the query's own scope: (query_id, scope, q), (id, scope, v).

    Every query is compared with every vector of its scope, a block of queries with a block of vectors in a task, by a
    product of matrices; what rounding leaves in doubt is summed component by component, and k rows a query go on.
    Vectors that are null, hold nulls, or have a length of zero or beyond all measure, and vectors with another number
    of components, meet by a join.
    """
    square = lambda v: F.coalesce(_dot(F.col(v), F.col(v)), F.lit(0.0))
    told = lambda rows, v: rows.select(*[F.col(c).alias(c) for c in rows.columns], F.when(square(v).between(1e-100, 1e100), F.size(v)).otherwise(-1).alias("dim"))
    queries, vectors = told(queries.filter("query_id is not null and scope is not null"), "q"), told(vectors.filter("id is not null and scope is not null"), "v")
    sizes = lambda rows, n, block: rows.filter("dim > 0").groupBy("scope", "dim").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(n))
    blocks = sizes(queries, "q_blocks", QUERY_BLOCK).join(sizes(vectors, "v_blocks", VECTOR_BLOCK), ["scope", "dim"])
    dealt = lambda rows, key, own, other: rows.join(blocks, ["scope", "dim"]).withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
    asked = dealt(queries, "query_id", "q_block", "v_block").select("scope", "dim", "q_block", "v_block", "query_id", F.col("q").cast("array<double>").alias("q"))
    held = dealt(vectors, "id", "v_block", "q_block").select("scope", "dim", "q_block", "v_block", "id", F.col("v").cast("array<double>").alias("v"))

    def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products of rows, summed from the first component to the last as _dot does, so that equal rows give equal sums."""
        total = np.zeros(len(a))
        for i in range(a.shape[1]):
            total += a[:, i] * b[:, i]
        return total

    def compare(asking: pa.Table, entries: pa.Table) -> pa.Table:
        ids, q_ids = np.asarray(entries["id"].combine_chunks()), np.asarray(asking["query_id"].combine_chunks())
        matrix = lambda t, name: np.asarray(t[name].combine_chunks().flatten()).reshape(t.num_rows, -1)
        out: list[tuple[np.ndarray, ...]] = [(q_ids[:0], ids[:0], np.zeros(0))]
        if len(ids) and len(q_ids):
            v, q = matrix(entries, "v"), matrix(asking, "q")
            v_square, q_square = in_order(v, v), in_order(q, q)
            unit = (v / np.sqrt(v_square)[:, None]).T
            for start in range(0, len(q), _AT_ONCE):
                part = slice(start, start + _AT_ONCE)
                around = (q[part] / np.sqrt(q_square[part])[:, None]) @ unit
                around[q_ids[part, None] == ids[None, :]] = -np.inf
                last = np.partition(around, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(around), -np.inf)
                i, j = np.nonzero((around >= last[:, None] - 1e-9) & (around > -np.inf))
                i += start
                similarity = np.concatenate([np.zeros(0), *[in_order(q[i[a : a + 100_000]], v[j[a : a + 100_000]]) for a in range(0, len(i), 100_000)]]) / np.sqrt(q_square[i] * v_square[j])
                order = np.lexsort((ids[j], -similarity, i))
                i, j, similarity = i[order], j[order], similarity[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((q_ids[i[best]], ids[j[best]], similarity[best]))
        found = [np.concatenate(x) for x in zip(*out)]
        return pa.table({"query_id": pa.array(found[0]).cast(pa.int64()), "id": pa.array(found[1]).cast(pa.int64()), "similarity": pa.array(found[2], pa.float64())})

    key = ["scope", "dim", "q_block", "v_block"]
    found = asked.groupBy(key).cogroup(held.groupBy(key)).applyInArrow(compare, "query_id long, id long, similarity double")
    # The rest: odd queries with all vectors, odd vectors with the other queries, and other numbers of components.
    odd = queries.filter("dim < 0").drop("dim").join(vectors.drop("dim"), "scope")
    odd = odd.unionByName(queries.filter("dim > 0").drop("dim").join(vectors.filter("dim < 0").drop("dim"), "scope"))
    other = queries.filter("dim > 0").withColumnRenamed("dim", "own").join(vectors.filter("dim > 0").select("scope", "dim").distinct(), "scope").filter("dim <> own")
    odd = odd.unionByName(other.drop("own").join(vectors, ["scope", "dim"]).drop("dim")).filter("query_id <> id")
    similarity = _dot(F.col("q"), F.col("v")) / F.sqrt(_dot(F.col("q"), F.col("q")) * _dot(F.col("v"), F.col("v")))
    met = found.union(odd.select("query_id", "id", similarity.alias("similarity")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return met.withColumn("place", place).filter(F.col("place") <= k)
