"""Concepts that a provider proposes: verified against the pages, then merged with those that the document itself names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions import text as fn
from lyceum.functions import words
from lyceum.operators import concepts as ops
from lyceum.operators.records import first_reason
from lyceum.operators.study_map import related
from lyceum.sources.shared import stored

#: Proposals of a document that are looked at, in their order: a stated limit of the feature, told as a reason.
MOST = 60


def evidence_key(text: Column) -> Column:
    """The words of a quote that count when quotes are compared."""
    return F.array_join(fn.content_tokens(F.coalesce(text, F.lit(""))), " ")


def quotes_equivalent(left: Column, right: Column) -> Column:
    """Whether two quotes are the same, or one of four words or more is a part of the other."""
    a, b = evidence_key(left), evidence_key(right)
    long = lambda x: F.size(F.split(x, " ")) >= 4
    return (a != "") & (b != "") & ((a == b) | (long(a) & F.contains(b, a)) | (long(b) & F.contains(a, b)))


def knowledge_named(name: Column, evidence: Column) -> Column:
    """The kind of knowledge that a name stands for, else that of the evidence."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[\s/\-]+", "_")
    out = fn.knowledge_type(evidence)
    for kind, names in words.KNOWLEDGE_NAMES.items():
        out = F.when(key.isin(names), kind).otherwise(out)
    return out


def _quoted(proposals: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, place, evidence: up to three quotes of each proposal that teach, share a word with its name and stand on a page (doc_id, page, hay) that it may cite, in order."""
    # Of quotes alike in their words the first counts.
    each = proposals.select("doc_id", "place", "name", "pages", F.posexplode(F.coalesce("quotes", F.array().cast("array<string>"))).alias("k", "quote"))
    each = each.withColumn("sentence", F.trim(F.regexp_replace(F.coalesce("quote", F.lit("")), r"\s+", " ")))
    each = ops.teaching_sentences(each).drop("content").withColumn("key", evidence_key(F.col("sentence"))).filter("key <> ''")
    own = F.array_distinct(fn.content_tokens(F.col("name")))
    each = each.filter((F.size(own) == 0) | (F.size(F.array_intersect(own, F.split("key", " "))) > 0))
    # Claimed pages are tried in the order in which they are claimed, and meet by their number; else all, by number.
    columns = ["doc_id", "place", "k", "sentence", "key"]
    claimed = each.filter(F.size("pages") > 0).select(*columns, F.posexplode("pages").alias("turn", "page")).join(texts, ["doc_id", "page"])
    other = each.filter(F.size("pages") == 0).select(*columns).join(texts, "doc_id").withColumn("turn", F.col("page"))
    met = claimed.select(*columns, "turn", "page", "hay").union(other.select(*columns, "turn", "page", "hay")).filter(F.contains("hay", F.col("key")))
    first = met.groupBy("doc_id", "place", "k", "sentence", "key").agg(F.min_by("page", "turn").alias("page"))
    new = F.row_number().over(Window.partitionBy("doc_id", "place", "key").orderBy("k"))
    few = first.withColumn("__n", new).filter("__n = 1")
    few = few.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", "place").orderBy("k"))).filter("__k <= 3")
    return few.groupBy("doc_id", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "page", F.col("sentence").alias("text")))), lambda e: e.dropFields("k")).alias("evidence"))


def verified(proposals: DataFrame, pages: DataFrame, taught: DataFrame) -> DataFrame:
    """doc_id, place, concept, key, slug, type, pages, evidence, fault: proposals of a provider, and why those that fail do.

    proposals: doc_id, place (order), name, type, quotes, pages (texts); pages: doc_id, page, text; taught: teaching
    sentences (doc_id, page, ord, sentence). A name of 3 to 120 characters that is no label, furniture, layout or
    bare heading, is kept with up to three of its quotes that stand on the pages it claims (on any page, if it claims
    none that exists), or else with up to three of the document's own sentences about it. Null quotes and pages
    count for nothing; rows with a null doc_id or place are dropped; places are unique in a document.
    """
    name = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", " ")), r"^[-:;,. ]+|[-:;,. ]+$", "")
    # Pages are worked out once: their words are what quotes are looked for in, their numbers what may be cited.
    texts = stored(pages.select("doc_id", "page", evidence_key(F.col("text")).alias("hay")), "pages")
    known = texts.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("__known"))
    rows = proposals.filter("doc_id is not null and place is not null").select("doc_id", "place", name.alias("name"), "type", "quotes", F.col("pages").alias("__claimed")).join(known, "doc_id", "left")
    numbers = F.transform(F.coalesce("__claimed", F.array().cast("array<string>")), lambda x: F.trim(x).try_cast("int"))
    fits = F.array_distinct(F.filter(numbers, lambda p: F.coalesce(F.array_contains("__known", p), F.lit(False))))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    rows = rows.withColumns({"pages": F.slice(fits, 1, 10), "__order": order})
    n = F.col("name")
    fault = first_reason([
        (F.col("__order") > MOST, "over the limit of a document"), ((F.length(n) <= 2) | (F.length(n) > 120), "length of name"),
        (fn.generic_label(n) | (F.size(fn.furniture(n)) > 0) | ops.layout_detail(n), "generic label or furniture"), (fn.heading_like(n) & (F.size(fn.content_tokens(n)) == 0), "heading"),
    ])
    rows = stored(rows.withColumn("fault", fault).drop("__claimed", "__known", "__order"), "proposals")
    good = rows.filter("fault is null")
    quoted = stored(_quoted(good, texts), "quoted")
    rest = good.join(quoted, ["doc_id", "place"], "left_anti")
    near = related(rest.select("doc_id", F.col("place").cast("string").alias("key"), F.col("name").alias("concept")), taught, 3)
    own = near.withColumnRenamed("place", "__k").join(taught.select("doc_id", "ord", "sentence"), ["doc_id", "ord"]).groupBy("doc_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "page", F.col("sentence").alias("text")))), lambda e: e.dropFields("__k")).alias("found"))
    rows = rows.withColumn("key", F.col("place").cast("string")).join(quoted, ["doc_id", "place"], "left").join(own, ["doc_id", "key"], "left")
    rows = rows.withColumn("evidence", F.coalesce("evidence", "found")).withColumn("fault", F.when(F.col("fault").isNull() & F.col("evidence").isNull(), "no evidence on any page").otherwise(F.col("fault")))
    kind = F.when(F.col("fault").isNull(), knowledge_named(F.col("type"), F.get("evidence", F.lit(0))["text"]))
    cited = F.when(F.col("fault").isNull(), F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["page"]))))
    return rows.select("doc_id", "place", F.col("name").alias("concept"), fn.normal(n).alias("key"), fn.slug(n).alias("slug"), kind.alias("type"), cited.alias("pages"), F.when(F.col("fault").isNull(), F.col("evidence")).alias("evidence"), "fault")


def merged(proposed: DataFrame, own: DataFrame) -> DataFrame:
    """doc_id, key, concept, type, source: the provider's verified concepts, and those of the document that it missed.

    proposed: verified(); own: concepts() of the same documents. Of both the provider's version stays, and of proposals
    with one name the first; a document's concept goes if its key or its slug is taken. A document without any
    verified proposal keeps all of its own.
    """
    first = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("place"))
    theirs = proposed.filter("fault is null").withColumn("__n", first).filter("__n = 1")
    missed = own.withColumn("slug", fn.slug(F.col("concept")))
    missed = missed.join(theirs.select("doc_id", "key"), ["doc_id", "key"], "left_anti").join(theirs.filter("slug <> ''").select("doc_id", "slug").distinct(), ["doc_id", "slug"], "left_anti")
    columns = lambda df, source: df.select("doc_id", "key", "concept", "type", F.lit(source).alias("source"))
    return columns(theirs, "provider").union(columns(missed, "document"))


def edges_kept(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges (doc_id, source, target, ...) both of whose ends, names in any spelling, are concepts (doc_id, key)."""
    keys = concepts.select("doc_id", "key").distinct()
    rows = edges.withColumns({"__s": fn.normal(F.col("source")), "__t": fn.normal(F.col("target"))})
    ends = lambda c: keys.select("doc_id", F.col("key").alias(c))
    return rows.join(ends("__s"), ["doc_id", "__s"], "left_semi").join(ends("__t"), ["doc_id", "__t"], "left_semi").select(edges.columns)
