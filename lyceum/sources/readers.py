"""Sources and sinks beyond the benchmark tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def database_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 16, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database, read in parallel by ranges of a numeric key where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def owned(rows: DataFrame, owner: int) -> DataFrame:
    """Row-level security: rows of others are as good as missing."""
    return rows.filter(F.col("owner_id") == owner)


def clean_text(text: Column) -> Column:
    """NUL as a blank, runs of blanks as one, three and more line ends as two, trimmed."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\x00", " "), "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(plain, r"^\s+|\s+$", "")


def trimmed_at_boundary(text: Column, limit: int) -> Column:
    """At most limit characters, cut behind the last sentence end, or else line end, if that is past the middle."""
    head = F.substring(text, 1, limit)
    cut = F.lit(None).cast("string")
    for mark in ("\n", "! ", "? ", ". "):
        last = F.length(head) - F.instr(F.reverse(head), mark[::-1]) - len(mark) + 1
        found = F.contains(head, F.lit(mark)) & (last >= limit // 2)
        cut = F.when(found, F.rtrim(F.substring(head, F.lit(1), (last + 1).cast("int")))).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.coalesce(cut, F.rtrim(head)))


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page, text, has_image of PDF files; needs the package pypdf on the executors, and says so where it lacks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            import pypdf
        except ImportError as missing:
            raise RuntimeError("reading PDF files needs the package pypdf") from missing
        for batch in batches:
            for row in batch.itertuples(index=False):
                pages = pypdf.PdfReader(io.BytesIO(row.content)).pages
                yield pd.DataFrame([(row.path, k, p.extract_text() or "", bool(p.images)) for k, p in enumerate(pages, 1)], columns=["path", "page", "text", "has_image"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string, has_image boolean")


def repaired(rows: DataFrame, arrays: dict[str, str], numbers: list[str], flags: list[str]) -> DataFrame:
    """Rows of an older schema made whole: missing arrays empty, what isn't a number null, flags false where null."""
    have = set(rows.columns)
    out = {name: F.coalesce(F.col(name), F.array().cast(kind)) if name in have else F.array().cast(kind) for name, kind in arrays.items()}
    out |= {name: F.col(name).cast("string").try_cast("double") if name in have else F.lit(None).cast("double") for name in numbers}
    out |= {name: F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in have else F.lit(False) for name in flags}
    return rows.withColumns(out)


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key wins."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__n", place).filter("__n = 1").drop("__n")


def merged(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """target with the latest change of each key in place of its row, and new keys added."""
    last = latest_per_key(changes, key, order).select(*target.columns)
    return target.join(last.select(key), key, "left_anti").unionByName(last)


def vocabulary(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed dimension table."""
    return spark.createDataFrame(rows, schema)
