"""What the operators of this subpackage have in common."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every word-based contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session on one machine (tests, a laptop) may name none: a temporary folder is set there. On a
    cluster a missing setting is an error, as executors don't see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lyceum-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that holds what this application cuts; sweep() removes it."""
    return f"{shared_dir(spark).rstrip('/')}/lyceum-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, through the file system that Spark uses for it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all that cut() and the archives of this application left in the shared folder.

    For the end of a job: results that haven't been written yet read from there.
    """
    remove(spark, own_dir(spark))


def cut(df: DataFrame, name: str, path: str | None = None, tidy: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This ends the lineage: a lost executor costs a read of the table, not a second run of what made it.
    Columnar and compressed, it takes less disk than a checkpoint of rows. tidy: the write's shuffle files go
    as soon as it is done, not when the driver happens to collect its garbage.
    """
    path, conf = path or fresh_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_TIDY, None)
    if tidy:
        conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            conf.unset(_TIDY) if before is None else conf.set(_TIDY, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(df: DataFrame, *columns: str) -> DataFrame:
    """Bring equal values of the columns together, letting Spark split any part that grows too large."""
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({', '.join(columns)}) */ * FROM {{df}}", df=df)


def held(docs: DataFrame, name: str = "row") -> DataFrame:
    """docs as one struct column, so that no column of theirs can clash with one of an operator's own."""
    return docs.select(F.struct("*").alias(name))


def usable_vector(v: Column) -> Column:
    """True for vectors that take part in a search: not null, finite, without nulls, not zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, good) & F.exists(v, lambda x: x != 0)
