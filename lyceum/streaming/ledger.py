"""Streams of the ledger: awards once per key, running totals, study blocks, latest state per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lyceum.sources.readers import latest_per_key
from lyceum.sources.shared import shared_path


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; ts as a timestamp, so that it can carry a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    pattern = f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet"  # a source of streams takes a pattern where it doesn't take a file
    rows = spark.readStream.schema(schema).parquet(pattern)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that the stream has now, through a query with a checkpoint, as a table.

    Append writes files with exactly-once semantics. In complete mode each batch replaces the one before.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def awards_once(stream: DataFrame, lateness: str = "40 days") -> DataFrame:
    """Of entries with the same user, source and key the first within `lateness` counts; those without a key all do.

    A watermark bounds the state, so a repeat that comes later than that counts again: weaker than "ever".
    """
    keyed = stream.filter("key is not null").withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["user_id", "source", "key"])
    return keyed.unionByName(stream.filter("key is null").withWatermark("ts", lateness))


def daily_totals(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """day, user_id, gained, entries: tumbling days by event time."""
    day = F.window("ts", "1 day")
    found = stream.filter("amount > 0").withWatermark("ts", lateness).groupBy(day.alias("w"), "user_id").agg(F.sum("amount").alias("gained"), F.count("*").alias("entries"))
    return found.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "user_id", "gained", "entries")


def study_blocks(stream: DataFrame, minutes: int = 30) -> DataFrame:
    """user_id, seq, block: an award for each boundary that a user's running total of minutes (user_id, seq, minutes) crosses.

    The total is the state; rows of a batch are taken in order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, m in zip(rows["seq"], rows["minutes"]):
            if m > 0:
                out += [(key[0], seq, block) for block in range(total // minutes + 1, (total + m) // minutes + 1)]
                total += int(m)
        state.update((total,))
        yield pd.DataFrame(out, columns=["user_id", "seq", "block"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, seq long, block long", "total long", "append", GroupStateTimeout.NoTimeout)


def newly_read(stream: DataFrame) -> DataFrame:
    """file_id, page: pages (file_id, page) that the file hadn't seen before; the pages seen are the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        new = sorted({int(p) for b in batches for p in b["page"] if p >= 1} - seen)
        state.update((sorted(seen | set(new)),))
        yield pd.DataFrame({"file_id": [key[0]] * len(new), "page": new})

    return stream.groupBy("file_id").applyInPandasWithState(step, "file_id long, page int", "pages array<int>", "append", GroupStateTimeout.NoTimeout)


def latest_state(stream: DataFrame, key: str, order: str, write: Callable[[DataFrame], None], state: str):
    """Write-behind: of each batch only the last change of each key is handed to write. Returns the running query."""
    return stream.writeStream.foreachBatch(lambda batch, _: write(latest_per_key(batch, key, order))).option("checkpointLocation", state).trigger(availableNow=True).start()
