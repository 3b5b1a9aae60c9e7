"""The texts of one file of one row group are worked on by many tasks."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lyceum.plans import concepts


def test_one_row_group_is_read_by_many_tasks(spark, tmp_path):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    pq.write_table(rows, tmp_path / "documents.parquet", row_group_size=rows.num_rows)
    found = concepts._sentences(spark, str(tmp_path)).select("doc_id", F.spark_partition_id().alias("task")).distinct()
    assert found.select("task").distinct().count() >= 8
    assert found.groupBy("doc_id").count().filter("count > 1").isEmpty()
