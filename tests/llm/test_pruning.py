"""Search and forest on tables large enough to prune: planted neighbours against all products, one hot label."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lyceum.llm import ann, forest

N, DIM, K = 50_000, 32, 20


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """500 topics of 60 near vectors, groups of five with cosines around 0.93, and what is near nothing; 90 % have one label."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((N, DIM))
    x[:30_000] = np.repeat(rng.standard_normal((500, DIM)), 60, axis=0) + 0.35 * rng.standard_normal((30_000, DIM))
    x[30_000:40_000] = np.repeat(rng.standard_normal((2_000, DIM)), 5, axis=0) + 0.27 * rng.standard_normal((10_000, DIM))
    x, label = x.astype(np.float32), np.where(rng.random(N) < 0.9, 1, rng.integers(2, 6, N)).astype(np.int32)
    path = str(tmp_path_factory.mktemp("vectors") / "e.parquet")
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, N * DIM + 1, DIM), pa.int32()), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(N), "embedding": lists, "label": label}), path, row_group_size=5_000)
    return x.astype(np.float64), label, spark.read.parquet(path)


def test_search_prunes_and_finds(table):
    x, _, df = table
    index = ann.fit(x[np.random.default_rng(1).permutation(N)[: ann.SAMPLE]], N, K)
    assert len(index.centroids) > 800 and index.error < 0.8
    asked = np.arange(0, 30_000, 60)  # one of each topic
    found = {}
    for r in ann.search(df, df.filter("vec_id < 30000 and vec_id % 60 = 0"), K).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in asked:
        scores = x @ x[q]
        scores[q] = -np.inf
        assert len(found[q]) == K
        hits += len(found[q] & set(np.argsort(-scores, kind="stable")[:K].tolist()))
    assert hits >= 0.9 * K * len(asked), hits / (K * len(asked))


def test_few_cells_suffice_where_topics_are(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((800, DIM)), 50, axis=0) + 0.3 * rng.standard_normal((40_000, DIM))
    index = ann.fit(x, 40_000, K)
    assert index.probes <= 0.15 * len(index.centroids), (index.probes, len(index.centroids))


def test_forest_finds_the_links_with_few_copies(table):
    x, label, df = table
    nodes = df.select(F.col("vec_id").alias("node"), "label", F.col("embedding").alias("v"))
    sizes = forest.leaves_of(nodes, 0.93).groupBy("leaf").count().agg(F.sum("count"), F.max("count"), F.count("*")).first()
    assert sizes[0] <= 16 * N and sizes[1] <= forest.LEAF and sizes[2] > 100
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.zeros(N, dtype=int)
    for i in range(0, N, 1000):
        links[i : i + 1000] = ((y[i : i + 1000] @ y.T >= 0.93) & (label[i : i + 1000, None] == label[None, :])).sum(1) - 1
    found = np.zeros(N, dtype=int)
    for r in forest.near_duplicates(df, 0.93).collect():
        found[r["vec_id"]] = r["n_links"]
    assert links.sum() > 5_000 and (found <= links).all()
    assert found.sum() >= 0.998 * links.sum(), (found.sum(), links.sum())
