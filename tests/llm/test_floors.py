"""A shard sends back nothing below what a query has found in nearer shards."""

import numpy as np
import pyarrow as pa

from lyceum.llm import ann


def test_rows_below_the_floor_stay(spark):
    x = np.random.default_rng(3).normal(size=(600, 16))
    index = ann.fit(x, len(x), 20)
    cells = ann._nearest(x, index.centroids)
    codes = index.codes(x, cells)
    entries = pa.table({"ids": [[i] for i in range(600)], "v": x.tolist(), "cell": pa.array(cells, pa.int32()), "code": [c.tobytes() for c in codes], "off": index.left_out(x, cells, codes)})
    every = list(range(len(index.centroids)))
    scores = np.sort(x @ x[0])[::-1]
    questions = pa.table({"query_id": pa.array([-1, -2, -3], pa.int64()), "q": [x[0].tolist()] * 3, "cells": [every] * 3, "floor": pa.array([None, scores[4], 1e9], pa.float64())})
    asked, _, found = ann._look(index, entries, questions, 20)
    assert [(asked == i).sum() for i in (-1, -2, -3)] == [20, 5, 0]
    assert np.allclose(found[asked == -1], scores[:20])


def test_turns_grow_by_the_logarithm():
    assert [ann._turn(i) for i in (0, 1, 3, 4, 15, 16, 63)] == [0, 1, 1, 2, 2, 3, 3]
