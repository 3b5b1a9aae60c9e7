"""The similarity join over whole lines against all pairs of a small table."""

import random

from lyceum.operators import documents as ops


def test_similar_pairs_are_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    rows = [(f"s{i}", rng.sample(words, rng.randrange(1, 12))) for i in range(150)]
    rows += [(f"t{i}", [*tokens[:-1], "new"]) for i, (_, tokens) in enumerate(rows[:60]) if len(tokens) > 3]
    found = {(r["a"], r["b"]) for r in ops.similar_pairs(spark.createDataFrame(rows, "id string, tokens array<string>"), 0.6).collect()}
    expected = {(a, b) for a, x in rows for b, y in rows if a < b and len({*x} & {*y}) >= 0.6 * len({*x} | {*y}) - 1e-9}
    assert found == expected and len(found) > 30


def test_few_pairs_meet_whole(spark):
    """Sets that share rare words, but not enough of them, are told apart before the sets themselves meet (F1)."""
    rng = random.Random(5)
    rare, common = [f"r{k}" for k in range(60)], [f"c{k}" for k in range(400)]
    sets = {i: {*rng.sample(rare, 4), *rng.sample(common, 16)} for i in range(300)}
    sets |= {1000 + i: {*sorted(sets[i])[:-2], "new"} for i in range(20)}
    similar = {(x, y) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) >= 0.6 * len(sets[x] | sets[y])}
    share_rare = {(x, y) for x in sets for y in sets if x < y and sets[x] & sets[y] & {*rare}}
    rows = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k long, tokens array<string>")
    near = {(r["x"], r["y"]) for r in ops._near(rows, 0.6).collect()}
    assert similar <= near and len(near) < 2 * len(similar) < len(share_rare) / 50
