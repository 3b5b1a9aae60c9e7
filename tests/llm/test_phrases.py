"""Phrase counts and scores against plain counting; the suffix array by itself."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
from lyceum.llm import phrases


def plain(docs, least, longest=4, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", " ".join(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    good = {k: a for k, a in f.items() if " " in k[1] and a >= least}
    out = {}
    for (lang, phrase), a in good.items():
        w = phrase.split(" ")
        if any(x == lang and f" {phrase} " in f" {p} " and p != phrase and 100 * b >= 80 * a for (x, p), b in good.items()):
            continue
        cuts = [(int(Fraction(2000000 * a, f[lang, " ".join(w[:k])] + f[lang, " ".join(w[k:])])), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], n[lang], score))
    return sorted((lang, i, *r[3:]) for lang, rows in out.items() for i, r in enumerate(sorted(rows)[:top], 1))


def ours(spark, docs, least, **more):
    d = spark.createDataFrame([(*x, 1) for x in docs], "lang string, text string, f int")
    return sorted(tuple(r) for r in phrases.collocations(d, least=least, **more).collect())


def test_random_texts(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "The", "cat", "sat", "é", "on", "a b", "mat"])
    docs = [(rng.choice(["en", "fr", None, "und"]), "".join(word() + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    assert ours(spark, docs, 5) == plain(docs, 5)
    assert ours(spark, docs, 3, top=7) == plain(docs, 3, top=7)
    assert ours(spark, docs, 4, longest=2) == plain(docs, 4, longest=2)


def test_shards_add_up(spark, monkeypatch):
    """Small shards give what one gives."""
    monkeypatch.setattr(phrases, "SHARD", 50)
    docs = [("en", f"alpha beta gamma delta {i % 3} alpha beta. gamma") for i in range(90)]
    found = {}
    run = phrases._counted(1, 4)
    import pyarrow as pa

    for b in run(iter([pa.RecordBatch.from_arrays([pa.array([x[0] for x in docs]), pa.array([x[1] for x in docs])], ["lang", "text"])])):
        for p, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            found[p] = found.get(p, 0) + n
    assert found["alpha beta"] == 180 and found["gamma"] == 180 and found["alpha beta gamma delta"] == 90 and "beta gamma delta alpha" not in found


def test_edges(spark):
    docs = [(None, None), ("en", ""), ("en", " \t.,"), ("und", "x y"), (None, "x y"), ("en", "é " * 3000 + "\x00 b"), ("de", "w" * 50_000 + " v")]
    assert ours(spark, docs, 1) == plain(docs, 1)
    assert ours(spark, [], 1) == []


def test_suffix_array():
    rng = np.random.default_rng(2)
    for depth in (1, 2, 3, 4, 5):
        ids = rng.integers(0, 4, 200)
        order, common = phrases.suffix_array(ids, depth)
        def key(i):
            out = []
            for x in [*ids[i : i + depth], 0]:
                if x == 0 or len(out) == depth:
                    break
                out.append(int(x))
            return out
        keys = [key(i) for i in order]
        assert keys == sorted(keys) and sorted(order) == np.flatnonzero(ids).tolist()
        for a, b, n in zip(keys, keys[1:], common[1:]):
            same = 0
            while same < min(len(a), len(b)) and a[same] == b[same]:
                same += 1
            assert n == same
