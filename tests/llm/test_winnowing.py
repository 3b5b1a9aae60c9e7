"""Contamination against a plain search for windows; edges of the tables."""

import hashlib
import random
import re

from lyceum.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, items, window=10):
    words = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wanted = {}
    for item, text in items:
        w = words(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if w and item is not None else 0):
            wanted.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for span, ids in wanted.items():
            for i in range(len(w) - len(span) + 1):
                if tuple(w[i : i + len(span)]) == span:
                    hit |= set(range(i, i + len(span)))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def ours(spark, docs, items, window=10):
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, row int, fp string")
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, size int")
    return sorted((tuple(r)[:6] for r in winnowing.contamination(d, i, window).collect()), key=str)


def test_random_texts(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["a", "b", "cé", "D", "e7", "f"]) for _ in range(n))
    items = [(i, some(rng.choice([3, 5, 9, 10, 11, 14]))) for i in range(30)]
    docs = [(i, f"{some(rng.randint(0, 30))}, {rng.choice(items)[1].upper() if i % 3 else ''}! {some(rng.randint(0, 12))}") for i in range(60)]
    assert ours(spark, docs, items) == plain(docs, items)


def test_every_shared_window_is_found(spark):
    """No shared span of ten words is missed, wherever it stands."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(20)]
    docs = []
    for k in range(200):
        w = rng.choice(items)[1].split()
        n, at = rng.choice([9, 10, 11, 25]), rng.randint(0, 15)
        docs.append((k, " ".join([*(word() for _ in range(rng.randint(0, 20))), *w[at : at + n], *(word() for _ in range(rng.randint(0, 20)))])))
    assert ours(spark, docs, items) == plain(docs, items)


def test_nulls_repeats_and_short_items(spark):
    same = "one two three four five six seven eight nine ten eleven"
    items = [(1, same), (1, same), (2, same), (None, "lone word"), (3, None), (4, ""), (5, "..."), (10, "Tiny"), (7, same + " twelve")]
    docs = [(1, same), (1, same), (1, "tiny"), (None, "TINY, tiny"), (4, None), (5, ""), (6, "lone word"), (7, ("x " * 5000) + same + " y" * 5000)]
    assert ours(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert ours(spark, [], [(1, "a b")]) == []
    assert ours(spark, [(1, "a b")], []) == plain([(1, "a b")], [])


def test_contaminated_documents_go(spark):
    d = spark.createDataFrame([(1, "a b c", "k"), (2, "x", "k"), (None, "a b", "k"), (2, "y", "k"), (None, "z", "k")], "doc_id long, text string, key string")
    i = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in winnowing.without_contaminated(d, i).collect()) == [(2, "x"), (2, "y")]
