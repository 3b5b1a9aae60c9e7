"""Nulls, empty and very long texts, repeated rows, empty tables, and extra columns with clashing names."""

import math

import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lyceum.llm import ann, bpe_codec, forest, mixing, passages, pii, queries, simhash, token_counts, toxicity, warc

CLASH = "a long, b long, key long, node long, component long, kind int, start int, fp long, size long, part string, at long, source_size long, target double, label int, position double, rank int, cells long, v string, __x string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
LONG = " ".join(f"word{k % 997} and{k % 89}" for k in range(40_000))
TEXTS = [None, "", " \n\t ", "one", "mail me at a.b@c.de or +49 (0) 30 1234 5678", "<|endoftext|> x <|endoftext|>", LONG, LONG + " tail", "naïve café ünïcode 中文 \U0001f600 á", "x" * 5000, "same words here for all of us to see", "same words here for all of us to see"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", None, *[None] * 19) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "no id", None, None, None, *[None] * 19), (None, None, None, None, None, *[None] * 19)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def check_ids(df):
    assert {k: len(v) for k, v in by_id(df).items()} == {**{i: 1 for i in range(len(TEXTS))}, 4: 3, None: 2}


def test_token_counts(docs):
    found = token_counts.prefix_table(docs, budgets=[3])
    check_ids(found)
    rows = by_id(found)
    assert rows[0][0]["n_tokens"] == rows[1][0]["n_tokens"] == 0
    coder = token_counts.counter_of(token_counts.vocabulary.default_path())
    for i, text in enumerate(TEXTS):
        steps = token_counts.counts_of(rows[i][0]["steps"])
        assert len(steps) == len(text or "")
        for at in {1, 2, len(steps) // 3, len(steps)} & set(range(1, min(len(steps), 400) + 1)):
            assert steps[at - 1] == coder.text(text[:at])[0]
    asked = {r["doc_id"]: r for r in token_counts.answer(found.filter("doc_id = 10"), budget=3, at=9).collect()}
    assert asked[10]["fit_chars"] == rows[10][0]["fits"][0]


def test_bpe(docs):
    found = bpe_codec.round_trip(docs)
    check_ids(found)
    encoded = bpe_codec.encode(docs)
    back = by_id(bpe_codec.decode(encoded))
    for i, text in enumerate(TEXTS):
        assert back[i][0]["text"] == (text or "")
    assert bpe_codec.round_trip(docs.limit(0)).count() == 0


def test_simhash(docs):
    found = simhash.near_duplicates(docs)
    check_ids(found)
    rows = by_id(found)
    assert rows[0][0]["fp"] == 0 and rows[2][0]["component_id"] == 0
    assert rows[10][0]["component_id"] == rows[11][0]["component_id"] == 10
    kept = by_id(simhash.keep_one_of_each(docs))
    assert 11 not in kept and 10 in kept and len(kept[4]) == 3 and len(kept[None]) == 2
    assert simhash.keep_one_of_each(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_mixing(docs):
    found = mixing.mix(docs)
    check_ids(found)
    assert all(r["taken"] <= 2 * r["size"] for r in found.collect())
    assert sorted(map(str, found.collect())) == sorted(map(str, mixing.mix(docs).collect()))
    order = mixing.in_training_order(docs)
    assert order.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == mixing.in_training_order(docs.limit(0)).count() == 0


def test_toxicity(spark, docs):
    texts = [("you filthy liar number %d of many" % i, 2) for i in range(40)] + [("a rude remark number %d here" % i, 1) for i in range(40)] + [("a calm walk number %d in parks" % i, 0) for i in range(200)]
    train = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(texts)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(train, labels, labels["toxic"])
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    scored = {r["doc_id"]: r["severity"] for r in toxicity.severities(train, model).collect()}
    means = [np.mean([scored[i] for i, (_, g) in enumerate(texts) if g == grade]) for grade in (0, 1, 2)]
    assert means[0] < 0.3 < means[1] < means[2]
    check_ids(toxicity.severities(docs, model))
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    none = toxicity.train(train, labels.limit(0), labels["toxic"])
    assert none.thresholds == [] and not any(r["rejected"] for r in toxicity.severities(docs, none).collect())


def test_held_out_toxicity(spark):
    """Fitted on half of the labels, it tells the other half apart."""
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"), labels["toxic"])
    held = toxicity.severities(docs, model).join(labels.filter("doc_id % 2 = 1 and toxic is not null"), "doc_id").collect()
    toxic = [r["rejected"] for r in held if r["toxic"]]
    clean = [r["rejected"] for r in held if not r["toxic"]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01  # from some 200 toxic rows; with thousands nearly all are found


def test_pii(docs):
    found = pii.find(docs)
    check_ids(found)
    rows = by_id(found)
    for i, text in enumerate(TEXTS):
        assert rows[i][0]["base_spans"] == brute.base_spans(text)
    clean = by_id(pii.redact(docs))
    assert clean[4][0]["text"] == "mail me at [EMAIL] or [PHONE]" and clean[0][0]["text"] is None and clean[10][0]["text"] == TEXTS[10]
    assert pii.redact(docs).columns == docs.columns
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_added_spans(spark):
    """What is added is a loose proposal that no base span covers, overlaps no other, and reaches the bar; a plain version decides alike."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        number = "".join(map(str, rng.integers(0, 10, 12)))
        rows.append((i, f"call me at +{number[:11]} or write to u{i}@x{i % 7}.org today" if i % 2 else f"call me at {number[:4]} {number[4:8]} {number[8:]} today, order {number}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.with_spans(df).select("row.doc_id", pii.F.col("row.doc_id").alias("doc"), "text", "base", "proposed").collect()
    forest = pii.train(spark.createDataFrame([(r["doc_id"], r["proposed"]) for r in spans], pii.with_spans(df).select(pii.F.col("row.doc_id").alias("doc"), "proposed").schema))
    forest.thresholds = [-100.0] * 4  # so that scores decide among what overlaps
    added = 0
    chosen = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["s"]] for r in pii.with_spans(df).select("row.doc_id", pii.select_spans(forest).alias("s")).collect()}
    for r in spans:
        base = [(s["start"], s["kind"], s["end"]) for s in r["base"]]
        kept = []
        for p in sorted(r["proposed"], key=lambda p: (p["start"], p["kind"], p["end"])):
            score = forest.score(p.asDict())
            if any(b[0] < p["end"] and p["start"] < b[2] for b in base) or score < forest.thresholds[p["kind"]]:
                continue
            if not kept or p["start"] >= kept[-1][2]:
                kept.append((p["start"], p["kind"], p["end"], score))
            elif score > kept[-1][3]:
                kept[-1] = (p["start"], p["kind"], p["end"], score)
        reach, final = 0, []
        for s in kept:
            if s[0] >= reach:
                final.append(s[:3])
            reach = max(reach, s[2])
        added += len(final)
        assert chosen[r["doc_id"]] == sorted(base + final)
    assert added > 100


def test_pii_many_spans(spark):
    """The work on a text grows with its spans, not with their square."""
    text = " ".join(f"a{k}@b{k}.com 10.0.{k % 300}.{k % 256} x" for k in range(5_000))
    found = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert found["base_spans"] == brute.base_spans(text) and found["n_email"] == 5_000


def test_pii_patterns(spark):
    """Base spans on awkward texts."""
    texts = ["a@b.c@d.e", "a@b.c,x@y.zz..", "1.2.3.4.5.6", "999.1.1.1 1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112 378282246310005", "+1 (23) 456.78-90", "+12 345678901234567", "++49 30 123456789", "é@b.c é+49301234567", "1 2 3 4 5 6 7 8 9 0 1 2", "\U0001f600 a@b.de \U0001f600 10.0.0.1", "x.@-.-", "+5 (", "0" * 19]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["base_spans"] for r in pii.find(df).collect()} == {i: brute.base_spans(t) for i, t in enumerate(texts)}


def test_passages(spark, docs):
    found = passages.repeats(docs).collect()
    assert {r["doc_id"] for r in found} >= {6, 7}
    assert not {r["doc_id"] for r in found} & {0, 1, 2, 3, 4, 10, 11, None}
    clean = by_id(passages.without_repeats(docs))
    assert clean[6][0]["text"] == LONG and clean[7][0]["text"] == "" and clean[3][0]["text"] == "one" and clean[0][0]["text"] is None
    assert passages.repeats(docs.limit(0)).count() == 0


def test_edited_paragraphs(spark):
    """Paragraphs that share no long run of words are found by their shingles; others are left alone."""
    words = [f"w{k}" for k in range(200)]
    edited = [w if k % 23 else "new" for k, w in enumerate(words[:100])]
    other = [w if k % 7 else "new" for k, w in enumerate(words[:100])]
    docs = spark.createDataFrame([(1, " ".join(words[:100])), (2, "intro\n" + " ".join(edited[1:])), (3, " ".join(other)), (4, " ".join(words[100:]))], "doc_id long, text string")
    found = {r["doc_id"]: (r["kept"], r["first_doc_id"]) for r in passages.repeats(docs, similarity=0.6).collect()}
    assert found == {1: (True, 1), 2: (False, 1)}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node long, v string, leaf long, copies long")


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (13, [2.0, 0.1, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (11, [], 1), (12, [math.inf, 1.0], 1)]
    df = vectors(spark, [(*r, None, None, None, None) for r in rows])
    found = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in forest.near_duplicates(df).collect())
    expected = {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 10: (1, 10, True), 13: (1, 10, False)}  # vectors of another length link with each other
    assert len(found) == len(rows)
    for null, i, n, c, kept in found:
        assert (n, c, kept) == ((0, None, True) if null else expected.get(i, (0, i, True)))
    hits = ann.search(df, df.filter("vec_id in (1, 6)"), k=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(hits, key=lambda r: r["rank"])] == [(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 4, 5)]
    assert forest.near_duplicates(df.limit(0)).count() == ann.search(df.limit(0), df.limit(0)).count() == 0
    assert forest.near_duplicates(df.filter("vec_id = 6")).collect()[0]["kept"]


def test_forest_large_group(spark):
    """A tight group larger than a block, with a chain hanging on it, against all pairs."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    x = np.concatenate([centre + 0.08 * rng.standard_normal((1200, 16)), rng.standard_normal((300, 16))])
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = y @ y.T >= 0.98
    np.fill_diagonal(links, False)
    found = {r["vec_id"]: r["n_links"] for r in forest.near_duplicates(df, threshold=0.98).collect()}
    assert sum(found.values()) >= 0.9999 * links.sum()
    assert all(found[i] <= n for i, n in enumerate(links.sum(1)))


def test_warc(spark):
    body = "<p>" + "b" * 200
    rows = [(1, "http://x/ä", body, None), (2, None, body, None), (3, "", None, None), (4, "u", "", None), (5, "u", "short", None), (6, "u", "short", None), (2, None, body, None), (None, "u", body, None), (7, "u\r\nEvil: 1", "a\r\n\r\nb" * 60, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    found = sorted(((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    assert len(found) == len(rows)
    assert [f for f in found if f[1] == 2] == [(False, 2, 203, "revisit", 1)] * 2
    assert (True, 0, 203, "revisit", 1) in found and (False, 3, 0, "response", None) in found
    assert warc.round_trip(df.limit(0)).count() == 0


def test_empty_tables(spark, tmp_path):
    """Every query runs on tables without rows."""
    for name in ("documents", "embeddings", "pages", "labels"):
        pq.write_table(pq.read_table(f"/root/testdata/sf0.001/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
