"""Every operator query over whole small tables against a plain version of its contract."""

import hashlib
import re
from collections import defaultdict

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from lyceum.llm import queries

DATA = "/root/testdata/sf0.001"


def table(name, data=DATA):
    return pq.read_table(f"{data}/{name}.parquet").to_pylist()


def run(spark, name, data=DATA):
    return [r.asDict(recursive=True) for r in queries.QUERIES[name](spark, data).collect()]


@pytest.fixture(scope="module")
def docs():
    return table("documents")


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_op1(spark, docs, coder):
    found = {r["doc_id"]: r for r in run(spark, "op1_prefix_token_counts")}
    assert len(found) == len(docs)
    for d in docs:
        text = d["text"] or ""
        ids = coder.encode(text, add_special_tokens=False).ids
        r = found[d["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), len(ids), len(ids) > 1024)
        if len(ids) > 1024 and len(text) < 20000:
            n = r["chars_within_limit"]
            assert len(coder.encode(text[:n], add_special_tokens=False).ids) <= 1024


def vectors():
    return {r["vec_id"]: r for r in table("embeddings")}


def test_op2(spark):
    rows = vectors()
    ids = np.array(sorted(rows))
    matrix = np.array([rows[i]["embedding"] for i in ids], dtype=np.float64)
    got = defaultdict(list)
    for r in sorted(run(spark, "op2_ivfpq_search"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r)
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    hits = total = 0
    for q, found in got.items():
        scores = matrix @ matrix[list(ids).index(q)]
        best = [i for _, i in sorted((-s, i) for s, i in zip(scores, ids) if i != q)][:20]
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        for r in found:
            assert abs(r["score"] - scores[list(ids).index(r["vec_id"])]) < 1e-9
        hits, total = hits + len(set(best) & {r["vec_id"] for r in found}), total + 20
    assert hits / total >= 0.9


def test_op3(spark):
    rows = table("pages")
    first = {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        data = (r["html"] or "").encode()
        if len(data) >= 100:
            first.setdefault(data, r["page_id"])
    expected = {}
    for r in rows:
        data = (r["html"] or "").encode()
        of = first.get(data, r["page_id"])
        expected[r["page_id"]] = (len(data), hashlib.sha256(data).hexdigest(), "response" if of == r["page_id"] else "revisit", None if of == r["page_id"] else of)
    found = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in run(spark, "op3_warc_normaliser")}
    assert found == expected


def test_op4(spark, docs):
    rows = {r["doc_id"]: r for r in run(spark, "op4_mixing_curriculum")}
    sizes = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    source_of = {d["doc_id"]: d["source"] for d in docs}
    size = defaultdict(int)
    for i, s in source_of.items():
        size[s] += sizes[i]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(size.values())
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * size[s]}
        for s in full or open_:
            target[s] = 2.0 * size[s] if full else share * weight[s]
        rest -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for i, r in rows.items():
        assert r["size"] == sizes[i] and r["source_size"] == size[source_of[i]]
        assert abs(r["target"] - target[source_of[i]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source_of[i]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1


def test_op5(spark):
    labels = {r["doc_id"]: r["toxic"] for r in table("labels", "/root/testdata/sf0.01")}
    rows = run(spark, "op5_toxicity_ordinal", "/root/testdata/sf0.01")
    assert len(rows) == 1000
    right = [r["rejected"] == bool(labels[r["doc_id"]]) for r in rows if labels.get(r["doc_id"]) is not None]
    assert np.mean(right) > 0.95


def test_op6(spark, docs):
    found = {r["doc_id"]: r for r in run(spark, "op6_pii_boosted_candidates")}
    assert len(found) == len(docs)
    for d in docs:
        base = brute.base_spans(d["text"])
        r = found[d["doc_id"]]
        kinds = [s.split(":")[0] for s in base.split(",")] if base else []
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == brute.sha(base)
        assert set(base.split(",")) <= set(r["spans"].split(","))


def test_op7(spark):
    rows = vectors()
    expected = brute.vector_groups(rows.values(), 0.93)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in run(spark, "op7_projection_forest")}
    assert found == {i: (n, c, i == c) for i, (n, c) in expected.items()}


def test_op8(spark, docs, coder):
    found = {r["doc_id"]: r for r in run(spark, "op8_bpe_chunk_reuse")}
    assert len(found) == len(docs)
    for d in docs:
        ids = coder.encode(d["text"] or "", add_special_tokens=False).ids
        r = found[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == brute.sha(np.array(ids, dtype="<u4").tobytes())
        assert r["decoded_sha256"] == brute.sha(coder.decode(ids, skip_special_tokens=False))


def test_op9(spark, docs):
    fps = {d["doc_id"]: brute.simhash(d["text"]) for d in docs}
    expected = brute.components(list(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op9_simhash_multi_index")}
    assert found == {i: (f"{fps[i]:016x}", expected[i]) for i in fps}


def test_op10(spark, docs):
    """All that repeats is found, and nothing else is: by runs of 51 words, by windows, and by all pairs of lines."""
    found = defaultdict(list)
    for r in run(spark, "op10_paragraph_minhash"):
        found[r["doc_id"]].append((r["start"], r["stop"], r["kept"], r["first_doc_id"]))
    words = {d["doc_id"]: brute.words_of(d["text"]) for d in docs}
    where = {n: defaultdict(set) for n in (24, 51)}
    for i, ws in words.items():
        for n, seen in where.items():
            for k in range(len(ws) - n + 1):
                seen[tuple(w[0] for w in ws[k : k + n])].add((i, k))
    lines = [(i, *p) for i, d in ((d["doc_id"], d) for d in docs) for p in brute.paragraphs_of(d["text"])]
    near = defaultdict(set)
    holders = defaultdict(set)
    for k, line in enumerate(lines):
        for s in line[1]:
            holders[s].add(k)
    for k, (i, shingles, start, stop) in enumerate(lines):
        for other in set().union(*(holders[s] for s in shingles)) - {k}:
            common = len(shingles & lines[other][1])
            if common >= 0.8 * (len(shingles) + len(lines[other][1]) - common):
                near[i].add((start, stop, lines[other][0]))
    for i, ws in words.items():
        inside = lambda a, b, spans: any(s <= a and b <= e for s, e, *_ in spans)
        for k in range(len(ws) - 50):
            if len({d for d, _ in where[51][tuple(w[0] for w in ws[k : k + 51])]}) > 1:
                assert any(s < ws[k + 50][2] and ws[k][1] < e for s, e, *_ in found[i]), (i, k)
        for start, stop, other in near[i]:
            assert other == i or inside(start, stop, found[i]), (i, start, stop)
        for s, e, kept, first in found[i]:
            assert kept == (first == i) or first == i and not kept
            covered = set()
            for k in range(len(ws) - 23):
                if len(where[24][tuple(w[0] for w in ws[k : k + 24])]) > 1:
                    covered.update(range(ws[k][1], ws[k + 23][2]))
            for a, b, _ in near[i]:
                covered.update(range(a, b))
            for w in ws:
                if s <= w[1] and w[2] <= e:
                    assert w[1] in covered, (i, s, e, w)
