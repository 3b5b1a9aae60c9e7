"""The pipeline against its stages written out plainly."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq

from lyceum.llm import pii, toxicity

DATA = "/root/testdata/sf0.001"


def redacted(text, spans):
    out, at = [], 0
    for span in spans.split(",") if spans else []:
        kind, start, end = span.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind.upper()}]"]
        at = max(at, int(end))
    return "".join(out) + text[at:]


def mixed(docs):
    """doc_id to the number of times that it trains, and (time, doc_id, turn) in training order."""
    sizes = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    of = defaultdict(list)
    for d in docs:
        of[d["source"]].append(d["doc_id"])
    total = {s: sum(sizes[i] for i in ids) for s, ids in of.items()}
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(total.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * weight[s]
        rest -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    turns, times = {}, []
    for s, ids in of.items():
        tilt, at = (-0.5, 0.0, 0.5)[order.index(s) % 3], 0
        goal = math.floor(target[s] + 0.5)
        passes = goal // total[s] if total[s] else 0
        left = goal - passes * total[s]
        for i in sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            taken = passes * sizes[i] + max(0, min(sizes[i], left))
            left -= sizes[i]
            turns[i] = math.ceil(taken / sizes[i]) if taken else 0
            for turn in range(turns[i]):
                share = (at + turn * total[s]) / max(target[s], 1.0)
                time = share if not tilt else 2 * share / ((1 - tilt) + math.sqrt(max(0.0, (1 - tilt) ** 2 + 4 * tilt * share)))
                times.append((min(1.0, time), i, turn))
            at += sizes[i]
    return turns, sorted(times)


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    frame, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(frame, labels, toxicity.graded(labels["toxic"], labels["quality"]))
    docs = [d for d in docs if not model.thresholds or model.above(model.score(d["text"]))[0] < 0.35]
    fps = {d["doc_id"]: brute.simhash(d["text"]) for d in docs}
    groups = brute.components(list(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    docs = [d for d in docs if groups[d["doc_id"]] == d["doc_id"]]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")).collect()}
    for d in docs:
        assert set(brute.base_spans(d["text"]).split(",")) <= set(spans[d["doc_id"]].split(","))
        d["text"] = redacted(d["text"], spans[d["doc_id"]])
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    turns, order = mixed(docs)
    coded = {}
    for d in docs:
        ids = coded[d["doc_id"]] = coder.encode(d["text"], add_special_tokens=False).ids
        if turns[d["doc_id"]]:
            expected[d["doc_id"], len(ids), brute.sha(np.array(ids, dtype="<u4").tobytes()), brute.sha(coder.decode(ids, skip_special_tokens=False))] += turns[d["doc_id"]]
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == expected
    rows.sort(key=lambda r: r["position"])
    assert [r["doc_id"] for r in rows] == [i for _, i, _ in order]
    assert all(r["ids"] == coded[r["doc_id"]] for r in rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


def test_stages_on_awkward_documents(spark, tmp_path):
    """Nulls, empties, repeats, clashing columns and empty tables, through every stage in turn."""
    clash = ["row", "id", "base", "proposed", "__base", "__text", "__id", "__doc", "__dropped", "gone", "position", "turn", "part", "at", "least chunk"]
    texts = [None, "", "mail a@b.de now and then for us all to see", "mail a@b.de now and then for us all to see", "x " * 3000, "one"]
    rows = [(i, t, None, "s" if i % 2 else None, None, *["kept"] * len(clash)) for i, t in enumerate(texts)] + [(None, "none at all", "en", "s", 1, *["kept"] * len(clash))]
    rows += rows[2:3]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            docs.write.parquet(path := str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(path)
            assert docs.columns == [f.name for f in spark.createDataFrame([], schema).schema], name
            assert not data or all(r["__base"] == "kept" for r in docs.collect()), name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
        assert len(out) == (docs.count() if data else 0)
        assert all((r["ids"] == []) == (r["n_tokens"] == 0) for r in out)
    assert {r["text"] for r in docs.sparkSession.read.parquet(str(tmp_path / "0-pii_redaction")).collect() if r["doc_id"] == 2} == {"mail [EMAIL] now and then for us all to see"}


def test_positions_are_unique_and_in_order_whatever_the_files(spark, tmp_path):
    docs = spark.range(0, 130).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    docs.write.option("maxRecordsPerFile", 20).parquet(f"{tmp_path}/docs")
    found = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/docs"), DATA).select("doc_id", "position").collect()
    assert len({r["position"] for r in found}) == 130
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["position"])] == list(range(130))
