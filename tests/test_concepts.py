"""Terms, subjects and concepts of sentences written for them; folding of names against plain versions."""

import random

from lyceum.operators import concepts as ops
from lyceum.operators import study_map
from pyspark.sql import functions as F

NAMES = {
    "Mitochondria are membrane-bound organelles that produce energy for the cell.": ("Mitochondria", ["Mitochondria"]),
    "The Golgi apparatus is defined as the organelle that modifies and packages proteins.": ("Golgi apparatus", ["Golgi apparatus"]),
    "Related rates problems use the chain rule to connect changing quantities.": ("Related rates problems", ["Related rates problems"]),
    "Foreshadowing shapes expectation, and it makes the ending feel earned by readers.": ("Foreshadowing", ["Foreshadowing"]),
    "Ionic bonds differ from covalent bonds in how electrons are shared among atoms.": ("Ionic bonds", ["Ionic bonds"]),
    "Although the speed is constant, the direction of velocity is continuously changing.": ("direction of velocity", ["direction of velocity"]),
    "In contrast, a prokaryotic cell lacks a nucleus and membrane-bound organelles.": ("prokaryotic cell", ["prokaryotic cell"]),
    "Imperialism increased friction because industrial powers competed for markets.": ("Imperialism", ["Imperialism"]),
    "The assassination of Archduke Franz Ferdinand in June 1914 triggered the war.": ("assassination of Archduke Franz Ferdinand", ["assassination of Archduke Franz Ferdinand"]),
    "The Triple Alliance bound Germany to Austria and Italy before the war.": ("Triple Alliance", ["Triple Alliance"]),
    "A significant problem is the starvation of long processes in the queue.": ("significant problem", []),
    "The greater the inertial mass of an object, the smaller the acceleration produced by a given force.": ("greater the inertial", []),
    "multilevel queue scheduling algorithm partitions the ready queue into several queues.": ("multilevel queue scheduling algorithm", []),
    "A delta refers to deposits at a river mouth, and then; Osmosis is the flow of water through a membrane.": ("delta", ["delta", "Osmosis"]),
    "Every student should revise the notes before the final exam next week.": ("student", []),
    "كلمة الخلية هي وحدة البناء الأساسية في جسم الكائنات الحية": ("", ["كلمة الخلية"]),
    "": ("", []),
    "...": ("", []),
}


def rows(spark, texts, doc=1, page=1):
    return spark.createDataFrame([(doc, page, page * 1_000_000 + i, i, x) for i, x in enumerate(texts)], "doc_id long, page int, ord long, number int, sentence string")


def test_subjects_and_terms(spark):
    found = ops.with_terms(rows(spark, [*NAMES, None])).orderBy("ord").collect()
    for r, (sentence, (subject, terms)) in zip(found, NAMES.items()):
        assert (r["subject"], [t["term"] for t in r["terms"]]) == (subject, terms), sentence
    assert (found[-1]["subject"], found[-1]["terms"]) == ("", [])
    assert found[1]["terms"][0]["type"] == "definition" and found[7]["terms"][0]["type"] == "cause_effect"


def test_sentences_keep_their_places(spark):
    docs = spark.createDataFrame([(1, "Alpha comes first here. Beta comes second here.\n\n\n\nGamma is on page two."), (2, None), (3, ""), (4, "too short.")], "doc_id long, text string")
    found = ops.sentences(docs).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["page"], r["number"], r["sentence"]) for r in found] == [(1, 1, 0, "Alpha comes first here."), (1, 1, 1, "Beta comes second here."), (1, 2, 2, "Gamma is on page two.")]
    assert found[1]["ord"] == found[0]["ord"] + 1 and found[2]["ord"] > found[1]["ord"] + 1


def test_teaching_sentences(spark):
    texts = ["Mitochondria are membrane-bound organelles that produce energy for the cell.", "Chapter 3 Cells", "Short one here.", None, "All rights reserved by the publisher of this important cell biology textbook.",
             "The red box at the margin shows membrane proteins carrying ions through channels."]
    assert [r["ord"] for r in ops.teaching_sentences(rows(spark, texts)).collect()] == [1_000_000]


def test_pronouns_carry_the_subject_one_sentence(spark):
    texts = ["The Golgi apparatus is a stack of membranes in the cell.", "It packages proteins for transport in vesicles.", "They move along the cytoskeleton to the membrane.", "Lysosomes are sacs that digest waste in the cell.", "The process needs acid enzymes to work well."]
    found = [(r["subject"], r["carried"]) for r in ops.subjects(rows(spark, texts)).orderBy("ord").collect()]
    assert [c for _, c in found] == [None, "Golgi apparatus", found[1][0] or None, None, "Lysosomes"]


def test_concepts_fold_and_support(spark):
    texts = [
        "Ionic bond is the attraction between oppositely charged ions in a crystal.",
        "Ionic bonds differ from covalent bonds in how electrons are shared among atoms.",
        "The Schlieffen Plan was a strategy of the German general staff for two fronts.",
        "The plan required rapid movement of whole armies through neutral Belgium.",
        "Cell theory is the principle that all living things consist of cells and products.",
        "Cell is the smallest unit of life that can replicate independently in nature.",
        "ionic bond strength grows with charge and falls with distance between the ions.",
    ]
    found = {r["concept"]: r for r in ops.concepts(rows(spark, texts)).collect()}
    assert {"Ionic bond", "Ionic bonds", "Schlieffen Plan"} <= set(found) and "plan" not in found
    assert {"Cell theory", "Cell"} <= set(found)
    assert [e["ord"] - 1_000_000 for e in found["Schlieffen Plan"]["evidence"]] == [2, 3]
    assert ops.concepts(rows(spark, [])).count() == 0 and ops.concepts(rows(spark, [None, ""])).count() == 0


def entries(spark, names):
    data = [(d, n.lower(), n, (i, 0), ["fact"], [(i, 0, 1, i)]) for i, (d, n) in enumerate(names)]
    return spark.createDataFrame(data, "doc_id long, key string, name string, first struct<ord:long,place:int>, types array<string>, evidence array<struct<ord:long,place:int,page:int,text:long>>")


def test_prefix_targets_by_plain_search(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["ion", "bond", "bonds", "differs", "plan", "theory", "forced", "cells"])
    names = sorted({(d, " ".join(word() for _ in range(rng.randint(1, 4)))) for d in range(40) for _ in range(6)})
    rng.shuffle(names)
    stem = {"bonds": "bond", "cells": "cell", "differs": "differ"}
    want = set()
    for d in range(40):
        own = [n for x, n in names if x == d]
        stems = {n: tuple(stem.get(w, w) for w in n.split()) for n in own}
        index = {stems[n]: n for n in own}
        heads = {n: [m for m in own if len(stems[m]) > 1 and stems[m][-1:] == stems[n]] for n in own if len(stems[n]) == 1}
        index |= {stems[n]: m[0] for n, m in heads.items() if len(m) == 1}
        for n in own:
            if len(stems[n]) == 1:
                want |= {(d, n, index[stems[n]])} if index[stems[n]] != n else set()
            for k in range(len(stems[n]) - 1, 0, -1):
                behind = n.split()[k:]
                if index.get(stems[n][:k], n) != n and any(w in ("bonds", "differs", "forced", "cells") for w in behind):
                    want.add((d, n, index[stems[n][:k]]))
                    break
    found = {tuple(r) for r in ops.prefix_targets(entries(spark, names)).collect()}
    assert found == want


def test_aliases(spark):
    names = [(1, n) for n in ("Round Robin", "Round Robin scheduling", "Priority scheduling", "Lottery scheduling", "Shortest Job First", "SJF", "cell", "cell theory", "gas", "gas model", "gas model method")]
    said = spark.createDataFrame([(1, 1, 1, 1, "Shortest Job First (SJF) is simple."), (1, 1, 2, 2, "Nothing here, known as Nobody."), (2, 1, 1, 1, "Round Robin (RR) waits.")], "doc_id long, page int, ord long, number int, sentence string")
    declared = ops.declared_aliases(said)
    assert {tuple(r) for r in declared.collect()} >= {(1, "shortest job first", "sjf"), (2, "round robin", "rr")}
    sentences = lambda text: rows(spark, [text] * len(names)).withColumn("ord", F.col("number").cast("long"))
    found = {(r["key"], r["target"]) for r in ops.alias_targets(entries(spark, names), declared, sentences("It says nothing of that.")).collect()}
    assert found == {("sjf", "shortest job first"), ("round robin", "round robin scheduling"), ("gas", "gas model method"), ("gas model", "gas model method"), ("cell", "cell theory")}
    found = {r["key"] for r in ops.alias_targets(entries(spark, names), declared, sentences("A cell is the unit of life.")).collect()}
    assert found == {"sjf", "round robin", "gas", "gas model"}


def test_study_map(spark):
    texts = [
        "Osmosis is the movement of water through a membrane driven by concentration.",
        "Osmosis leads to swelling of cells in pure water and shrinking in strong salt.",
        "It is important because plant cells depend on water pressure for support.",
        "Diffusion is the spreading of particles from crowded regions into empty regions.",
        "Turgor pressure results from osmosis and keeps plant stems and leaves upright.",
    ]
    found = study_map.study_map(rows(spark, texts))
    by = {r["concept"]: r for r in found.concepts.collect()}
    assert {"Osmosis", "Diffusion", "Turgor pressure"} <= set(by)
    o = by["Osmosis"]
    content = {r["ord"]: len(r["content"]) for r in ops.teaching_sentences(rows(spark, texts)).collect()}
    assert o["tokens"] == content[1_000_000] + content[1_000_001] + content[1_000_002]  # two of its own, and the pronoun's
    assert o["centrality"] >= 1 / 3 and o["richness"] == 1.0 and o["spread"] == 0 and by["Diffusion"]["richness"] == 0
    assert o["importance"] >= by["Diffusion"]["importance"] and o["degree"] >= 1
    assert {(r["source"], r["target"]) for r in found.relations.collect()} == {("Osmosis", "Turgor pressure")}
    names = {r["concept"] for r in study_map.leading(found.concepts).collect()}
    assert "Osmosis" in names
    empty = study_map.study_map(rows(spark, []))
    assert empty.concepts.count() == 0 and empty.relations.count() == 0
