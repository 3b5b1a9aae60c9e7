"""Proposals meet the pages that they claim by number, and pages are worked out once."""

from lyceum.operators import provider


def test_claimed_pages_meet_by_number(spark):
    """All quotes of a document met all its pages before, which were made of its sentences twice (F2)."""
    quote = "Osmosis moves pure water across a thin membrane into salty cells."
    texts = spark.createDataFrame([("d", p, provider_key) for p, provider_key in enumerate(["nothing", "osmosis moves pure water across thin membrane salty cells", "other", "osmosis moves pure water across thin membrane salty cells"])], "doc_id string, page int, hay string")
    rows = [("d", 1, "Osmosis", [quote], [3, 1]), ("d", 2, "Osmosis", [quote], []), ("d", 3, "Osmosis", [quote], [0, 2])]
    proposals = spark.createDataFrame(rows, "doc_id string, place long, name string, quotes array<string>, pages array<int>")
    hay = provider.evidence_key
    found = provider._quoted(proposals, texts.withColumn("hay", hay(texts["hay"])))
    assert {r["place"]: [e["page"] for e in r["evidence"]] for r in found.collect()} == {1: [3], 2: [1]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan
