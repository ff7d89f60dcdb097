"""From the target's metrics and the peers' filings to facts and risks."""

import json

from pyspark.sql import functions as F

from peerlens.functions import concepts
from peerlens.plans import peers
from peerlens.plans.provider import Rules

FACT = "cik string, taxonomy string, tag string, label string, unit string, end string, val double, fy int, fp string, form string, filed string"


def fact(tag, label="", cik="1", val=1.0):
    return (cik, "us-gaap", tag, label, "USD", "2024-12-31", val, 2024, "FY", "10-K", "2025-02-01")


def test_tags(spark):
    assert len({c for c, _, _ in concepts.rows()}) == 70
    metrics = spark.createDataFrame([("Net Incomes (adjusted)", ""), ("thing", "Long-Term  Debt"), ("Lease obligations", ""), ("nothing at all", "")], "metric_type string, gaap_concept string")
    labels = [("FinanceLeaseObligation", "Lease obligations, finance"), ("Other", "Other")] + [(f"Tag{k}", f"Label number{k}") for k in range(40)]
    got = peers.candidate_tags(metrics, spark.createDataFrame(labels, "tag string, label string")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.metric_type, r.ordinal)):
        by.setdefault(r.metric_type, []).append((r.source_rank, r.tag))
    assert by["thing"] == [(0, "LongTermDebt"), (0, "LongTermDebtNoncurrent")]
    assert by["Lease obligations"][0] == (2, "FinanceLeaseObligation") and "nothing at all" not in by


def test_matched_facts(spark):
    metrics = spark.createDataFrame([("total debt", "long-term debt"), ("unusual widget reserve", "")], "metric_type string, gaap_concept string")
    rows = [fact("LongTermDebtNoncurrent"), fact("WidgetReserve", "Unusual widget reserve")] + [fact(f"T{k}", f"Label word{k}") for k in range(60)]
    out = peers.matched_facts(metrics, spark.createDataFrame([("X", "Y z")], "tag string, label string"), spark.createDataFrame(rows, FACT), 2024).collect()
    assert sorted((r.metric_type, r.tag, r.match_source) for r in out) == [("total debt", "LongTermDebtNoncurrent", "global_taxonomy"), ("unusual widget reserve", "WidgetReserve", "bm25_fallback")]


def test_risks(spark, tmp_path):
    long = [" ".join(f"w{k}{j}" for j in range(35)) for k in range(3)]
    filing = "Item 1A. Risk Factors\n\n" + "\n\n".join([*long, "too short"]) + "\n\nItem 1B. None"
    texts = peers.risk_texts(spark.createDataFrame([("7", "Peer", filing)], "cik string, company string, text string"))
    row = texts.first()
    assert (row.risk_count, row.individual_risks) == (3, long)
    reply = json.dumps([{"risk_name": "A", "description": "d" * 30, "why": "w", "organization": "n/a", "source_index": 1}, {"risk_name": "B", "description": "x", "source_index": 0}, {"risk_name": "C", "description": "d" * 25, "source_index": 9}])
    out = peers.structured_risks(peers.risk_batches(texts), Rules(F.lit(reply)), "j").orderBy("citation_id").collect()
    assert [(r.risk_id, r.citation_id, r.organization, r.source_text == long[1]) for r in out] == [("7_risk_1", "PEER_R0001", "Peer", True), ("7_risk_2", "PEER_R0002", "Peer", False)]
    codes = peers.industry_codes(spark.createDataFrame([(" Steel",), ("x",)], "industry string"), spark.createDataFrame([("steel ", "3310")], "industry string, code string"))
    assert sorted(str(r.code) for r in codes.collect()) == ["3310", "None"]
    assert peers.context_recall(spark.createDataFrame([("a", 0.5), ("b", None), ("c", 1.0)], "component string, score double")).first().recall == 0.75
    assert peers.shared_prompts(spark.createDataFrame([("t", "b"), ("t", "a")], "source_text string, citation_id string")).first().citation_ids == ["a", "b"]
    risk = {"risk_id": "7_risk_1", "citation_id": "PEER_R0001", "risk_name": "A", "description": "d", "why": "w"}
    (tmp_path / "r.json").write_text(json.dumps([{"company_name": "Peer", "cik": "7", "structured_risks": [risk, {"risk_name": "no id"}]}]))
    peers.main(["--risks-json", f"{tmp_path}/r.json", "--target-company", "Target", "--graph", f"{tmp_path}/g", "--clear"])
    assert spark.read.parquet(f"{tmp_path}/g/risks").count() == 1 and spark.read.parquet(f"{tmp_path}/g/edges").first().dst == "Target"
