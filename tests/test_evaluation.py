"""Answers and their evaluations, and a job from file to graph, with replies by rule."""

import json

import pytest
from pyspark.sql import functions as F

from peerlens.engine import Engine
from peerlens.functions import entities
from peerlens.operators import scores
from peerlens.plans import evaluation, patterns
from peerlens.plans.provider import Recorded, Rules
from peerlens.plans.replies import Recording
from peerlens.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    risk = "array<struct<citation_id:string,risk_id:string,name:string,description:string,why:string,source_text:string>>"
    metric = "array<struct<citation_id:string,name:string,value:string,unit:string,year:string,gaap_concept:string,xbrl_tag:string,source_url:string>>"
    own = [(f"TR{k}", f"1_risk_{k}", f"risk {k}", "some description", "why", "word " * 30) for k in range(23)]
    theirs = [(f"PR{k}", f"7_risk_{k}", f"theme {k}", "d", "w", "word " * (30 if k % 4 else 3)) for k in range(13)]
    mine = [("TM1", "debt (2024)", "10", "USD", "2024", "debt", None, None)]
    facts_ = [("PM1", "debt", "100", "USD", "2024", "debt", "Debt", "https://x/CIK0007.json"), ("PM2", "cash", "5", "USD", "2024", "cash", "Cash", "https://x/CIK0007.json")]
    schema = f"seq int, target string, peer string, target_risks {risk}, peer_risks {risk}, target_metrics {metric}, peer_metrics {metric}"
    return spark.createDataFrame([(1, "T", "P", own, theirs, mine, facts_)], schema)


def by_number():
    """YES for odd items."""
    found = F.regexp_extract_all("prompt", F.lit(r"(?m)^\[(\d+)\]"), F.lit(1))
    return Rules(F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(": "), F.when(x.cast("int") % 2 == 1, "YES").otherwise("NO"), F.lit(" - because"))), "\n"))


def test_judged_in_calls(spark, rows):
    out = evaluation.context_precision(rows, "q", by_number(), "j").collect()
    assert len(out) == 23 + 13 + 1 + 2 and sum(r.is_relevant == "true" for r in out) == 10 + 10
    assert {r.explanation for r in out} == {"because"}
    summed = evaluation.with_mean(spark.createDataFrame(out), "citation_id", "is_relevant")
    assert scores.weighted(summed, "context_precision").first().weighted == pytest.approx(20 / 39, abs=1e-6)
    checked = evaluation.target_validation(rows, by_number(), "j")
    assert checked.count() == 24 and scores.weighted(checked, "target_validation").first().weighted == pytest.approx((4 + 4 + 4 + 1) / 24)
    peers = evaluation.risk_peers(rows, by_number(), "j").collect()
    assert len(peers) == 13 and {r.relevance_explanation for r in peers if "Chunk" in r.relevance_explanation} <= {"Chunk missing", "Chunk too short"}


def test_values_and_relevancy(spark, rows):
    reported = spark.createDataFrame([("7", "us-gaap", "Debt", "USD", "2024-12-31", 101.0, 2024, "FY", "10-K", "2025-01-01")], "cik string, taxonomy string, tag string, unit string, end string, val double, fy int, fp string, form string, filed string")
    assert {(r.citation_id, r.match) for r in evaluation.num_values(rows, reported).collect()} == {("PM1", "MATCH"), ("PM2", "NOT_FOUND")}
    vector = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    said = Rules(F.lit("1. what is it\n2. what is that\n3. x\n4. and the debt of them"))
    out = evaluation.answer_relevancy("It is.", "what is it", said, vector, "j", spark.range(1)).collect()
    assert len(out) == 5 and out[0].cosine_similarity == pytest.approx(1.0)
    best = sorted((r.cosine_similarity for r in out if r.cosine_similarity is not None), reverse=True)[:3]
    assert [r.answer_relevancy_score for r in out if r.generated_question.startswith("**")] == [pytest.approx(sum(best) / 3)]


def test_faithfulness(spark, rows):
    text = "The first risk of the target is quite severe [CITE:TR1]. The second risk of it isn't known at all [CITE:XX9]."
    answers = spark.createDataFrame([("a", text)], "answer_id string, answer string")
    ids = F.regexp_extract_all("prompt", F.lit(r"CLAIM_ID: (\w+)"), F.lit(1))
    said = Rules(F.array_join(F.transform(ids, lambda x: F.concat(F.lit("CLAIM_ID: "), x, F.lit("\nUSED_SOURCE: TR1\nCORRECT_SOURCE: YES\nEXPLANATION: ok\n---"))), "\n"))
    out = {r.claim_id: r for r in evaluation.faithfulness(answers, rows, said, "j").collect()}
    assert out["C001"].is_correct_source and not out["C002"].is_correct_source and out["C002"].used_source == "?XX9"


def test_answer_is_kept(spark, tmp_path):
    risks = spark.createDataFrame([("T", "debt", "much", 1, "TR1", "1_risk_1")], "company string, name string, description string, seq int, citation_id string, risk_id string")
    g = {
        "targets": spark.createDataFrame([("T",)], "name string"),
        "competes": spark.createDataFrame([], "peer string, target string"),
        "risks": risks,
        "metrics": spark.createDataFrame([], "company string, category string, name string, seq int, citation_id string"),
    }
    said = Rules(F.when(F.col("phase") == "answer", "<think>hm</think> Debt is high [CITE:TR1].").otherwise(F.concat(F.lit("<think>"), F.lit("inside"), F.lit("</think>short"))))
    engine = Engine(spark, str(tmp_path), said)
    out = engine.answer(g, patterns.Question("T"), "How is the debt?", "j")
    assert out["answer"].first().answer == "Debt is high [CITE:TR1]." and out["reasoning"].first().reasoning == "inside"
    back = tables.evaluation_inputs(spark, f"{tmp_path}/j/answer").first()
    assert back.question == "How is the debt?" and back.answer == "Debt is high [CITE:TR1]." and json.loads(back.results)[0]["target"] == "T"
    query, found, error = engine.free(g, "which risks", "T", lambda prompt: "select nosuch" if "failed" not in prompt else "select name from graph_risks")
    assert [r.name for r in found.collect()] == ["debt"]


def test_a_job_from_file_to_graph(spark, tmp_path):
    """A whole run, first with replies by rule and then, under another job, with those that the first has recorded."""
    filing = "# PART I\n\n## Risk Factors\n\nDebt is high.\n\n## Business\n\nWe sell.\n\n## Results of Operations\n\nRevenue was 5.\n\n## Liquidity and Capital Resources\n\nCash.\n\n## Properties\n\nNone.\n\n## Item 9B. Other Information\n\nNone.\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.md").write_text(filing)
    (tmp_path / "in/g.md").write_text(filing.replace("Debt is high", "Debt is low").replace("Revenue was 5", "Revenue was 6"))
    metric = lambda v: json.dumps([{"metric": "Revenue", "value": v, "unit": "$ million", "year": "2024", "category": "Profitability", "gaap_concept": "Revenue"}, {"metric": "", "value": "1", "unit": "x", "year": "2024", "category": "y"}, {"metric": "m", "value": "n/a", "unit": "x", "year": "2024", "category": "y"}])
    risk = lambda *names: json.dumps([{"risk_name": n, "description": f"{n} is rather bad these days"} for n in names])
    peer = json.dumps([{"risk_name": "Rates", "description": "Rates may rise quite a bit", "why": "w", "organization": "", "source_index": 0}])
    industry = json.dumps([{"industry": "Steel", "sector": "Metals"}, {"industry": "Chemicals", "sector": "Materials"}, {"industry": "Unheard of", "sector": "None"}])
    phase, has = F.col("phase"), lambda w: F.col("prompt").contains(w)
    said = Rules(
        F.when(phase == "company", '<think>who?</think>"Me Corporation"')
        .when((phase == "HAS_METRIC") & has("Revenue was 5"), metric("5"))
        .when((phase == "HAS_METRIC") & has("Revenue was 6"), metric("6"))
        .when((phase == "FACES_RISK") & has("high"), risk("Debt", "Debts"))
        .when((phase == "FACES_RISK") & has("low"), risk("Liquidity", "debt "))
        .when(phase == "OPERATES_IN", industry)
        .when(phase == "OPERATES_IN choice", "2")
        .when(phase == "risk 1", '[{"idx": 2, "action": "MERGE", "merge_into": 1}]')
        .when(phase == "peer_risks", peer)
        .otherwise("[]")
    )
    hits = spark.createDataFrame([(1, "a:x", "10-K", "7", "n", "Peer Inc"), (2, "b:x", "10-K", "8", "n", "Other"), (3, "c:x", "10-K", "9", "n", "Me Corporation")], "seq int, id string, form string, cik string, adsh string, name string")
    long = " ".join(["word"] * 700)
    body = "Item 1A. Risk Factors\n\n" + "\n\n".join([long] * 8) + "\n\nItem 2. x"
    texts = spark.createDataFrame([("7", "Peer Inc", body), ("8", "Other", "nothing")], "cik string, company string, text string")
    fact = ("7", "us-gaap", "Revenues", "Revenues", "USD", "2024-12-31", 9_000_000.0, 2024, "FY", "10-K", "2025-02-01")
    reported = spark.createDataFrame([fact], "cik string, taxonomy string, tag string, label string, unit string, end string, val double, fy int, fp string, form string, filed string")
    labels = spark.createDataFrame([("Revenues", "Revenues")], "tag string, label string")
    codes = spark.createDataFrame([("steel", "3310"), ("Chemicals ", "2800"), ("gold", "1040")], "industry string, code string")
    tape = Recording(said, spark, f"{tmp_path}/tape")
    engine = Engine(spark, str(tmp_path / "jobs"), tape, codes, known=lambda c: c.where("code <> '1040'"), buckets=2)
    job = engine.create(str(tmp_path / "in/*"), 2024)
    work = engine.pipeline(lambda _: hits, lambda _: texts, lambda _: reported, labels)
    state = engine.run(job, work)
    assert state["completed_steps"] == [1, 2, 3, 4, 5] and state["main_company"] == "Me Corporation" and state["sic_codes"] == ["2800"]
    read = lambda job, name: spark.read.parquet(f"{tmp_path}/jobs/{job}/{name}").collect()
    # Both filings are read; a metric of one name and year, and a risk of one name, count once.
    assert [(r.citation_id, r.value) for r in read(job, "target_metrics")] == [("TARGET_M0001", "5")]
    assert sorted((r.citation_id, r.name) for r in read(job, "target_risks")) == [("TARGET_R0001", "Debt"), ("TARGET_R0002", "Liquidity")]
    assert [(r["name"], r.cik) for r in read(job, "peers")] == [("Peer Inc", "7")]
    assert [(r.value, r.category, r.citation_id) for r in read(job, "peer_metrics")] == [(9.0, "Profitability", "PEER_M0001")]
    assert read(job, "peer_risks") and [(r.src, r.dst) for r in read(job, "edges")] == [("Peer Inc", "Me Corporation")]
    edges = {(r.src, r.rel, r.dst) for r in engine.stored.edges.read().collect()}
    assert edges == {
        ("Me Corporation", "OPERATES_IN", "Chemicals"),
        ("Chemicals", "HAS_SIC_CODE", "2800"),
        ("Peer Inc", "COMPETES_WITH", "Me Corporation"),
        ("Peer Inc", "OPERATES_IN", "Chemicals"),
    }
    log = {(r.relation, r.stage): r.n for r in engine.log(job).collect()}
    assert log["HAS_METRIC", "pages"] == 6 and log["HAS_METRIC", "found"] == 6 and log["HAS_METRIC", "no metric"] == 2
    assert log["HAS_METRIC", "unparsed"] == 2 and log["HAS_METRIC", "parsed"] == 2 and log["HAS_METRIC", "kept"] == 1
    assert log["FACES_RISK", "parsed"] == 4 and log["FACES_RISK", "kept"] == 2 and log["OPERATES_IN", "kept"] == 1
    # The steps that ask a model, under another job, with the replies that the first has recorded.
    again = Engine(spark, str(tmp_path / "jobs"), Recorded(tape.recorded()), codes, known=lambda c: c.where("code <> '1040'"), buckets=2)
    other = again.create(str(tmp_path / "in/*"), 2024)
    again.parse(again.state(other))
    assert again.pipeline(None, None, None, labels)[2](again.state(other))["main_company"] == "Me Corporation"
    for name, key in (("metrics", "value"), ("risks", "name"), ("industries", "sic")):
        assert sorted(str(r[key]) for r in read(job, name)) == sorted(str(r[key]) for r in read(other, name))


def test_own_relation(spark, tmp_path):
    """A relation of a user, with a validator of its own."""
    (tmp_path / "f.md").write_text("# PART I\n\n## Legal Proceedings\n\nWe were sued.\n" + "".join(f"\n## Item {k}\n\nx\n" for k in range(5)))
    seen = []

    def check(rows, run):
        seen.append((run.company, rows.count()))
        return rows.where("amount <> '0'")

    kind = entities.Relation("IS_SUED", "case string, amount string", ("case",), ("legal proceedings",), lambda df, company: df.withColumns({"name": F.col("case"), "company": F.lit(company)}), check)
    entities.register(kind)
    try:
        reply = json.dumps([{"case": "A v. B", "amount": "5"}, {"case": "C v. B", "amount": "0"}, {"case": " ", "amount": "1"}])
        engine = Engine(spark, str(tmp_path / "jobs"), Rules(F.lit(reply)))
        job = engine.create(str(tmp_path / "f.md"), 2024, "B")
        engine.parse(engine.state(job))
        assert [(r.name, r.company) for r in engine.extract(engine.state(job), "IS_SUED").collect()] == [("A v. B", "B")] and seen == [("B", 2)]
    finally:
        entities._registry.pop("IS_SUED")


def test_tests_by_name(spark, tmp_path, rows):
    engine = Engine(spark, str(tmp_path), by_name())
    job = engine.create("f", 2024, "T")
    with pytest.raises(LookupError):
        engine.evaluate_job(job, "context_precision")
    with pytest.raises(ValueError):
        engine.evaluate_job(job, "none")
    tables.write_stage(rows, engine._path(job, "stages", "rows"))
    one = lambda v: spark.createDataFrame([(v,)], "value string")
    extraction = spark.createDataFrame([("which risks?", 1, "[]")], "question string, record_count long, results string")
    tables.write_answer(engine._path(job, "answer"), extraction, one("The first risk of the target is quite severe [CITE:TR1].\n"), one(""))
    got = {}
    vector = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    facts_ = spark.createDataFrame([("7", "us-gaap", "Debt", "USD", "2024-12-31", 101.0, 2024, "FY", "10-K", "2025-01-01")], "cik string, taxonomy string, tag string, unit string, end string, val double, fy int, fp string, form string, filed string")
    for test in ("context_precision", "target_validation", "risk_peers_validation", "answer_source_traceability", "answer_relevancy", "num_values", "context_recall", "overall_score"):
        out = engine.evaluate_job(job, test, vector, facts_)
        got[test] = out["weighted"].first().weighted
    assert got["context_precision"] == pytest.approx(20 / 39, abs=1e-6) and got["target_validation"] == pytest.approx(13 / 24)
    assert got["answer_source_traceability"] == 1.0 and got["num_values"] == 0.5 and got["answer_relevancy"] > 0.9
    assert got["context_recall"] == pytest.approx((got["risk_peers_validation"] + 1.0 + got["target_validation"]) / 3, abs=1e-5)
    want = 0.3 * got["context_recall"] + 0.25 * 1.0 + 0.25 * got["context_precision"] + 0.2 * got["answer_relevancy"]
    assert got["overall_score"] == pytest.approx(want, abs=1e-4)
    assert engine.ready({"targets": spark.createDataFrame([("T",)], "name string")}).first().ready
    assert [r.name for r in engine.companies({"targets": spark.createDataFrame([("T",), ("A",)], "name string")}).collect()] == ["A", "T"]


def by_name():
    """Judges of all tests: YES for odd items; the right source; four questions."""
    items = F.regexp_extract_all("prompt", F.lit(r"(?m)^\[(\d+)\]"), F.lit(1))
    odd = F.array_join(F.transform(items, lambda x: F.concat(x, F.lit(": "), F.when(x.cast("int") % 2 == 1, "YES").otherwise("NO"), F.lit(" - because"))), "\n")
    themes = F.regexp_extract_all("prompt", F.lit(r"(?m)^(\d+\.\d+) "), F.lit(1))
    pairs = F.array_join(F.transform(themes, lambda x: F.concat(x, F.lit(": YES - so"))), "\n")
    ids = F.regexp_extract_all("prompt", F.lit(r"CLAIM_ID: (\w+)"), F.lit(1))
    right = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("CLAIM_ID: "), x, F.lit("\nUSED_SOURCE: TR1\nCORRECT_SOURCE: YES\nEXPLANATION: ok\n---"))), "\n")
    return Rules(F.when(F.col("phase") == "faithfulness", right).when(F.col("phase") == "answer_relevancy", "1. which risk\n2. which risks?\n3. x\n4. why so").when(F.col("phase") == "risk_peers_validation", pairs).otherwise(odd))
