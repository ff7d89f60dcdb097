"""Operators against worked examples."""

import pytest
from pyspark.sql import functions as F

from peerlens.functions import entities
from peerlens.operators import bm25, claims, decisions, facts, graph, scores, sections
from peerlens.plans import patterns, qa
from peerlens.plans.provider import Live, Recorded, numbered_prompt


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_sections_and_pages(spark):
    md = "# PART I\nintro\n## Item 1. Business\nA\n<<<PAGE_BREAK>>>\n12\n<<<PAGE_BREAK>>>\nB\n## Item 1A. Risk Factors\nC\n# PART II\nD"
    out = {r.title: r for r in sections.parse(df(spark, [("d", md), ("e", "plain words"), ("f", None)], "doc string, text string")).collect()}
    pages = {t: [(p.page_number, p.content) for p in r.pages or []] for t, r in out.items()}
    assert pages["PART I"] == [] and (out["PART I"].word_count, out["PART I"].text_length) == (3, 3)
    assert pages["Item 1. Business"] == [(1, "A"), (3, "B")] and pages["Item 1A. Risk Factors"] == [(4, "C")] and pages["PART II"] == [(5, "D")]
    assert out["Item 1A. Risk Factors"].parent == out["PART I"].pos and out["PART II"].parent is None
    assert "Document" in out
    assert {r.doc for r in sections.first_pages(sections.parse(df(spark, [("d", md)], "doc string, text string")), 2).collect()} == {"d"}
    with pytest.raises(Exception, match="no company name"):
        spark.range(1).select(sections.company_name(F.lit('"x"'))).collect()


def test_bm25(spark):
    titles = ["risk factors", "item 1. business", "results of operations", "risk results risk", "liquidity"]
    corpus = df(spark, [(k, t.split()) for k, t in enumerate(titles)], "doc_id int, tokens array<string>")
    asked = df(spark, [("risk results", ["risk", "results"], 0)], "query string, tokens array<string>, ord int")
    got = {r.doc: round(r.score, 4) for r in bm25.scores(corpus, asked).collect()}
    assert got == {0: 0.3638, 2: 0.3024, 3: 0.7474}
    assert [r.doc for r in bm25.top(bm25.scores(corpus, asked), 2, 0.3).collect()] == [3, 0]
    two = df(spark, [("a", ["risk"], 0), ("b", ["risk"], 1)], "query string, tokens array<string>, ord int")
    assert [(r.query, r.doc) for r in bm25.greedy(bm25.scores(corpus, two), two, 0.0).collect()] == [("a", 3), ("b", 0)]


ENTITY = "idx int, chunk string, name string, value string, unit string, year string, category string, gaap_concept string, metric_type string"


def entity(idx, chunk="c", category="Leverage", value="1", concept="", year="2024", kind="k"):
    return (idx, chunk, f"n{idx}", value, "USD", year, category, concept, kind)


def decided(spark, *rows):
    return df(spark, [(i, a, m, "9", "EUR", None, "Coverage", "") for i, a, m in rows], decisions.SCHEMA)


def test_decisions(spark):
    six = df(spark, [entity(k) for k in range(1, 7)], ENTITY)
    made = decided(spark, (1, "KEEP", None), (2, "MERGE", 1), (3, "MERGE", 2), (4, "REMOVE", None), (6, "merge", 99))
    assert sorted(r.idx for r in decisions.apply_merges(six, made).collect()) == [1, 2, 5, 6]
    two = df(spark, [entity(1), entity(2), entity(3, "alone")], ENTITY)
    kept = decisions.within_chunk(two, decided(spark, (1, "REMOVE", None), (2, "MERGE", 1), (3, "REMOVE", None))).collect()
    assert sorted(r.idx for r in kept) == [1, 3]
    fixed = {r.idx: (r.value, r.unit) for r in decisions.within_chunk(two, decided(spark, (1, "FIX", None))).collect()}
    assert fixed == {1: ("9", "EUR"), 2: ("1", "USD"), 3: ("1", "USD")}
    same = df(spark, [entity(1, concept="Net Income", kind="income"), entity(2, concept="net income", kind="net income"), entity(3), entity(4, concept="No GAAP")], ENTITY)
    assert sorted(r.idx for r in decisions.best_of_concept(same).collect()) == [2, 3, 4]
    assert sorted(r.idx for r in decisions.gaap_mapped(same, decided(spark, (1, "REMOVE", None))).collect()) == [2, 3]
    assert {r.category for r in decisions.categories_fixed(same.where("idx = 1"), decided(spark, (1, "FIX", None))).collect()} == {"Coverage"}
    cross = df(spark, [entity(1), entity(2, category="Coverage"), entity(3, value="7")], ENTITY)
    assert sorted(r.idx for r in decisions.cross_category(cross, decided(spark, (2, "MERGE", 1), (3, "REMOVE", None))).collect()) == [1, 3]
    assert sorted(r.idx for r in decisions.per_category(cross, decided(spark, (3, "MERGE", 1), (2, "REMOVE", None))).collect()) == [1, 2]
    empty = decided(spark, (1, "KEEP", None)).limit(0)
    passes = decisions.metric_passes(six, dict.fromkeys(("1b", "1", "1c", "2a", "2b"), empty))
    assert passes.count() == 6
    parsed = decisions.parse(df(spark, [('noise [{"idx": 1, "action": "KEEP"}, {"action": "REMOVE"}, {"idx": 1, "action": "FIX"}]',), ("broken [",)], "reply string"))
    assert [(r.idx, r.action) for r in parsed.collect()] == [(1, "FIX")]


def test_batches_and_industry(spark):
    one = df(spark, [([3000, 3000, 6000, 100],), ([],)], "n array<int>").select(decisions.size_batches(F.col("n")), decisions.call_batches(F.lit(F.array(F.lit(4), F.lit(5), F.lit(3))))).collect()
    assert one[0][0] == [0, 0, 1, 2] and one[1][0] == [] and one[0][1] == [0, 0, 1]
    codes = df(spark, [("1", 3), ("2", 1), ("2", 2)], "code string, seq int")
    valid = df(spark, [("1",), ("2",)], "code string")
    pick = lambda n: decisions.chosen_industry(codes, valid, df(spark, [(n,)], "n int")).collect()[0].code
    assert pick(1) == "2" and pick(2) == "1"
    with pytest.raises(Exception, match="out of range"):
        pick(3)
    with pytest.raises(Exception, match="no valid"):
        decisions.chosen_industry(codes, valid.limit(0), df(spark, [(1,)], "n int")).collect()


def test_entities(spark):
    rows = [("Revenue", None, "$ (45.2)", "USD", "2024", "", ""), ("Rev", "C", "n/a", "", "", "", ""), ("", "", "5", "", "", "", ""), ("X", "", "1.234", None, "", "Leverage", "Org")]
    got = entities.metrics(df(spark, rows, entities.METRIC), "Acme").collect()
    assert [(r.name, r.value, r.unit, r.gaap_concept, r.organization, r.scan_fixed) for r in got] == [("Revenue (2024)", "-45.2", "USD", "Revenue", "Acme", False), ("X", "1234", "ratio", "X", "Org", True)]
    risk = [("R", "d" * 20, "w", "N/A", 0), ("R", "short", "w", "o", 0), ("", "d" * 30, "w", "o", 0)]
    assert [r.organization for r in entities.valid_peer_risks(df(spark, risk, entities.RISK), "Acme").collect()] == ["Acme"]
    assert entities.relations() == ["FACES_RISK", "HAS_METRIC", "OPERATES_IN"]
    with pytest.raises(KeyError):
        entities.relation("NONE")
    pages = df(spark, [("d", "s", 1, "text"), ("d", "s", 2, "more")], "doc string, section_title string, source_page int, content string")
    reply = '[{"risk_name": "Debt", "description": "too much"}, {"risk_name": "", "description": "x"}]'
    out = entities.extracted(pages, df(spark, [("d", 1, reply), ("d", 2, "nothing")], "doc string, source_page int, reply string"), entities.relation("FACES_RISK"), "Acme").collect()
    assert [(r.name, r.chunk_text, r.seq) for r in out] == [("Debt", "text", 1)]


def test_claims(spark):
    answer = "Acme Inc. reported $108M [CITE:TARGET_M0001] and margin fell [CITE:PEER_M0002]. It fell.\n\n**Sources:**\n- x [CITE:A]\n\nThe company has a large debt due soon [CITE:GONE]. Debt of the peer rose sharply in 2024 [CITE:R1][CITE:R2]."
    registry = df(spark, [("TARGET_M0001",), ("PEER_M0002",), ("R1",), ("R2",)], "citation_id string")
    got = claims.claims(df(spark, [("a", answer)], "answer_id string, answer string"), registry).orderBy("claim_id").collect()
    assert [(r.claim_id, r.claim_text, r.resolved_citation, r.co_citations) for r in got] == [
        ("C001", "Acme Inc. reported $108M", "TARGET_M0001", []),
        ("C002", "The company has a large debt due soon .", "?GONE", []),
        ("C003", "Debt of the peer rose sharply in 2024", "R1", ["R2"]),
        ("C004", "Debt of the peer rose sharply in 2024", "R2", ["R1"]),
    ]
    reply = "CLAIM_ID: C001\nUSED_SOURCE: TARGET_M0001\nCORRECT_SOURCE: YES\nEXPLANATION: fits: well\n---\nstray\nCLAIM_ID: C003\nUSED_SOURCE: ZZ\nCORRECT_SOURCE: NO: r2\nCLAIM_ID: C004\nCORRECT_SOURCE: FABRICATED"
    blocks = claims.attribution_blocks(df(spark, [("a", reply)], "answer_id string, reply string"), ["answer_id"], registry)
    byid = {r.claim_id: r for r in blocks.collect()}
    assert (byid["C001"].correct_source, byid["C001"].is_correct, byid["C001"].explanation) == ("TARGET_M0001", True, "fits: well")
    assert (byid["C003"].used_source, byid["C003"].correct_source, byid["C003"].is_correct) == ("?ZZ", "R2", False)
    full = {r.claim_id: (r.correct_source, r.is_correct_source) for r in claims.attributed(claims.claims(df(spark, [("a", answer)], "answer_id string, answer string"), registry), blocks, ["answer_id"]).collect()}
    assert full == {"C001": ("TARGET_M0001", True), "C002": ("ERROR", False), "C003": ("R2", False), "C004": ("FABRICATED", False)}


def test_verdicts(spark):
    reply = "1: YES - good\nnoise\n3) no — bad\n9: YES - out"
    got = claims.verdicts(df(spark, [("b", reply, 3)], "batch string, reply string, n int"), ["batch"]).orderBy("item").collect()
    assert [(r.verdict, r.explanation) for r in got] == [(True, "good"), (False, claims.UNPARSED), (False, "bad")]
    pairs = "1.1: YES — a\n<chunk>.1.2: NO b\n2.1 YES c\n3-1: NO d\n**3.2**: yes e\n4.1 maybe: NO f"
    got = claims.pair_verdicts(df(spark, [("b", pairs)], "batch string, reply string"), ["batch"]).orderBy("chunk", "theme").collect()
    assert [(r.chunk, r.theme, r.verdict, r.explanation) for r in got] == [(1, 1, True, "a"), (1, 2, False, "b"), (2, 1, True, "c"), (3, 1, False, "d"), (3, 2, True, "e"), (4, 1, False, "f")]


def test_scores(spark):
    rows = [("C1", "true", "x"), ("C2", "false", "other"), ("C3", "false", "FABRICATED"), ("C4", "false", "ERROR"), (" ", "true", "x")]
    res = df(spark, [(*r, "note") for r in rows], "claim_id string, is_correct_source string, correct_source string, explanation string")
    assert scores.weighted(res, "faithfulness").first().weighted == 0.5
    assert scores.scorecard(res, "faithfulness").count() == 4 and scores.scorecard(res, "unknown").count() == 0
    parts = [("faithfulness", 0.5), ("context_precision", 0.8), ("answer_relevancy", 0.7), ("risks_validation", 0.9), ("target_validation", 0.6)]
    out = {r.component: r for r in scores.overall(df(spark, parts, "component string, score double")).collect()}
    assert out["evidence_quality"].score == pytest.approx(0.75) and out["OVERALL"].score == pytest.approx(0.69) and out["OVERALL"].gate == "WARNING"
    summary = df(spark, [("q1", "0.5", None), ("** TOP-3 MEAN **", None, "0.77")], "generated_question string, cosine_similarity string, answer_relevancy_score string")
    assert scores.weighted(summary, "answer_relevancy").first().weighted == 0.77 and scores.scorecard(summary, "answer_relevancy").count() == 1


FACT = "cik string, taxonomy string, tag string, unit string, end string, val double, fy int, fp string, form string, filed string"


def test_facts(spark):
    f = lambda end, form="10-K", fp="FY", val=1.0, tax="us-gaap", unit="USD", fy=2024, filed="x": ("1", tax, "T", unit, end, val, fy, fp, form, filed)
    rows = df(spark, [f("2024-06-30"), f("2024-07-01"), f("2025-06-30"), f("2025-07-01"), f("2024-12-31", form="10-K/A"), f("2024-12-31", fp="Q4")], FACT)
    assert sorted(r.end for r in facts.in_fiscal_year(rows, 2024).collect()) == ["2024-07-01", "2025-06-30"]
    wanted = df(spark, [("1", "T", "2024"), ("1", "Z", "2024")], "cik string, tag string, year string")
    mix = df(spark, [f("2024-12-31", val=5.0, tax="dei"), f("2024-11-30", val=7.0), f("2024-12-31", val=8.0, unit="shares"), f("2024-12-30", val=9.0, filed="a"), f("2024-12-30", val=10.0, filed="b")], FACT)
    best = facts.ground_truth(mix, wanted)
    assert [(r.val, r.unit) for r in best.collect()] == [(10.0, "USD")]
    ours = df(spark, [("1", "T", "2024", "10.1", "USD"), ("1", "Z", "2024", "1", "USD"), ("1", "T", "2024", "20", "USD")], "cik string, tag string, year string, value string, unit string")
    assert sorted(r.match for r in facts.compare(ours, best).collect()) == ["MATCH", "MISMATCH", "NOT_FOUND"]
    ok = df(spark, [("a", 7, 4801, 2), ("b", 6, 9000, 1), ("c", 9, 4800, 3), ("d", 9, 9999, 4)], "cik string, risk_count int, words int, seq int")
    assert [r.cik for r in facts.accepted_peers(df(spark, [("a",), ("b",), ("c",)], "cik string"), ok).collect()] == ["a"]


def test_graph(spark):
    old = df(spark, [("a", 1, "x")], "name string, v int, made string")
    new = df(spark, [("a", 2, "y", 1), ("a", None, "z", 2), ("b", 3, "p", 1), ("b", 4, "q", 2)], "name string, v int, made string, seq int")
    got = {r.name: (r.v, r.made) for r in graph.upsert_nodes(old, new, ["name"], on_create=["made"]).collect()}
    assert got == {"a": (2, "x"), "b": (4, "p")}
    nodes = df(spark, [("C", "a"), ("M", "m")], "label string, key string")
    edges = df(spark, [("C", "a", "R", "M", "m", {"p": "1"}), ("C", "a", "R", "M", "gone", {})], graph.EDGES)
    assert graph.upsert_edges(edges.limit(0), edges, nodes).count() == 1 and graph.dropped_edges(edges, nodes).count() == 1
    facts_ = df(spark, [("rev", 2_500_000.0, "USD", "L", "T", 2024, "2024-12-31"), ("x", 3.0, "shares", None, "T2", None, "2023-01-01")], "metric_type string, val double, unit string, label string, tag string, fy int, end string")
    out = {r.metric_type: (r.value, r.unit, r.category, r["name"]) for r in graph.peer_metrics(facts_, df(spark, [("rev", "Leverage")], "metric_type string, category string")).collect()}
    assert out == {"rev": (2.5, "$ million", "Leverage", "L (2024)"), "x": (3.0, "shares", "Other", "T2 (2023)")}
    assert graph.replace_of_company(df(spark, [("A", 1), ("B", 2)], "company string, v int"), df(spark, [("A", 9)], "company string, v int")).count() == 2


def test_questions(spark):
    risks = df(spark, [("T", "debt load", "much debt", "w", "src", 1, "TR1"), ("T", "other", "none", "w", "s", 2, "TR2"), ("P", "debt", "d", "w", "s", 3, "PR1"), ("Q", "climate", "c", "w", "s", 4, "PR2")], "company string, name string, description string, why string, source_text string, seq int, citation_id string")
    g = {
        "targets": df(spark, [("T",)], "name string"),
        "competes": df(spark, [("P", "T"), ("Q", "T")], "peer string, target string"),
        "risks": risks.withColumn("risk_id", F.lit(None).cast("string")),
        "metrics": df(spark, [("T", "Leverage", "m", 1, "TM1", "10", "rev"), ("P", "Leverage", "m", 2, "PM1", "20", "rev")], "company string, category string, name string, seq int, citation_id string, value string, gaap_concept string"),
    }
    rows = {r.peer: r for r in patterns.risks(g, "T", ["DEBT"]).collect()}
    assert [x.citation_id for x in rows["P"].target_risks] == ["TR1"] and [x.citation_id for x in rows["P"].peer_risks] == ["PR1"] and rows["Q"].peer_risks == []
    assert patterns.risks(g, "T", ["nothing like it"]).count() == 0
    asked = patterns.ask(g, patterns.Question("T"))
    assert asked.count() == 4
    once = qa.deduplicated(asked)
    lists = {(r._strategy, r.peer): r for r in once.collect()}
    assert [len(lists["risks", p].target_risks) for p in ("P", "Q")] == [2, 0]
    cited = {r.citation_id: r for r in qa.citation_map(once).collect()}
    assert set(cited) == {"TR1", "TR2", "PR1", "PR2", "TM1", "PM1"} and cited["TR1"].role == "target"
    body = qa.context(once).first().context
    assert "source_text" not in body and "TR1" in body
    assert qa.registry(once).count() == 6 and qa.chunks(once).count() == 6
    with pytest.raises(ValueError):
        patterns.run_sql(g, "drop table x", "T")
    assert patterns.run_sql(g, "select name from graph_targets", "T").count() == 1
    assert patterns.chosen_strategies(" Metrics ") == ("metrics",) and patterns.chosen_strategies("?") == patterns.STRATEGIES
    order = qa.cited_order(df(spark, [("a", "x [CITE:B] y [CITE:A] z [CITE:B]")], "answer_id string, answer string")).orderBy("number").collect()
    assert [(r.citation_id, r.number) for r in order] == [("B", 1), ("A", 2)]


def test_providers(spark):
    prompts = df(spark, [("j", "1", 1, "p1"), ("j", "1", 2, "p2")], "job_id string, phase string, idx int, prompt string")
    kept = Recorded(df(spark, [("p1", "r1")], "prompt string, reply string")).replies(prompts)
    assert {r.idx: r.reply for r in kept.collect()} == {1: "r1", 2: None}
    assert {r.reply for r in Live(lambda p: p.upper()).replies(prompts).collect()} == {"P1", "P2"}
    out = numbered_prompt("Judge:", F.col("t"), ["g"], "i", df(spark, [("a", 2, "y"), ("a", 1, "x")], "g string, i int, t string")).first()
    assert out.prompt == "Judge:\n\n[1] x\n[2] y" and out.n == 2
