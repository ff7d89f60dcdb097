"""Steps whose work or memory must not grow faster than their input."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from peerlens import answer_queries, source_queries
from peerlens.operators import batches, decisions, graph
from peerlens.plans import evaluation, peers, provider, qa, replies
from peerlens.streaming import jobs


def test_context_is_a_row_for_each_row(spark):
    """no single row holds them all, the first are found by their order, and the lines are what the text has."""
    rows = spark.createDataFrame([(k, "T", f"P{k}", "secret", "x" * 500) for k in range(30, 0, -1)], "seq int, target string, peer string, source_text string, note string")
    lines = [json.loads(r["line"]) for r in qa.context_lines(rows, most=12).orderBy("seq").collect()]
    assert [x["seq"] for x in lines] == list(range(1, 13)) and "source_text" not in lines[0]["row"] and len(lines[0]["row"]["note"]) < 500
    assert json.loads(qa.context(rows, most=12).first()["context"]) == lines
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (0, "d")], "seq int, peer string")
    assert qa.context_lines(twice, most=3).count() == 3


def test_calls_of_a_large_group(spark):
    """items are rows, not one array."""
    sizes = [(7 * k) % 23 for k in range(400)]
    rows = spark.createDataFrame([("g", k, n) for k, n in enumerate(sizes)] + [("h", 0, 3)], "g string, k int, n int")
    got = sorted((r["item"], r["start"], r["n"], r["call"]) for r in decisions.sliced_calls(rows, ["g"], ["k"], "n").where("g = 'g'").collect())
    cut = [(k, s, min(10, n - s)) for k, n in enumerate(sizes) for s in range(0, n, 10)]
    calls = batches.fold([c[2] for c in cut], batches.by_call()[0])[0]
    assert got == [(*c, call) for c, call in zip(cut, calls, strict=True)]


def test_an_unknown_citation_stays_unknown(spark, tmp_path):
    """also where there is a supplier of that number."""
    spark.createDataFrame([(1, "One", 3), (9999, "Last", 4)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    said = {r["resolved_citation"] for r in answer_queries.claims_numbered(spark, str(tmp_path)).where("raw_citation = 'S9999'").collect()}
    assert said == {"?S9999"}


def test_numbers_of_equal_themes_do_not_depend_on_the_partitions(spark):
    """rows that share citation and theme are told apart by their company."""
    rows = [("X1", f"P{k}", "1", "theme", "one text", "j") for k in range(25)]
    schema = "citation_id string, company string, cik string, risk_theme string, chunk_text string, job_id string"
    one = lambda x, n: sorted((r["company"], r["call"], r["chunk"], r["theme"]) for r in evaluation.risk_calls(spark.createDataFrame(x, schema).repartition(n)).collect())
    assert one(rows, 1) == one(rows[::-1], 3)


@pytest.mark.parametrize("n, least, most", [(100, 8, 8), (100_000, 90, 100)])
def test_files_become_more_not_larger(spark, n, least, most):
    """F5, F8, F11."""
    sizes = [r["count"] for r in spark.range(n).groupBy(source_queries.dealt_to(F.col("id"), n, 1000, 8).alias("file")).count().collect()]
    assert least <= len(sizes) <= most and sum(sizes) == n and max(sizes) < 1300


class _State:
    """State of one key that counts what is asked of it."""

    def __init__(self):
        self.map, self.value, self.calls = {}, None, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return _State()

    def containsKey(self, k):
        self.calls += 1
        return k in self.map

    def getValue(self, k):
        self.calls += 1
        return self.map[k]

    def updateValue(self, k, v):
        self.calls += 1
        self.map[k] = v

    def clear(self):
        self.map.clear()

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def deleteTimer(self, _):
        pass

    registerTimer = deleteTimer


def test_a_job_with_many_events_asks_its_state_once_for_each_step():
    """F10."""
    one = jobs.Follower()
    one.init(_State())
    event = lambda k: {"ts": datetime(2024, 1, 1, k // 60, k % 60), "status": "running", "step": k % 5}
    out = list(one.handleInputRows(("j",), iter([event(k) for k in range(1000)]), None))
    assert len(out) == 1000 and one.steps.calls <= 15
    assert not list(one.handleInputRows(("j",), iter([event(3)]), None))  # outdated


def test_a_filing_of_many_paragraphs(spark):
    """paragraphs are rows; and a tape can be made of replies alone."""
    words = ["x" * (1 + 37 * k % 900) for k in range(300)]
    rows = spark.createDataFrame([("c", "C", k, w) for k, w in enumerate(words)], "cik string, company string, pos int, t string")
    got = {r["batch"]: r["paragraphs"] for r in peers.paragraph_batches(rows).collect()}
    want: dict = {}
    for w, b in zip(words, batches.fold([len(w) for w in words], batches.by_size()[0])[0], strict=True):
        want.setdefault(b, []).append(w)
    assert got == want


def test_a_tape_of_prompts(spark, tmp_path):
    tape = replies.Recording(provider.Rules(F.upper("prompt")), spark, str(tmp_path / "tape"))
    tape.record(spark.createDataFrame([("j", "p", 0, "ask")], "job_id string, phase string, idx int, prompt string"))
    assert [tuple(r) for r in tape.recorded().collect()] == [("ask", "ASK")]


def test_pages_come_in_small_batches(spark):
    """F15."""
    from peerlens.sources import filings

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        filings.small_batches(spark)
        assert int(spark.conf.get(name)) <= filings.BATCH_PAGES
    finally:
        spark.conf.set(name, before)


def test_a_summary_is_what_folds_give():
    """also where all values that may come in have become alike."""
    for (rule, states), sizes in ((batches.by_call(), [3, 10, 1, 9, 4, 4, 4]), (batches.by_size(50), [7, 60, 3, 49, 1, 8]), (batches.by_call(), [])):
        runs = batches.summary(sizes, rule, states)
        for held in range(states):
            _, end, open_ = batches.fold(sizes, rule, held)
            assert batches._through(runs, held, 0) == (end, open_)


def test_edges_stay_dealt(spark):
    """few bytes of many edges aren't read by one task, in the join with their ends (here not broadcast) nor in the group."""
    n = 2000
    ends = spark.range(n).selectExpr("'C' AS label", "cast(id AS string) AS key").unionByName(spark.createDataFrame([("C", None), (None, "1")], "label string, key string"))
    edge = lambda src, dst: spark.range(n).selectExpr("'C' AS src_label", f"{src} AS src", "'R' AS rel", "'C' AS dst_label", f"{dst} AS dst", "map('k', cast(id AS string)) AS props")
    edges = edge("cast(id AS string)", "cast((id + 1) % 2000 AS string)")
    # Without a name, or of no node.
    wrong = edge("cast(NULL AS string)", "'1'").limit(1).unionByName(edge("'1'", "'none'").limit(1))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    try:
        tasks = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        once = graph.upsert_edges(edges.limit(0), edges.unionByName(wrong), ends)
        assert sum(tasks(once)) == n and max(tasks(once)) < n / 4
        assert max(tasks(graph.dropped_edges(edges, ends.where("key = '1'")))) < n / 4
        assert sorted((r["src"], r["dst"]) for r in graph.dropped_edges(edges.unionByName(wrong), ends).collect() if r["src"]) == [("1", "none")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept[0])
        spark.conf.set("spark.sql.shuffle.partitions", kept[1])


def _shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def _settles(spark, before):
    import time

    wait = time.monotonic() + 10
    while _shuffle_files(spark) > before and time.monotonic() < wait:
        time.sleep(0.1)
    return _shuffle_files(spark) <= before


def test_company_facts_are_dealt_once_and_leave_nothing_behind(spark, monkeypatch):
    from conftest import SF

    from peerlens import source_queries

    plans = []
    monkeypatch.setattr(source_queries, "written", lambda rows, label, run=source_queries.written: plans.append(rows) or run(rows, label))
    spark.sparkContext._jvm.System.gc()
    before = _shuffle_files(spark)
    docs = source_queries._fact_files(spark, SF)
    assert _settles(spark, before + 8)
    # Joins aside, rows are dealt by file, and by nothing that is nested.
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert text.count("hashpartitioning(file#") == 1 and "hashpartitioning(cik" not in text
    assert all(f.endswith(".txt.gz") for f in docs.inputFiles()) and docs.count() > 0
