"""What is kept between jobs: numbers, stored tables, fetched responses, replies, the term index, and followed jobs."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from peerlens.engine import Engine
from peerlens.operators import bm25, graph
from peerlens.operators.numbering import numbered
from peerlens.plans import evaluation, peers, provider, replies
from peerlens.sources import fetch, tables
from peerlens.sources.store import StoredGraph, StoredTable, WriteConflict
from peerlens.sources.term_index import TermIndex
from peerlens.streaming import jobs, steps

# Numbers


def test_numbers_go_on_over_parts(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(500), k) for k, g in enumerate(["hot"] * 900 + ["a", None, "b", None] * 30)]
    df = spark.createDataFrame(rows, "g string, o int, k int").repartition(5)
    want, seen = {}, {}
    for g, _, k in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        want[k] = seen[g]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.k: r.number for r in numbered(df, ["g"], ["o", "k"]).collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = numbered(df, [], [F.desc("k")]).collect()
    assert {r.k: r.number for r in every} == {k: len(rows) - k for k in range(len(rows))}
    assert numbered(df.limit(0), ["g"], ["k"]).count() == 0
    # No window sees more of a group than one row for each part.
    plan = graph.citation_ids(df, "X", ["k"], ["g"])._jdf.queryExecution().toString()
    assert "row_number" not in plan


# Stored tables


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = StoredTable(spark, f"{tmp_path}/t", "k string, a int, b int", ["k"], 8)
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(f"k{i}", i, None, 0) for i in range(100)], "k string, a int, b int, seq int"))
    files = lambda: {f: Path(f.removeprefix("file:")).stat().st_mtime_ns for f in table.read().inputFiles()}
    before = files()
    table.upsert(spark.createDataFrame([("k5", None, 7, 1), ("k5", 50, 8, 2), ("new", 1, 1, 1)], "k string, a int, b int, seq int"))
    after = files()
    kept = [f for f in before if f in after]
    assert len(kept) >= len(before) - 2 and all(before[f] == after[f] for f in kept)
    rows = {r.k: (r.a, r.b) for r in table.read().collect()}
    assert len(rows) == 101 and rows["k5"] == (50, 8) and rows["k6"] == (6, None) and rows["new"] == (1, 1)
    assert table.read(1).count() == 100  # the older state is still there
    assert [r.k for r in table.lookup(spark.createDataFrame([("k7",), ("none",)], "k string")).collect()] == ["k7"]
    table.delete(spark.createDataFrame([("k7",), ("k8",)], "k string"))
    assert table.read().count() == 99
    assert table.vacuum() > 0 and table.read().count() == 99
    table.cleared()
    assert table.read().count() == 0


def test_two_writers(spark, tmp_path):
    one = StoredTable(spark, f"{tmp_path}/t", "k string, a int", ["k"], 4)
    rows = spark.createDataFrame([("x", 1, 0)], "k string, a int, seq int")
    one.upsert(rows)

    def meanwhile(old, new):
        StoredTable(spark, f"{tmp_path}/t", "k string, a int", ["k"], 4).upsert(rows.withColumn("a", F.lit(2)))
        return old

    with pytest.raises(WriteConflict):
        one.change(rows, meanwhile)
    assert one.read().first().a == 2


def test_stored_graph(spark, tmp_path):
    g = StoredGraph(spark, f"{tmp_path}/g", 4)
    g.add("C", "name string", ["name"], spark.createDataFrame([("a", 0), ("b", 0)], "name string, seq int"), F.col("name"))
    edge = lambda s, d, v, n: ("C", s, "R", "C", d, {"v": v}, n)
    new = [edge("a", "b", "1", 1), edge("a", "b", "2", 2), edge("a", "none", "3", 3)]
    g.connect(spark.createDataFrame(new, graph.EDGES + ", seq int"))
    g.connect(spark.createDataFrame([edge("b", "a", "4", 1)], graph.EDGES + ", seq int"))
    assert sorted((r.src, r.dst, r.props["v"]) for r in g.edges.read().collect()) == [("a", "b", "2"), ("b", "a", "4")]


# Fetched responses


def test_cache_fetches_what_is_missing(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def transport(key):
        n = len(list(calls.glob(f"{key}-*")))
        (calls / f"{key}-{n}").write_text("")
        if key == "down":
            raise OSError("unreachable")
        return (404, None) if key == "none" else (200, f"{key} {n}")

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    at = lambda day: fetch.Cache(spark, f"{tmp_path}/cache", transport, days=30, delay=0, now=F.lit(day).cast("timestamp"))
    first = {r.key: r.body for r in at("2024-01-01").get(keys("a", "b", "a", None, "none", "down")).collect()}
    assert first == {"a": "a 0", "b": "b 0"} and len(list(calls.iterdir())) == 4
    assert {r.key: r.body for r in at("2024-01-20").get(keys("a", "c")).collect()} == {"a": "a 0", "c": "c 0"}
    assert {r.key: r.body for r in at("2024-02-10").get(keys("a", "b", "c", "none")).collect()} == {"a": "a 1", "b": "b 1", "c": "c 0"}
    made = sorted(f.name for f in calls.iterdir())
    assert made == ["a-0", "a-1", "b-0", "b-1", "c-0", "down-0", "none-0", "none-1"]
    assert at("2024-02-10").fetch(keys("a", "b", "c")) == 0 == at("2024-02-10").fetch(keys("a").limit(0))


def test_company_facts_and_codes(spark, tmp_path):
    body = json.dumps({"cik": "7", "entityName": "Acme", "facts": {"us-gaap": {"Assets": {"label": "Assets", "units": {"USD": [{"end": "2023-12-31", "val": 5.0}]}}}}})
    cache = fetch.Cache(spark, f"{tmp_path}/facts", fetch.recorded({"7": body}), delay=0)
    rows = fetch.company_facts(cache, spark.createDataFrame([("0000000007",), ("8",)], "cik string")).collect()
    assert [(r.cik, r.entityName, r.facts["us-gaap"]["Assets"].units["USD"][0].val) for r in rows] == [("7", "Acme", 5.0)]
    codes = fetch.Cache(spark, f"{tmp_path}/codes", fetch.recorded({"1311": "<feed><entry></entry></feed>", "9": "<feed></feed>"}), delay=0)
    assert [r.code for r in fetch.known_codes(codes, spark.createDataFrame([("1311",), ("9",), ("10",)], "code string")).collect()] == ["1311"]


def pages():
    """A transport for the data source."""
    return fetch.recorded({"a": "page a", "b": "page b", "c": "page c"})


def test_data_source(spark):
    fetch.register(spark)
    spark.sparkContext.addPyFile(__file__)
    load = lambda: spark.read.format("fetched").option("transport", "test_stored:pages").option("delay", "0").option("parts", "2").load()
    got = load().where(F.col("key").isin("a", "c", "z")).select("key", "status", "body").collect()
    assert sorted(tuple(r) for r in got) == [("a", 200, "page a"), ("c", 200, "page c"), ("z", 404, None)]
    assert [r.body for r in load().where("key = 'b'").collect()] == ["page b"]
    with pytest.raises(Exception, match="condition on key"):
        load().collect()


# Replies


def test_replies_are_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(prompt, key):
        n = len(list(calls.glob(f"{key}-*")))
        (calls / f"{key}-{n}").write_text(prompt)
        if prompt.startswith("busy") and not n:
            raise RuntimeError("ThrottlingException")
        if prompt == "broken" and n < 2:
            raise ValueError("no such model")
        return prompt.upper()

    store = replies.ReplyStore(spark, f"{tmp_path}/r", call, wait=0.01, rate=500, parts=3)
    prompts = spark.createDataFrame([("j", "p", k, t) for k, t in enumerate(["one", "two", "one", "busy 1", "busy 2", "broken", None])], "job_id string, phase string, idx int, prompt string")
    said = {r.idx: r.reply for r in store.replies(prompts).collect()}
    assert said == {0: "ONE", 1: "TWO", 2: "ONE", 3: "BUSY 1", 4: "BUSY 2", 5: None, 6: None}
    count = lambda: sorted(f.read_text() for f in calls.iterdir())
    assert count() == ["broken", "busy 1", "busy 1", "busy 2", "busy 2", "one", "two"]
    # A run whose tasks are killed midway leaves its finished rounds; a later one asks only what has no reply.
    more = prompts.unionByName(spark.createDataFrame([("k", "q", 0, "three"), ("k", "q", 1, "two")], prompts.schema))
    assert {(r.job_id, r.idx): r.reply for r in store.replies(more).collect()}[("k", 1)] == "TWO"
    assert count().count("two") == 1 and count().count("three") == 1 and count().count("broken") == 2
    again = {(r.job_id, r.idx): r.reply for r in replies.ReplyStore(spark, f"{tmp_path}/r", call).replies(more).collect()}
    assert again[("j", 5)] == "BROKEN" and count().count("one") == 1
    # The store is also a record.
    assert {r.idx: r.reply for r in provider.Recorded(store.kept()).replies(prompts).collect()}[0] == "ONE"


def test_a_killed_run_loses_no_round(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Killed(BaseException):
        pass

    def call(prompt, key):
        (calls / f"{key}-{len(list(calls.glob(key + '-*')))}").write_text(prompt)
        if prompt == "busy" and len(list(calls.glob(key + "-*"))) == 1:
            raise ConnectionError
        if prompt == "busy" and not (tmp_path / "killed").exists():
            (tmp_path / "killed").write_text("")
            raise Killed  # what ends the worker in the second round
        return prompt

    prompts = spark.createDataFrame([("a",), ("b",), ("busy",)], "prompt string")
    store = replies.ReplyStore(spark, f"{tmp_path}/r", call, wait=0.0)
    with pytest.raises(Exception):
        store.fill(prompts)
    assert {r.reply for r in store.replies(prompts).collect()} == {"a", "b", "busy"}
    assert sorted(f.read_text() for f in calls.iterdir()) == ["a", "b", "busy", "busy", "busy"]


def by_text(spark, rows):
    """Recorded replies for prompts that contain a word; fails if two prompts share one."""

    class One:
        def replies(self, prompts):
            out = prompts
            reply = F.lit(None).cast("string")
            for word, said in rows.items():
                reply = F.when(F.col("prompt").contains(word), said).otherwise(reply)
            return out.withColumn("reply", reply)

    return One()


def test_two_companies_keep_their_replies(spark, tmp_path):
    batches = spark.createDataFrame([("1", "C1", 0, ["debt is high"], "[0]\ndebt is high"), ("2", "C2", 0, ["rain falls"], "[0]\nrain falls")], "cik string, company string, batch int, paragraphs array<string>, prompt string")
    risk = lambda name: json.dumps([{"risk_name": name, "description": "a description that is long enough", "why": "w", "organization": "", "source_index": 0}])
    tape = replies.Recording(by_text(spark, {"debt": risk("Debt"), "rain": risk("Rain")}), spark, f"{tmp_path}/tape")
    peers.structured_risks(batches, tape, "j").collect()
    out = peers.structured_risks(batches, provider.Recorded(tape.recorded()), "j").collect()
    assert sorted((r.cik, r.risk_name, r.source_text) for r in out) == [("1", "Debt", "debt is high"), ("2", "Rain", "rain falls")]


def test_two_kinds_keep_their_verdicts(spark):
    risk = "struct<citation_id:string,name:string,source_text:string,source_page:string,section_title:string>"
    metric = "struct<citation_id:string,name:string,value:string,unit:string,source_text:string,source_page:string,section_title:string,xbrl_tag:string>"
    rows = spark.createDataFrame([(1, "T", None, [("R1", "fire", "fires burn", "1", "s")], [("M1", "debt", "5", "USD", "debt of 5", "2", "s", "")], [], [])], f"seq int, target string, peer string, target_risks array<{risk}>, target_metrics array<{metric}>, peer_risks array<{risk}>, peer_metrics array<{metric}>")

    class Noted:
        asked = None

        def replies(self, prompts):
            kept = prompts.select("prompt").collect()
            Noted.asked = (Noted.asked or []) + [r.prompt for r in kept]
            return prompts.withColumn("reply", F.lit("1: YES - x"))

    evaluation.target_validation(rows, Noted(), "j")
    table = spark.createDataFrame([(p, "1: YES - right" if "fire" in p else "1: NO - wrong") for p in Noted.asked], "prompt string, reply string")
    out = evaluation.target_validation(rows, provider.Recorded(table), "j").collect()
    assert sorted((r.citation_id, r.is_correctly_extracted, r.explanation) for r in out) == [("M1", "false", "wrong"), ("R1", "true", "right")]


# The term index


@pytest.mark.parametrize("k", [3, 15])
def test_index_equals_scores(spark, tmp_path, k):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(6000)]
    docs = [(f"d{i}", words[i * 12 : i * 12 + rng.randrange(0, 12)]) for i in range(500)]
    corpus = spark.createDataFrame(docs, "doc_id string, tokens array<string>")
    index = TermIndex(spark, f"{tmp_path}/i", buckets=8, block_docs=20)
    for part in (corpus.where("doc_id < 'd3'"), corpus.where("doc_id >= 'd3'")):
        index.add(part)
    asked = spark.createDataFrame([("a", ["w1", "w2", "w2"]), ("b", ["w5"]), ("c", ["w40", "w1", "none"]), ("d", ["none"])], "query string, tokens array<string>")
    want = {}
    for r in bm25.scores(corpus, asked).collect():
        if r.score >= 0.2:
            want.setdefault(r.query, []).append((-round(r.score, 9), r.doc))
    got = {}
    for r in index.search(asked, k, 0.2).collect():
        got.setdefault(r.query, []).append((-round(r.score, 9), r.doc))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v)[:k] for q, v in want.items()} and len(got["a"]) == k
    # A question reads its terms' buckets only, and no text.
    files = index.search(asked.where("query = 'b'"), k, 0.2).inputFiles()
    assert not any("totals" in f for f in files)


# Followed jobs


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("job_id", "step", "status", "ts"), r, strict=True))) for r in rows))


def test_followed_jobs(spark, tmp_path):
    source, log, check = tmp_path / "in", f"{tmp_path}/log", f"{tmp_path}/check"

    def run():
        followed = jobs.followed(steps.events(spark, str(source)), "10 seconds", silence=30, idle=600)
        jobs.start(followed, log, check).awaitTermination(120)
        rows = spark.read.schema(jobs.LOG).parquet(log).collect()
        return sorted((r.job_id, r.kind, r.step or 0, r.status or "") for r in rows)

    t = lambda m, s=0: f"2024-01-01T00:{m:02d}:{s:02d}"
    drop(source, "1.json", [("j", 1, "done", t(0, 5)), ("j", 1, "running", t(0)), ("k", 1, "running", t(0)), ("j", 1, "done", t(0, 5)), (None, 1, "running", t(0)), ("k", 1, None, None)])
    first = [("j", "step", 1, "done"), ("j", "step", 1, "running"), ("k", "step", 1, "running")]
    assert [r for r in run() if r[1] == "step"] == first
    # A new run goes on from the checkpoint: repeated events and older ones of a step say nothing, a terminal one ends the job.
    drop(source, "2.json", [("j", 1, "running", t(0)), ("k", 1, "done", t(1)), ("j", 2, "running", t(0, 50)), ("j", None, "pipeline_failed", t(1)), ("j", 3, "running", t(1, 1))])
    second = run()
    assert [r for r in second if r[1] in ("step", "end")] == sorted([*first, ("k", "step", 1, "done"), ("j", "step", 2, "running"), ("j", "end", 0, "pipeline_failed")])
    # Others go on, so time passes: k is silent, j has ended and stays silent.
    drop(source, "3.json", [("l", 1, "running", t(3)), ("j", 4, "running", t(3))])
    third = run()
    assert ("k", "heartbeat", 0, "") in third and not any(r[0] == "j" and r[1] == "heartbeat" for r in third if r not in second)
    assert not any(r[2] == 4 for r in third)
    # Very late ones are left out; a job of which nothing is heard is dropped.
    drop(source, "4.json", [("k", 9, "running", t(0, 1)), ("l", 2, "running", t(30))])
    drop(source, "5.json", [("l", 3, "running", t(31))])
    run()
    drop(source, "6.json", [("l", 4, "running", t(32))])
    last = run()
    assert ("k", "expired", 0, "") in last and not any(r[2] == 9 for r in last)
    state = {(r.job_id, r.step): (r.status, r.n, r.ended) for r in jobs.latest(spark.read.schema(jobs.LOG).parquet(log)).collect()}
    assert state["j", 1] == ("done", 2, "pipeline_failed") and state["k", 1] == ("done", 2, None) and state["l", 4][0] == "running"


def test_unknown_job(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), provider.Rules(F.lit("")))
    with pytest.raises(KeyError):
        engine.state("nosuch")
    job = engine.create("f", 2024, "Acme")
    assert engine.state(job)["main_company"] == "Acme" and engine.next_step(job) == 1


def test_fresh(spark):
    rows = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "k string, cached_at string").withColumn("cached_at", F.col("cached_at").cast("timestamp"))
    assert [r.k for r in tables.fresh(rows, 30, now=F.lit("2024-02-01").cast("timestamp")).collect()] == ["b"]


# Batches


@pytest.mark.parametrize("kind", ["size", "call"])
def test_batches_go_on_over_parts(spark, kind):
    from peerlens.operators import batches

    rng = random.Random(3)
    rule = batches.by_size(50) if kind == "size" else batches.by_call(10)
    sizes = lambda: rng.choice([1, 3, 7, 9, 60, 0]) if kind == "size" else rng.randrange(1, 11)
    rows = [(g, k, sizes()) for k, g in enumerate(["hot"] * 700 + ["a", "b", None] * 40)]

    def plain(own):
        out, batch, held = {}, 0, 0
        for k, n in own:
            if kind == "call":
                if held and held + n > 10:
                    batch, held = batch + 1, 0
                out[k], held = batch, held + n
                continue
            if n >= 50:
                batch += held > 0
                out[k], batch, held = batch, batch + 1, 0
                continue
            out[k], held = batch, held + n
            if held >= 50:
                batch, held = batch + 1, 0
        return out

    want = {}
    for g in {r[0] for r in rows}:
        want |= plain([(k, n) for h, k, n in rows if h == g])
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = batches.batched(df, ["g"], ["k"], "n", rule)
        assert out.columns == ["g", "k", "n", "batch"] and {r.k: r.batch for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.k: r.batch for r in batches.batched(df.where("g = 'hot'"), [], ["k"], "n", rule).collect()} == {k: v for k, v in want.items() if k < 700}


# Uploads and section trees


def test_uploads_land_once(spark, tmp_path):
    from peerlens.sources.landing import Landing

    folder = tmp_path / "up"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("# PART I\n\n## Item 1\n\nWords of one.\n")
    (folder / "b.htm").write_text("<html><body><p>PART I</p><p>Some text of b.</p></body></html>")
    (folder / "c.exe").write_bytes(b"\0")
    landing = Landing(spark, str(folder), str(tmp_path / "landed"), buckets=2)
    landing.run().awaitTermination(120)
    titles = lambda: sorted((r.title, r.word_count) for r in landing.sections.read().collect())
    first = titles()
    assert first == [("Item 1", 3), ("PART I", 3), ("PART I", 4)]
    # A copy under another name, an empty file, which gives nothing, and a new one.
    (folder / "sub/copy.md").write_text("# PART I\n\n## Item 1\n\nWords of one.\n")
    (folder / "sub/empty.md").write_text("")
    (folder / "sub/new.md").write_text("# PART II\n\nNew words.\n")
    landing.run().awaitTermination(120)
    assert titles() == sorted([*first, ("PART II", 2)]) and landing.files.read().count() == 3
    # The same batch once more, as after a crash between its writes, changes nothing.
    batch = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,htm}").load(str(folder))
    landing._merge(batch, 7)
    assert titles() == sorted([*first, ("PART II", 2)])


def test_section_tree(spark, tmp_path):
    leaf = lambda title, level, page: {"title": title, "level": level, "word_count": 2, "text_length": 9, "start_page": page, "end_page": page, "page_contents": [{"page_number": page, "content": title}]}
    deep = leaf("F", 6, 5)
    for level, name in ((5, "E"), (4, "D")):
        deep = {"title": name, "level": level, "word_count": 2, "text_length": 9, "subsections": [deep]}
    tree = {"sections": [{"title": "A", "level": 1, "word_count": 6, "text_length": 27, "subsections": [leaf("B", 2, 1), {"title": "C", "level": 2, "subsections": [deep]}]}, leaf("G", 1, 6)]}
    (tmp_path / "x.json").write_text(json.dumps(tree))
    (tmp_path / "y.json").write_text(json.dumps({"sections": [leaf("H", 1, 1)]}))
    (tmp_path / "z.json").write_text(json.dumps({"sections": []}))
    rows = sorted((r.path.rsplit("/", 1)[1], r.pos, r.title, r.level, r.parent, r.leaf, (r.pages or [[None]])[0][0]) for r in tables.section_tree(spark, f"{tmp_path}/*.json").collect())
    x = [("A", 1, None, False, None), ("B", 2, 0, True, 1), ("C", 2, 0, False, None), ("D", 4, 2, False, None), ("E", 5, 3, False, None), ("F", 6, 4, True, 5), ("G", 1, None, True, 6)]
    assert rows == [("x.json", k, *r) for k, r in enumerate(x)] + [("y.json", 0, "H", 1, None, True, 1)]


def test_an_addition_to_the_index_leaves_no_shuffle_files(spark, tmp_path):
    from test_growth import _settles, _shuffle_files

    from peerlens.sources.term_index import TermIndex

    rows = [(k, [f"w{k % 7}", f"w{k % 5}", f"w{k % 7}", f"x{k}"]) for k in range(600)] + [(3, ["w3", "w3", "w3", "x3"])]
    index = TermIndex(spark, str(tmp_path / "index"), "long", buckets=2, block_docs=8)
    corpus = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    spark.sparkContext._jvm.System.gc()
    before = _shuffle_files(spark)
    index.add(corpus)
    assert _settles(spark, before)
    # Rows that share a doc and a length are one document's.
    assert [r["f"] for r in index._read("postings").where("doc = 3 and term = 'w3'").collect()] == [6]
    found = index.search(spark.createDataFrame([(1, ["x3", "w3"]), (2, ["x9"])], "query long, tokens array<string>"), 1, 0.1).collect()
    assert sorted((r["query"], r["doc"]) for r in found) == [(1, 3), (2, 9)]
