"""Queries that run whole evaluations, prompts, artefacts and step streams over the benchmark tables, with replies by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import lenses as ln
from .answer_queries import ITEMS, answer_rows
from .operators import batches, numbering, sections
from .plans import evaluation, provider, qa
from .registry import query
from .source_queries import dealt_to, json_files, scratch
from .sources import tables
from .streaming import jobs, steps


def odd_items() -> provider.Rules:
    """YES for the odd items of a prompt."""
    found = F.regexp_extract_all("prompt", F.lit(r"(?m)^\[(\d+)\]"), F.lit(1))
    return provider.Rules(F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(": "), F.when(x.cast("int") % 2 == 1, "YES").otherwise("NO"), F.lit(" - because"))), "\n"))


def odd_pairs() -> provider.Rules:
    """YES for the themes of a prompt whose numbers of chunk and theme have an odd sum."""
    found = F.regexp_extract_all("prompt", F.lit(r"(?m)^(\d+\.\d+) "), F.lit(1))
    odd = lambda x: (F.split_part(x, F.lit("."), F.lit(1)).cast("int") + F.split_part(x, F.lit("."), F.lit(2)).cast("int")) % 2 == 1
    return provider.Rules(F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(": "), F.when(odd(x), "YES").otherwise("NO"), F.lit(" - because"))), "\n"))


_CHUNKS = f"""{ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY seq, l, pos) AS n FROM items), o AS (SELECT * FROM r WHERE n = 1),
s AS (SELECT *, row_number() OVER (PARTITION BY type, company, CASE WHEN type = 'Metric' THEN p_type ELSE citation_id END ORDER BY seq, l, pos) AS m FROM o)"""


@query(f"""WITH {_CHUNKS}, c AS (SELECT citation_id, (row_number() OVER (ORDER BY citation_id) - 1) % 20 + 1 AS item FROM s WHERE m = 1)
SELECT citation_id, CASE WHEN item % 2 = 1 THEN 'true' ELSE 'false' END AS is_relevant, 'because' AS explanation FROM c""")
def judged_precision(spark, sf):
    """Every source that was shown, judged in calls of twenty."""
    return evaluation.context_precision(answer_rows(spark, sf), "which risks are there?", odd_items(), "j")


@query(f"""WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY seq, l, pos) AS n FROM items WHERE l < 2),
c AS (SELECT citation_id, type, name, (row_number() OVER (PARTITION BY type ORDER BY citation_id) - 1) % 8 + 1 AS item FROM r WHERE n = 1)
SELECT citation_id, type, name AS extracted_name, CASE WHEN item % 2 = 1 THEN 'true' ELSE 'false' END AS is_correctly_extracted, 'because' AS explanation FROM c""")
def judged_targets(spark, sf):
    """The target's risks and metrics against their sources, each kind in calls of eight."""
    return evaluation.target_validation(answer_rows(spark, sf), odd_items(), "j")


@query(f"""WITH {ITEMS}, c AS (SELECT *, k % 3 = 1 AS ok FROM items WHERE l = 2)
SELECT company AS company_name, count(*) AS n, count(*) FILTER (NOT ok) AS n_skipped FROM c GROUP BY 1""")
def judged_peer_risks(spark, sf):
    """Peers' risks against their texts; those without one say why they weren't judged."""
    out = evaluation.risk_peers(answer_rows(spark, sf), odd_pairs(), "j")
    return out.groupBy("company_name").agg(F.count("*").alias("n"), F.count_if(F.col("relevance_explanation") == "Chunk missing").alias("n_skipped"))


_CALLS = f"""{ITEMS}, t AS (SELECT citation_id, company, name, source_text, sha256(source_text) AS h FROM items WHERE l = 2 AND k % 3 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY citation_id, name) AS n FROM t), f AS (SELECT h, citation_id AS first FROM r WHERE n = 1),
z AS (SELECT h, (n - 1) // 10 AS slice, count(*) AS size FROM r GROUP BY 1, 2),
o AS (SELECT h, slice, size, row_number() OVER (ORDER BY first, h, slice) AS i FROM z JOIN f USING (h)),
g AS (SELECT h, slice, i, 0 AS call, size AS held FROM o WHERE i = 1
  UNION ALL SELECT o.h, o.slice, o.i, CASE WHEN held + size > 10 THEN call + 1 ELSE call END, CASE WHEN held + size > 10 THEN size ELSE held + size END FROM g JOIN o ON o.i = g.i + 1),
c AS (SELECT h, slice, call, row_number() OVER (PARTITION BY call ORDER BY i) AS chunk FROM g)"""


@query(f"""WITH RECURSIVE {_CALLS} SELECT citation_id, company AS company_name, name AS risk_theme, CASE WHEN (chunk + (n - 1) % 10 + 1) % 2 = 1 THEN 'true' ELSE 'false' END AS is_semantically_relevant, 'because' AS relevance_explanation
FROM r JOIN c ON c.h = r.h AND c.slice = (r.n - 1) // 10
UNION ALL SELECT citation_id, company, name, 'false', 'Chunk missing' FROM items WHERE l = 2 AND k % 3 <> 1""")
def judged_peer_texts(spark, sf):
    """Every peer's risk against its text; a text that several risks name is shown once, and calls hold ten risks."""
    return evaluation.risk_peers(answer_rows(spark, sf), odd_pairs(), "j")


@query(f"""WITH RECURSIVE {_CALLS} SELECT call, count(DISTINCT c.chunk) AS n_chunks, count(*) AS n_themes FROM r JOIN c ON c.h = r.h AND c.slice = (r.n - 1) // 10 GROUP BY 1""")
def peer_text_calls(spark, sf):
    """The calls in which peers' risks are judged."""
    found = qa.risk_chunks(answer_rows(spark, sf)).withColumn("job_id", F.lit("j")).where("skip_reason is null")
    return evaluation.risk_calls(found).groupBy("call").agg(F.count_distinct("chunk").alias("n_chunks"), F.count(F.lit(1)).alias("n_themes"))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
g AS (SELECT source, doc_id, i, 0 AS batch, CASE WHEN n >= 5000 THEN 0 ELSE n END AS held, n >= 5000 AS closed FROM o WHERE i = 1
  UNION ALL SELECT o.source, o.doc_id, o.i, g.batch + CAST(g.closed OR (o.n >= 5000 AND g.held > 0) AS INT),
    CASE WHEN o.n >= 5000 OR g.held + o.n >= 5000 THEN 0 ELSE g.held + o.n END, o.n >= 5000 OR g.held + o.n >= 5000
  FROM g JOIN o ON o.source = g.source AND o.i = g.i + 1)
SELECT doc_id, source, batch FROM g""")
def text_batches(spark, sf):
    """Every source's texts, in order, in batches that close at 5000 characters."""
    d = ln.table(spark, sf, "documents").select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return batches.batched(d, ["source"], ["doc_id"], "n", batches.by_size()).select("doc_id", "source", "batch")


@query(f"""WITH {ITEMS}, m AS (SELECT * FROM items WHERE l = 3 AND link_cik <> '' AND tag <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY seq, l, pos) AS n FROM m), o AS (SELECT * FROM r WHERE n = 1),
v AS (SELECT citation_id, CASE WHEN k % 7 = 3 THEN 'NOT_FOUND' WHEN abs(p_size - 20.0) / 20.0 <= 0.02 THEN 'MATCH' ELSE 'MISMATCH' END AS match FROM o) SELECT match, count(*) AS n FROM v GROUP BY 1""")
def judged_values(spark, sf):
    """Peers' metrics against reported facts, of which one company has none."""
    brands = ln.table(spark, sf, "part").select(F.concat(F.lit("Tag"), "p_brand").alias("tag")).distinct()
    years = spark.range(2020, 2024).select(F.col("id").cast("int").alias("fy"))
    companies = spark.range(7).where("id <> 3").select(F.col("id").cast("string").alias("cik"))
    one = companies.join(brands).join(years)
    facts = one.select("cik", F.lit("us-gaap").alias("taxonomy"), "tag", F.lit("USD").alias("unit"), F.concat(F.col("fy").cast("string"), F.lit("-12-31")).alias("end"), F.lit(20.0).alias("val"), "fy", F.lit("FY").alias("fp"), F.lit("10-K").alias("form"), F.lit("2025-01-01").alias("filed"))
    return evaluation.num_values(answer_rows(spark, sf), facts).groupBy("match").agg(F.count("*").alias("n"))


@query("""SELECT 'which risks?' AS question, 'An answer of ' || (SELECT min(s_name) FROM supplier) AS answer, count(DISTINCT p_brand) AS n_rows FROM part""")
def answer_files(spark, sf):
    """The artefacts of a question, written and read again by an evaluation."""
    rows = qa.cleaned(answer_rows(spark, sf))
    path = scratch(spark, "answer")
    extraction = rows.agg(F.count("*").alias("record_count"), F.to_json(F.collect_list(F.struct("seq", "peer"))).alias("results")).select(F.lit("which risks?").alias("question"), "record_count", "results")
    answer = ln.table(spark, sf, "supplier").agg(F.concat(F.lit("An answer of "), F.min("s_name")).alias("value"))
    tables.write_answer(path, extraction, answer, answer)
    back = tables.evaluation_inputs(spark, path)
    return back.select("question", "answer", F.size(F.from_json("results", "array<struct<seq:int,peer:string>>")).cast("long").alias("n_rows"))


@query("""SELECT p_brand AS brand, CAST(count(*) AS INT) AS n, md5('Judge:' || chr(10) || chr(10) || string_agg('[' || p_partkey || '] ' || p_name, chr(10) ORDER BY p_partkey)) AS prompt FROM part GROUP BY 1""")
def numbered_prompts(spark, sf):
    """One prompt for each group, its items numbered."""
    out = provider.numbered_prompt("Judge:", F.col("p_name"), ["p_brand"], "p_partkey", ln.table(spark, sf, "part"))
    return out.select(F.col("p_brand").alias("brand"), "n", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query("SELECT s_suppkey AS idx, upper('ask about ' || s_name) AS reply FROM supplier")
def live_replies(spark, sf):
    """A function asked in batches on the executors."""
    prompts = ln.table(spark, sf, "supplier").select(F.lit("j").alias("job_id"), F.lit("p").alias("phase"), F.col("s_suppkey").alias("idx"), F.concat(F.lit("ask about "), "s_name").alias("prompt"))
    return provider.Live(lambda prompt: prompt.upper()).replies(prompts).select("idx", "reply")


@query("""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2""")
def step_event_windows(spark, sf):
    """Events of each status in windows of five minutes."""
    rows = ln.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    out = steps.recent(rows)
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "status", F.col("count").alias("n"))


@query("""WITH s AS (SELECT user_id AS job, CAST(hour(ts) % 5 + 1 AS INT) AS step, ts, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'running' END AS status FROM events)
SELECT CAST(job AS VARCHAR) AS job_id, step, arg_max(status, ts) AS status FROM s GROUP BY 1, 2""")
def step_stream(spark, sf):
    """The same events as files, followed as a stream; the state after the last trigger."""
    e = ln.table(spark, sf, "events")
    rows = e.select(F.col("user_id").cast("string").alias("job_id"), (F.hour("ts") % 5 + 1).cast("int").alias("step"), F.when(F.col("event_type") == "purchase", "done").otherwise("running").alias("status"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"))
    source, state = scratch(spark, "events"), scratch(spark, "state")
    rows.repartition(8).write.json(source)
    steps.follow(steps.events(spark, source, 4), scratch(spark, "offsets"), lambda df, _: df.write.mode("overwrite").parquet(state)).awaitTermination()
    return spark.read.parquet(state).select("job_id", "step", "status")


@query("""SELECT doc_id AS doc, count(*) AS n, CAST(sum(length(t) % 3 + 1) AS BIGINT) AS levels FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS t FROM documents WHERE length(trim(text)) > 0) WHERE i % 3 = 0 AND regexp_matches(t, '[^ ]') GROUP BY 1""")
def section_files(spark, sf):
    """Sections as JSON files, read by the scan."""
    parsed = sections.headed(ln.markdown(spark, sf)).select("doc", "pos", "title", "level")
    docs = parsed.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "level"))).alias("sections"))
    back = tables.sections(spark, json_files(docs, dealt_to(F.col("doc"), ln.table(spark, sf, "documents").count(), 1_000, 8), "sections"))
    flat = back.select(F.col("doc").cast("long").alias("doc"), F.inline("sections"))
    return flat.groupBy("doc").agg(F.count("*").alias("n"), F.sum("level").alias("levels"))


@query("""WITH e AS (SELECT *, ntile(2) OVER (ORDER BY ts, event_id) AS wave FROM events),
r AS (SELECT user_id, ts, CAST(hour(ts) % 5 + 1 AS INT) AS step, wave,
        CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'pipeline_failed' WHEN event_type = 'purchase' THEN 'done' ELSE 'running' END AS status FROM e),
t AS (SELECT user_id, min(ts) AS ended FROM r WHERE status = 'pipeline_failed' GROUP BY 1)
SELECT CAST(r.user_id AS VARCHAR) AS job_id, step, arg_max(status, r.ts) AS status, count(*) AS n, max(CASE WHEN ended IS NULL THEN NULL ELSE 'pipeline_failed' END) AS ended
FROM r LEFT JOIN t ON t.user_id = r.user_id WHERE status <> 'pipeline_failed' AND (ended IS NULL OR r.ts < ended) GROUP BY 1, 2""")
def followed_jobs(spark, sf):
    """All events as a stream of three drops: the earlier half, the later half together with a repeated part of the first,
    and outdated copies of the first ones under other names of steps, which the watermark leaves out."""
    e = ln.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    failed = (F.col("event_type") == "error") & (F.col("event_id") % 50 == 0)
    rows = e.select(
        "event_id",
        F.col("user_id").cast("string").alias("job_id"),
        (F.hour("ts") % 5 + 1).cast("int").alias("step"),
        F.when(failed, "pipeline_failed").when(F.col("event_type") == "purchase", "done").otherwise("running").alias("status"),
        "ts",
    )
    n = rows.count()
    bound = numbering.numbered(rows.select("event_id", "ts"), [], ["ts", "event_id"]).where(F.col("number") == (n + 1) // 2).select(F.col("ts").alias("middle"))
    dealt = rows.join(F.broadcast(bound)).withColumn("first", F.col("ts") <= F.col("middle"))  # one row
    source = scratch(spark, "drops")
    out = ["job_id", "step", "status", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts")]
    drops = [
        dealt.where("first").select(*out),
        dealt.where("not first or event_id % 10 = 0").select(*out),
        dealt.where("ts < middle - interval 10 days").withColumn("step", F.lit(99)).select(*out),
    ]
    for drop in drops:
        drop.repartition(4).write.mode("append").json(source)
    log = scratch(spark, "log")
    events = steps.events(spark, source, 4).withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.start(jobs.followed(events, "1 hour", idle=3650 * 86_400), log, scratch(spark, "offsets")).awaitTermination()
    return jobs.latest(spark.read.schema(jobs.LOG).parquet(log))
