"""Queries over what the engine keeps between jobs: stored nodes and edges, fetched responses, replies, and a term index."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from . import lenses as ln
from .answer_queries import ITEMS, answer_rows, risk_batches, risk_reply
from .functions import entities, text
from .operators import bm25, extraction_log, graph
from .plans import evaluation, peers, provider, replies
from .registry import query
from .run_queries import odd_items
from .source_queries import scratch
from .sources import fetch
from .sources.landing import Landing
from .sources.shared import stored
from .sources.store import StoredGraph, StoredTable
from .sources.term_index import TermIndex


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n, max(p_partkey) AS newest FROM part GROUP BY 1, 2),
u AS (SELECT p_brand, p_type, arg_max(p_name, p_partkey) AS name, count(*) AS writes FROM part WHERE p_size >= 25 GROUP BY 1, 2)
SELECT n.p_brand AS brand, n.p_type AS type, n.n, u.name AS name, n.newest FROM n LEFT JOIN u ON n.p_brand = u.p_brand AND n.p_type = u.p_type""")
def stored_upserts(spark, sf):
    """Metrics written to a stored table, then changed by a second batch that names some of them, and read again."""
    p = ln.table(spark, sf, "part")
    table = StoredTable(spark, scratch(spark, "metrics"), "brand string, type string, n long, name string, newest int", ["brand", "type"], 8)
    first = p.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.max("p_partkey").cast("int").alias("newest"))
    table.upsert(first.withColumns({"name": F.lit(None).cast("string"), "seq": F.lit(0)}))
    table.upsert(p.where("p_size >= 25").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq")))
    return table.read().select("brand", "type", "n", "name", "newest")


@query("""WITH l AS (SELECT l_suppkey, l_partkey, arg_max(l_quantity, CAST(l_returnflag = 'A' AS BIGINT) * 1000000000000 + l_orderkey * 10 + l_linenumber) AS quantity FROM lineitem GROUP BY 1, 2)
SELECT s_name AS src, count(*) AS n, CAST(sum(CAST(quantity AS BIGINT)) AS BIGINT) AS quantity FROM l JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey % 2 = 0 OR l_partkey % 5 = 0 GROUP BY 1""")
def stored_edges(spark, sf):
    """Edges from suppliers to parts in a stored graph: in two batches, between ends that are there; the last write of an
    edge counts. Parts that no batch of nodes has named have no edges."""
    line, s, p = ln.table(spark, sf, "lineitem"), ln.table(spark, sf, "supplier"), ln.table(spark, sf, "part")
    g = StoredGraph(spark, scratch(spark, "graph"), 8)
    g.add("Company", "name string, phone string", ["name"], s.select(F.col("s_name").alias("name"), F.lit("-").alias("phone"), F.lit(0).alias("seq")), F.col("name"))
    for part in (p.where("p_partkey % 2 = 0"), p.where("p_partkey % 5 = 0")):
        g.add("Part", "key string, name string", ["key"], part.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("name"), F.lit(0).alias("seq")), F.col("key"))
    names = s.select("s_suppkey", "s_name")
    rows = line.join(names, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.select(
        F.lit("Company").alias("src_label"), F.col("s_name").alias("src"), F.lit("MAKES").alias("rel"), F.lit("Part").alias("dst_label"), F.col("l_partkey").cast("string").alias("dst"),
        F.create_map(F.lit("quantity"), F.col("l_quantity").cast("bigint").cast("string")).alias("props"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_returnflag",
    )
    # A later batch overwrites an earlier one, whatever the places of its rows.
    for batch in (edges.where("l_returnflag <> 'A'"), edges.where("l_returnflag = 'A'")):
        g.connect(batch.drop("l_returnflag"))
    return g.edges.read().groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("props")["quantity"].cast("long")).alias("quantity"))


def _facts_of(key: str) -> tuple[int, str | None]:
    """The transport of the query below: a service that doesn't know every fifth key."""
    return (404, None) if int(key) % 5 == 4 else (200, f"facts of {key}")


@query("""WITH k AS (SELECT s_suppkey AS k FROM supplier), f AS (SELECT k, k % 5 <> 4 AS known, k % 3 = 0 AS first, k % 2 = 0 AND NOT (k % 3 = 0 AND k % 5 <> 4) AS second FROM k)
SELECT CAST(k AS VARCHAR) AS key, CAST(first AS INT) + CAST(second AS INT) + CAST(NOT (second AND known) AS INT) AS n_calls,
       CASE WHEN NOT known THEN NULL WHEN second THEN '2024-01-20' ELSE '2024-02-09' END AS day, CASE WHEN known THEN 'facts of ' || k END AS body FROM f""")
def cached_fetches(spark, sf):
    """Companies' facts through a cache of 30 days, wanted on three days: only what is missing or old is fetched; a call that
    got no answer is made again."""
    s = ln.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("key"))
    path = scratch(spark, "responses")
    for day, wanted in (("2024-01-01", s.where("k % 3 = 0")), ("2024-01-20", s.where("k % 2 = 0")), ("2024-02-09", s)):
        cache = fetch.Cache(spark, path, _facts_of, days=30, delay=0, now=F.lit(day).cast("timestamp"))
        # Asked for twice: what has just been fetched is no miss.
        cache.fetch(wanted)
        cache.fetch(wanted.join(cache.answers().select("key"), "key", "left_semi"))
    calls = cache.kept().groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n_calls"))
    return calls.join(cache.answers(), "key", "left").select("key", "n_calls", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"), "body")


_INDEXED = r"""c AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM c), tf AS (SELECT doc_id, dl, term, count(*) AS f FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM c) GROUP BY 1, 2, 3),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY term, n), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query, doc_id AS doc, sum(times * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN idf USING (term) JOIN q USING (term), n GROUP BY 1, 2)"""


@query(f"WITH {_INDEXED}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS n FROM s WHERE score >= 2.0) SELECT query, doc, round(score, 5) AS score FROM r WHERE n <= 15")
def indexed_top15(spark, sf):
    """Every benchmark text asked of a stored index of all documents, which was built in two additions."""
    corpus = ln.table(spark, sf, "documents").select("doc_id", text.words(F.lower("text")).alias("tokens"))
    index = TermIndex(spark, scratch(spark, "index"), "long", buckets=8)
    index.add(corpus.where("doc_id % 4 <> 1"))
    index.add(corpus.where("doc_id % 4 = 1"))
    asked = ln.table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), text.words(F.lower("text")).alias("tokens"))
    return index.search(asked, bm25.TAG_TOP, bm25.TAG_LEAST).select("query", "doc", F.round("score", 5).alias("score"))


@query(r"""WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents), t AS (SELECT * FROM d WHERE n > 30)
SELECT source AS cik, source || '_risk_' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS risk_id, printf('PEER_R%04d', row_number() OVER (ORDER BY source, doc_id)) AS citation_id, CAST(doc_id AS VARCHAR) AS risk_name FROM t""")
def recorded_peer_risks(spark, sf):
    """Structured risks of all filings, whose batches have the same numbers, from replies that an earlier run recorded."""
    batches = stored(risk_batches(spark, sf).drop("prompt"), "risk-batches").withColumn("prompt", text.numbered(F.col("paragraphs")))
    tape = replies.Recording(provider.Rules(risk_reply()), spark, scratch(spark, "tape"))
    tape.record(peers.risk_prompts(batches, "job"))
    out = peers.structured_risks(batches, provider.Recorded(tape.recorded()), "another")
    return out.where(F.col("source_text").startswith(F.col("risk_name"))).select("cik", "risk_id", "citation_id", "risk_name")


@query(f"""WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY seq, l, pos) AS n FROM items WHERE l < 2),
c AS (SELECT citation_id, type, name, (row_number() OVER (PARTITION BY type ORDER BY citation_id) - 1) % 8 + 1 AS item FROM r WHERE n = 1)
SELECT citation_id, type, name AS extracted_name, CASE WHEN item % 2 = 1 THEN 'true' ELSE 'false' END AS is_correctly_extracted, 'because' AS explanation FROM c""")
def recorded_targets(spark, sf):
    """The target's risks and metrics, judged under the same phase and numbers, each by the replies recorded for it."""
    rows = answer_rows(spark, sf)
    tape = replies.Recording(odd_items(), spark, scratch(spark, "tape"))
    evaluation.target_validation(rows, tape, "j")
    return evaluation.target_validation(rows, provider.Recorded(tape.recorded()), "k")


@query("""WITH b AS (SELECT item_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM benchmark)
SELECT 'Item ' || item_id AS title, 2 AS level, CAST(length('About ' || item_id || ' ' || t) AS BIGINT) AS text_length, md5('About ' || item_id || ' ' || t) AS body FROM b
UNION ALL SELECT 'PART I', 1, CAST(length('About ' || item_id || ' ' || t) AS BIGINT), NULL FROM b""")
def landed_sections(spark, sf):
    """Texts that are uploaded as files in two drops, half of them twice under other names: each is parsed once."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    item = F.col("item_id").cast("string")
    rows = ln.table(spark, sf, "benchmark").select("item_id", item.alias("file"), F.concat(F.lit("# PART I\n\n## Item "), item, F.lit("\n\nAbout "), item, F.lit(" "), flat).alias("value"))
    folder = scratch(spark, "uploads")
    landing = Landing(spark, folder, scratch(spark, "landed"), buckets=4)
    for k, drop in enumerate((rows.where("item_id % 2 = 0"), rows)):
        drop.select("file", "value").repartition("file").write.partitionBy("file").text(f"{folder}/{k}")
        landing.run().awaitTermination()
    return landing.sections.read().select("title", "level", "text_length", F.when(F.col("leaf"), F.md5(F.get("pages", F.lit(0))["content"].cast("binary"))).alias("body"))


@query("""SELECT p_brand AS brand, count(*) FILTER (WHERE p_size % 4 <> 0) AS pages, CAST(2 * count(*) FILTER (WHERE p_size % 4 <> 0) AS BIGINT) AS found,
  count(*) FILTER (WHERE p_size % 4 <> 0 AND p_size % 3 = 0) AS no_description, CAST(2 * count(*) FILTER (WHERE p_size % 4 <> 0) - count(*) FILTER (WHERE p_size % 4 <> 0 AND p_size % 3 = 0) AS BIGINT) AS parsed FROM part GROUP BY 1""")
def extraction_counts(spark, sf):
    """Counts that are observed while entities pass: pages with a reply, risks found, and risks without a description."""
    p = ln.table(spark, sf, "part")
    pages = p.select(F.col("p_brand").alias("doc"), F.lit("s").alias("section_title"), F.col("p_partkey").alias("source_page"), F.col("p_name").alias("content"), "p_size")
    risk = lambda name, about: F.struct(name.alias("risk_name"), about.alias("description"))
    both = F.to_json(F.array(risk(F.col("content"), F.when(F.col("p_size") % 3 == 0, " ").otherwise("d")), risk(F.lit("other"), F.lit("d"))))
    replies_ = pages.select("doc", "source_page", F.when(F.col("p_size") % 4 != 0, both).otherwise("none").alias("reply"))
    kind = entities.relation("FACES_RISK")
    raw = entities.flat(pages.drop("p_size"), replies_, kind)
    total = extraction_log.counted(raw, kind)
    seen = raw.withColumn("lacks", extraction_log.reason(kind)).groupBy(F.col("doc").alias("brand"))
    out = seen.agg(F.count_distinct("source_page").alias("pages"), F.count(F.lit(1)).alias("found"), F.count_if(F.col("lacks") == "description").alias("no_description"), F.count_if(F.col("lacks").isNull()).alias("parsed"))
    # The observed total has to be the sum of what each brand has; a brand without a reply has nought.
    summed = out.agg((F.sum("found") == total["found"]).alias("ok"))
    out = ln.table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct().join(out, "brand", "left").na.fill(0)
    return out.join(F.broadcast(summed)).withColumn("found", F.when(F.col("ok"), F.col("found"))).drop("ok")  # one row


@query("SELECT s_name AS name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45)")
def having_edges(spark, sf):
    """Companies that have an edge of a kind to something that is there."""
    s, line = ln.table(spark, sf, "supplier"), ln.table(spark, sf, "lineitem")
    names = s.select("s_suppkey", "s_name")
    nodes = s.select(F.lit("Company").alias("label"), F.col("s_name").alias("key")).unionByName(ln.table(spark, sf, "part").select(F.lit("Part").alias("label"), F.col("p_partkey").cast("string").alias("key")))
    rel = F.when(F.col("l_quantity") > 45, "SELLS_MUCH").otherwise("SELLS")
    edges = line.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select(F.lit("Company").alias("src_label"), F.col("s_name").alias("src"), rel.alias("rel"), F.lit("Part").alias("dst_label"), F.col("l_partkey").cast("string").alias("dst"))
    return graph.having_edge(nodes, edges, "SELLS_MUCH").select(F.col("key").alias("name"))


def _digest(prompt: str, _key: str) -> str:
    """The model of the query below."""
    return hashlib.md5(prompt.encode()).hexdigest()


def _busy(prompt: str, key: str) -> str:
    """The same, too busy for a third of all prompts."""
    reply = _digest(prompt, key)
    if ord(reply[0]) % 3 == 0:
        raise RuntimeError("ThrottlingException: slow down")
    return reply


@query("""WITH d AS (SELECT md5(coalesce(text, '')) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT h, n AS n_prompts, CAST(CASE WHEN ascii(substr(h, 1, 1)) % 3 = 0 THEN 2 ELSE 1 END AS INT) AS n_calls FROM d""")
def replies_asked_once(spark, sf):
    """A prompt for every document, equal ones asked together. The first run meets a service that is too busy for a third of
    the prompts; the second run asks those only."""
    path = scratch(spark, "replies")
    prompts = ln.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))
    replies.ReplyStore(spark, path, _busy, tries=1).fill(prompts)
    store = replies.ReplyStore(spark, path, _digest)
    said = store.replies(prompts).groupBy(F.col("reply").alias("h")).agg(F.count(F.lit(1)).alias("n_prompts"))
    calls = store.kept().groupBy("key").agg(F.max("reply").alias("h"), F.count(F.lit(1)).cast("int").alias("n_calls")).drop("key")
    return said.join(calls, "h")
