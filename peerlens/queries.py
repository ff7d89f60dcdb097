"""Queries over the tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lenses as ln
from .functions import numbers, text, tokens
from .operators import bm25, claims, decisions, dedup, facts, graph, scores, sections
from .plans import patterns, qa
from .registry import ORACLE_SQL, QUERIES, query
from .sources.shared import dealt, spread
from .streaming import steps

__all__ = ["ORACLE_SQL", "QUERIES"]

# Graph questions


@query(f"""WITH {ln.SUPPLIERS}, {ln.PEERS}, {ln.METRICS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY company, category ORDER BY category || '|' || metric_type || '|' || year) AS n FROM metrics WHERE category IN ('Leverage', 'Coverage')),
own AS (SELECT category, count(*) AS n, round(sum(value), 2) AS total FROM ranked WHERE company = '{ln.TARGET}' AND n <= 20 GROUP BY 1),
theirs AS (SELECT company, category, count(*) AS n, round(sum(value), 2) AS total FROM ranked WHERE n <= 15 GROUP BY 1, 2)
SELECT '{ln.TARGET}' AS target, own.category, own.n AS n_target, own.total AS target_total, peers.name AS peer, coalesce(theirs.n, 0) AS n_peer, coalesce(theirs.total, 0) AS peer_total
FROM own LEFT JOIN peers ON TRUE LEFT JOIN theirs ON theirs.company = peers.name AND theirs.category = own.category ORDER BY category, peer LIMIT 20""")
def peer_metrics_by_category(spark, sf):
    out = patterns.metrics(ln.graph(spark, sf), ln.TARGET, ["Leverage", "Coverage"])
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x["value"]), 2)
    return out.select("target", "category", F.size("target_metrics").cast("long").alias("n_target"), total("target_metrics").alias("target_total"), "peer", F.size("peer_metrics").cast("long").alias("n_peer"), total("peer_metrics").alias("peer_total"))


_RISKS = """WITH fit AS (SELECT source AS company, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents {where}),
own AS (SELECT count(*) AS n, min(doc_id) AS first FROM fit WHERE company = 'src0' AND n <= 15 HAVING count(*) > 0),
peers AS (SELECT DISTINCT source AS peer FROM documents WHERE source <> 'src0'),
theirs AS (SELECT company, count(*) AS n, min(doc_id) AS first FROM fit WHERE n <= 10 GROUP BY 1)
SELECT 'src0' AS target, own.n AS n_target, printf('R%06d', own.first) AS first_target, peer, coalesce(theirs.n, 0) AS n_peer, printf('R%06d', theirs.first) AS first_peer
FROM own CROSS JOIN peers LEFT JOIN theirs ON theirs.company = peer ORDER BY peer LIMIT 20"""


def _flat_risks(out: DataFrame) -> DataFrame:
    return out.select("target", F.size("target_risks").cast("long").alias("n_target"), F.get("target_risks", F.lit(0))["citation_id"].alias("first_target"), "peer", F.size("peer_risks").cast("long").alias("n_peer"), F.get("peer_risks", F.lit(0))["citation_id"].alias("first_peer"))


@query(_RISKS.format(where="WHERE contains(lower(text), 'license') OR contains(lower(text), 'password')"))
def peer_risks_by_topic(spark, sf):
    return _flat_risks(patterns.risks(ln.risk_graph(spark, sf), "src0", ["license", "password"]))


@query(_RISKS.format(where=""))
def peer_risks_all(spark, sf):
    return _flat_risks(patterns.risks(ln.risk_graph(spark, sf), "src0"))


@query(f"WITH {ln.SUPPLIERS} SELECT DISTINCT printf('%04d', region * 100 + 1) AS code FROM suppliers WHERE s_suppkey = 0")
def target_sic_codes(spark, sf):
    return patterns.sic_codes(ln.graph(spark, sf), ln.TARGET)


@query(f"""WITH {ln.METRICS}, r AS (SELECT *, row_number() OVER (PARTITION BY metric_type ORDER BY category || '|' || metric_type || '|' || year) AS n FROM metrics WHERE company = '{ln.TARGET}')
SELECT metric_type, year, metric_type AS gaap_concept FROM r WHERE n = 1""")
def target_metric_types(spark, sf):
    return patterns.target_metric_types(ln.graph(spark, sf), ln.TARGET)


@query("SELECT s_name AS name FROM supplier WHERE s_suppkey = 0")
def companies(spark, sf):
    return patterns.companies(ln.graph(spark, sf))


@query("SELECT count(*) AS n, count(*) > 0 AS ready FROM supplier WHERE s_suppkey = 0")
def readiness(spark, sf):
    return patterns.ready(ln.graph(spark, sf))


def _nodes_edges(spark, sf):
    s = ln.suppliers(spark, sf)
    metric_nodes = ln.entities(spark, sf).select(F.lit("Metric").alias("label"), F.col("idx").cast("string").alias("key"))
    nodes = s.select(F.lit("Company").alias("label"), F.col("name").alias("key")).unionByName(metric_nodes)
    pairs = dealt(ln.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    props = F.create_map(F.lit("k"), F.col("l_suppkey").cast("string"))
    edges = pairs.select(F.lit("Company").alias("src_label"), F.col("name").alias("src"), F.lit("HAS_METRIC").alias("rel"), F.lit("Metric").alias("dst_label"), F.col("l_partkey").cast("string").alias("dst"), props.alias("props"))
    return nodes, edges


@query("""SELECT 'node' AS kind, 'Company' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'node', 'Metric', count(*) FROM part
UNION ALL SELECT 'edge', 'HAS_METRIC', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def graph_stats(spark, sf):
    return graph.statistics(*_nodes_edges(spark, sf))


@query("""WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_partkey % 2 = 0)
SELECT s_name AS src, count(*) AS n FROM e JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def edge_upsert(spark, sf):
    """Edges only between nodes that exist; writing them twice changes nothing."""
    nodes, edges = _nodes_edges(spark, sf)
    s = ln.suppliers(spark, sf).where("s_suppkey % 3 = 0").select("name")
    there = nodes.join(s, F.col("key") == F.col("name"), "left_anti").where("label = 'Company' or try_cast(key as long) % 2 = 0")
    once = graph.upsert_edges(edges.limit(0), edges, there)
    return graph.upsert_edges(once, edges, there).groupBy("src").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey % 4 <> 0)
SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 4 <> 0) + (SELECT count(*) FROM part) AS n_nodes, (SELECT count(*) FROM e) AS n_edges""")
def detach_delete(spark, sf):
    nodes, edges = _nodes_edges(spark, sf)
    gone = ln.suppliers(spark, sf).where("s_suppkey % 4 = 0").select(F.lit("Company").alias("label"), F.col("name").alias("key"))
    left, kept = graph.detach_delete(nodes, edges, gone)
    return left.agg(F.count("*").alias("n_nodes")).join(kept.agg(F.count("*").alias("n_edges")))


@query(f"WITH {ln.SUPPLIERS}, {ln.PEERS} SELECT name AS src, 'COMPETES_WITH' AS rel, '{ln.TARGET}' AS dst FROM peers")
def competes_with(spark, sf):
    g = ln.graph(spark, sf)
    return graph.competes_with(g["peers"].unionByName(g["targets"]), g["targets"])


@query(f"WITH {ln.SUPPLIERS}, {ln.PEERS} SELECT name AS src, 'OPERATES_IN' AS rel, 'Industry ' || (SELECT region FROM suppliers WHERE s_suppkey = 0) AS dst FROM peers")
def operates_in_edges(spark, sf):
    g = ln.graph(spark, sf)
    return graph.operates_in(g["peers"], g["industries"].where(F.col("company") == ln.TARGET))


@query("SELECT s_suppkey, upper(s_name) || ' ' AS name FROM supplier WHERE s_suppkey <> 0")
def target_exclusion(spark, sf):
    rows = ln.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.upper("s_name"), F.lit(" ")).alias("name"))
    return graph.without_target(rows, ln.graph(spark, sf)["targets"])


@query(f"WITH {ln.METRICS} SELECT s_name AS name FROM supplier WHERE EXISTS (SELECT 1 FROM metrics WHERE company = s_name AND category = 'Other')")
def exists_target_metrics(spark, sf):
    return ln.table(spark, sf, "supplier").select(F.col("s_name").alias("name")).join(ln.metrics(spark, sf).where("category = 'Other'").select("company"), F.col("name") == F.col("company"), "left_semi")


@query("""WITH old AS (SELECT p_brand AS brand, p_type AS type, count(*) AS n FROM part GROUP BY 1, 2),
new AS (SELECT p_brand AS brand, p_type AS type, max(p_partkey) AS n FROM part GROUP BY 1, 2)
SELECT coalesce(old.brand, new.brand) AS brand, coalesce(old.type, new.type) AS type, coalesce(new.n, old.n) AS n FROM old FULL JOIN new ON old.brand = new.brand AND old.type = new.type""")
def metric_upsert_last_write(spark, sf):
    """Every part is in both batches: counted in the old one, a write of its own in the new one."""
    p = ln.table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), "p_partkey")
    old = p.groupBy("brand", "type").agg(F.count("*").alias("n"))
    new = p.select("brand", "type", F.col("p_partkey").alias("n"), F.col("p_partkey").alias("seq"))
    return graph.upsert_nodes(old, new, ["brand", "type"])


@query("SELECT l_suppkey AS cik, count(*) AS n, CAST(sum(CAST(CASE WHEN l_linenumber % 4 = 0 THEN l_extendedprice + 0.003 ELSE round((l_extendedprice + 0.003) / 1000000, 4) END AS DECIMAL(18,4))) AS DOUBLE) AS total FROM lineitem GROUP BY 1")
def usd_to_million(spark, sf):
    """The tenth of a cent keeps prices off the middle between two roundings, where SQL rounds up and this engine doesn't always."""
    line = ln.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cik"), (F.col("l_extendedprice") + 0.003).alias("v"), F.when(F.col("l_linenumber") % 4 == 0, "shares").otherwise("USD").alias("unit"))
    return line.groupBy("cik").agg(F.count("*").alias("n"), F.sum(numbers.in_millions(F.col("v"), F.col("unit")).cast("decimal(18,4)")).cast("double").alias("total"))


@query("SELECT p_brand AS brand, CASE p_type WHEN 'ECONOMY' THEN 'Leverage' WHEN 'PROMO' THEN 'Coverage' WHEN 'SMALL' THEN 'Profitability' ELSE 'Other' END AS category, count(*) AS n FROM part GROUP BY 1, 2")
def category_default_other(spark, sf):
    p = ln.table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.when(F.col("p_type").isin("ECONOMY", "PROMO", "SMALL"), ln.category()).otherwise(F.col("p_type")).alias("category"), F.col("p_name").alias("metric_type"), F.lit("").alias("gaap_concept"))
    return graph.target_metrics(p).groupBy("brand", "category").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, printf('TARGET_M%04d', row_number() OVER (ORDER BY s_name DESC)) AS citation_id, printf('%d_risk_%d', s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS risk_id FROM supplier")
def citation_ids(spark, sf):
    s = ln.table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("cik"), F.lit(1).alias("job"))
    numbered = graph.citation_ids(s, "TARGET_M", [F.desc("s_name")], ["job"])
    return graph.risk_ids(numbered, ["s_suppkey"]).select("s_suppkey", "citation_id", "risk_id")


# Facts


@query(f"""WITH {ln.FACTS} SELECT cik, tag, unit, "end", val, filed FROM facts WHERE fp = 'FY' AND form = '10-K' AND "end" BETWEEN '1997-07-01' AND '1998-06-30'""")
def fiscal_window_facts(spark, sf):
    return facts.in_fiscal_year(ln.facts(spark, sf), 1997).select("cik", "tag", "unit", "end", "val", "filed")


@query(f"""WITH {ln.FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cik, tag, unit ORDER BY "end" DESC, filed, val) AS n FROM facts)
SELECT cik, tag, unit, "end", val FROM r WHERE n = 1""")
def latest_fact(spark, sf):
    return facts.latest(ln.facts(spark, sf), ["cik", "tag", "unit"], ["filed", "val"]).select("cik", "tag", "unit", "end", "val")


_TRUTH = f"""{ln.FACTS}, t AS (SELECT *, min(CASE taxonomy WHEN 'us-gaap' THEN 1 ELSE 2 END) OVER (PARTITION BY cik, tag) AS best FROM facts),
u AS (SELECT * , max(CASE WHEN unit = 'USD' THEN 1 ELSE 0 END) OVER (PARTITION BY cik, tag) AS usd FROM t WHERE (CASE taxonomy WHEN 'us-gaap' THEN 1 ELSE 2 END) = best),
y AS (SELECT DISTINCT cik, tag, unnest([CAST(fy AS VARCHAR), left("end", 4)]) AS year FROM facts),
c AS (SELECT cik, tag, year, val, unit, "end", filed, row_number() OVER (PARTITION BY cik, tag, year ORDER BY "end" DESC, filed DESC, val) AS n
  FROM u JOIN y USING (cik, tag) WHERE unit = CASE WHEN usd = 1 THEN 'USD' ELSE 'shares' END AND form IN ('10-K', '10-K/A') AND (CAST(fy AS VARCHAR) = year OR left("end", 4) = year))"""


def _truth(spark, sf):
    """For every year that a fact of the company and the tag has as its fiscal year or its end; others find nothing."""
    found = ln.facts(spark, sf)
    years = F.explode(F.array(F.col("fy").cast("string"), F.substring("end", 1, 4)))
    wanted = found.select("cik", "tag", years.alias("year")).distinct()
    return facts.ground_truth(found, wanted)


@query(f"""WITH {_TRUTH} SELECT cik, tag, year, val, unit, "end", filed FROM c WHERE n = 1""")
def ground_truth_best(spark, sf):
    return _truth(spark, sf).select("cik", "tag", "year", "val", "unit", "end", "filed")


@query(f"""WITH {_TRUTH}, ours AS (SELECT l_suppkey AS cik, p_brand AS tag, CAST(year(l_shipdate) AS VARCHAR) AS year, max(l_extendedprice) / 1000 AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
m AS (SELECT ours.year, CASE WHEN c.val IS NULL THEN 'NOT_FOUND' WHEN abs(ours.value * 1000 - c.val) / abs(c.val) <= 0.02 THEN 'MATCH' ELSE 'MISMATCH' END AS s
  FROM ours LEFT JOIN (SELECT * FROM c WHERE n = 1) c ON c.cik = ours.cik AND c.tag = ours.tag AND c.year = ours.year)
SELECT year, count(*) FILTER (s = 'MATCH') AS n_match, count(*) FILTER (s = 'MISMATCH') AS n_mismatch, count(*) FILTER (s = 'NOT_FOUND') AS n_not_found,
  round(count(*) FILTER (s = 'MATCH') / nullif(count(*) FILTER (s <> 'NOT_FOUND'), 0), 6) AS accuracy, round(count(*) FILTER (s = 'MATCH') / count(*), 6) AS score FROM m GROUP BY 1""")
def value_match_2pct(spark, sf):
    line = ln.table(spark, sf, "lineitem")
    part = ln.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("tag"))
    ours = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("cik"), "tag", F.year("l_shipdate").cast("string").alias("year"))
    ours = ours.agg((F.max("l_extendedprice") / 1000).alias("value")).withColumn("unit", F.lit("$ thousand"))
    out = facts.match_counts(facts.compare(ours, _truth(spark, sf)), ["year"])
    return out.select("year", "n_match", "n_mismatch", "n_not_found", F.round("accuracy", 6).alias("accuracy"), F.round("score", 6).alias("score"))


@query(f"""WITH {ln.FACTS}, cand AS (SELECT * FROM (VALUES ('a', 0, 0, 'Brand#3'), ('a', 0, 1, 'Brand#7'), ('a', 1, 0, 'Brand#1'), ('b', 0, 0, 'Brand#99'), ('b', 2, 0, 'Brand#5')) v(metric_type, source_rank, ordinal, tag)),
j AS (SELECT cik, metric_type, cand.tag, val, source_rank * 10 + ordinal AS r FROM cand JOIN facts ON facts.tag = cand.tag WHERE form = '10-K'),
b AS (SELECT *, min(r) OVER (PARTITION BY cik, metric_type) AS best FROM j)
SELECT cik, metric_type, tag, count(*) AS n, max(val) AS top FROM b WHERE r = best GROUP BY 1, 2, 3""")
def tag_cascade_first_hit(spark, sf):
    rows = [("a", 0, 0, "Brand#3"), ("a", 0, 1, "Brand#7"), ("a", 1, 0, "Brand#1"), ("b", 0, 0, "Brand#99"), ("b", 2, 0, "Brand#5")]
    cand = spark.createDataFrame(rows, "metric_type string, source_rank int, ordinal int, tag string")
    hit = facts.first_hit(cand, ln.facts(spark, sf).where("form = '10-K'"))
    return hit.groupBy("cik", "metric_type", "tag").agg(F.count("*").alias("n"), F.max("val").alias("top"))


@query("""WITH m AS (SELECT l_suppkey AS cik, count(DISTINCT l_partkey) AS n_metrics FROM lineitem GROUP BY 1),
r AS (SELECT CAST(replace(source, 'src', '') AS BIGINT) AS cik, count(*) AS risk_count, CAST(sum(n_chars) AS BIGINT) AS words, min(doc_id) AS seq FROM documents GROUP BY 1)
SELECT cik, n_metrics, risk_count, words FROM m JOIN r USING (cik) WHERE risk_count >= 7 AND words > 4800 ORDER BY seq LIMIT 3""")
def peers_with_both_sources(spark, sf):
    m = ln.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cik"), "l_partkey").distinct()
    d = ln.table(spark, sf, "documents").groupBy(F.replace("source", F.lit("src"), F.lit("")).cast("long").alias("cik"))
    r = d.agg(F.count("*").alias("risk_count"), F.sum("n_chars").alias("words"), F.min("doc_id").alias("seq"))
    return facts.accepted_peers(m, r).select("cik", "n_metrics", "risk_count", "words")


@query("""WITH h AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN event_id || ':x' ELSE 'y' || event_id END AS id, CASE WHEN event_type = 'click' THEN '10-K' ELSE event_type END AS form, CAST(user_id AS VARCHAR) AS cik, event_type AS adsh FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY seq) AS n FROM h WHERE form = '10-K' AND contains(id, ':')) SELECT seq, id, cik FROM r WHERE n = 1""")
def search_candidates(spark, sf):
    e = ln.table(spark, sf, "events")
    text_id = F.col("event_id").cast("string")
    hits = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.concat(text_id, F.lit(":x"))).otherwise(F.concat(F.lit("y"), text_id)).alias("id"), F.when(F.col("event_type") == "click", "10-K").otherwise(F.col("event_type")).alias("form"), F.col("user_id").cast("string").alias("cik"), F.col("event_type").alias("adsh"))
    return facts.candidates(hits).select("seq", "id", "cik")


# Distinct rows and decisions


@query("""WITH r AS (SELECT l_suppkey AS src, l_returnflag AS rel, l_partkey AS tgt, l_orderkey * 100 + l_linenumber AS seq FROM lineitem)
SELECT src, rel, tgt, min(seq) AS seq FROM r GROUP BY 1, 2, 3""")
def relation_dedup(spark, sf):
    return dedup.relations(ln.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("rel"), F.col("l_partkey").alias("tgt"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq")))


@query(f"WITH {ln.ENTITIES} SELECT lower(trim(name)) AS name, year, min(idx) AS idx FROM entities GROUP BY 1, 2")
def metric_dedup(spark, sf):
    rows = ln.entities(spark, sf).withColumn("seq", F.col("idx")).withColumn("name", F.when(F.col("idx") % 2 == 0, F.upper("name")).otherwise(F.concat(F.lit(" "), "name")))
    return dedup.metrics(rows).select(F.lower(F.trim("name")).alias("name"), "year", "idx")


@query("SELECT lower(trim(text)) AS name, min(doc_id) AS seq FROM documents GROUP BY 1")
def risk_dedup(spark, sf):
    return dedup.risks(ln.risks(spark, sf)).select(F.lower(F.trim("name")).alias("name"), "seq")


@query("SELECT p_brand, p_type, p_size, min(p_partkey) AS seq FROM part GROUP BY 1, 2, 3")
def row_dedup(spark, sf):
    p = ln.table(spark, sf, "part").select("p_brand", "p_type", "p_size", F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 2).alias("_strategy"))
    return dedup.rows(p).drop("_strategy")


@query(f"""WITH {ln.SUPPLIERS}, {ln.PEERS}, {ln.METRICS}, r AS (SELECT company, category, metric_type, row_number() OVER (PARTITION BY company, category ORDER BY category || '|' || metric_type || '|' || year) AS n FROM metrics),
rows AS (SELECT DISTINCT peers.name AS peer, c.category FROM (SELECT DISTINCT category FROM metrics WHERE company = '{ln.TARGET}') c LEFT JOIN peers ON TRUE),
lim AS (SELECT *, row_number() OVER (ORDER BY category, peer) AS k FROM rows QUALIFY k <= 20),
firsts AS (SELECT DISTINCT lim.peer, lim.category, r.metric_type, row_number() OVER (PARTITION BY lim.peer, r.metric_type ORDER BY k, r.n) AS m FROM lim JOIN r ON r.company = lim.peer AND r.category = lim.category AND r.n <= 15)
SELECT lim.peer, lim.category, count(firsts.metric_type) AS n_peer FROM lim LEFT JOIN firsts ON firsts.peer = lim.peer AND firsts.category = lim.category AND m = 1 GROUP BY 1, 2""")
def nested_dedup(spark, sf):
    """A peer's metric of one concept stays in the first row that lists it."""
    rows = patterns.metrics(ln.graph(spark, sf), ln.TARGET)
    numbered = rows.withColumn("seq", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("category", "peer")))
    return qa.deduplicated(numbered).select("peer", "category", F.size("peer_metrics").cast("long").alias("n_peer"))


@query(f"""WITH {ln.ENTITIES}, {ln.DECISIONS}, j AS (SELECT e.*, coalesce(action, 'KEEP') AS action, coalesce(merge_into, e.idx) AS target FROM entities e LEFT JOIN decisions d ON d.idx = e.idx),
s AS (SELECT CASE WHEN action = 'MERGE' AND EXISTS (SELECT 1 FROM entities x WHERE x.idx = j.target) THEN target ELSE idx END AS idx FROM j WHERE action IN ('KEEP', 'MERGE'))
SELECT idx, name FROM entities WHERE idx IN (SELECT idx FROM s)""")
def merge_decisions(spark, sf):
    return decisions.apply_merges(ln.entities(spark, sf), ln.decisions(spark, sf)).select("idx", "name")


@query(f"""WITH {ln.ENTITIES}, {ln.DECISIONS}, j AS (SELECT e.*, coalesce(action, 'KEEP') AS action, coalesce(merge_into, e.idx) AS target, d.value AS dv, d.unit AS du, count(*) OVER (PARTITION BY chunk) AS size FROM entities e LEFT JOIN decisions d ON d.idx = e.idx),
s AS (SELECT CASE WHEN action = 'MERGE' AND EXISTS (SELECT 1 FROM entities x WHERE x.idx = j.target AND x.chunk = j.chunk) THEN target ELSE idx END AS idx FROM j WHERE action <> 'REMOVE' AND size > 1)
SELECT idx, chunk, CASE WHEN action = 'FIX' AND size > 1 THEN dv ELSE value END AS value, CASE WHEN action = 'FIX' AND size > 1 THEN du ELSE unit END AS unit FROM j WHERE size = 1 OR idx IN (SELECT idx FROM s)""")
def apply_decisions(spark, sf):
    return decisions.within_chunk(ln.entities(spark, sf), ln.decisions(spark, sf)).select("idx", "chunk", "value", "unit")


@query(f"""WITH {ln.ENTITIES} SELECT year, round(CAST(value AS DOUBLE), 4) AS value_key, count(*) AS n, count(DISTINCT category) AS n_categories FROM entities GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT category) > 1""")
def cross_category_candidates(spark, sf):
    return decisions.cross_category_groups(ln.entities(spark, sf))


@query(f"WITH {ln.ENTITIES} SELECT lower(gaap_concept) AS concept, year, min(idx) AS idx FROM entities GROUP BY 1, 2")
def gaap_argmax(spark, sf):
    return decisions.best_of_concept(ln.entities(spark, sf)).select(F.lower("gaap_concept").alias("concept"), "year", "idx")


@query("SELECT s_suppkey AS idx, CAST(floor((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) / 3) AS INT) AS batch, CAST((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) % 3 AS INT) AS pos FROM supplier")
def fixed_batches(spark, sf):
    s = ln.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("idx"), "s_nationkey")
    return decisions.fixed_batches(s, 3, "idx", "s_nationkey").drop("s_nationkey")


@query("SELECT substr(md5(text), 1, 8) AS chunk_id, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def chunk_hash_groups(spark, sf):
    return ln.table(spark, sf, "documents").groupBy(text.chunk_id(F.col("text")).alias("chunk_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


# Texts


_MD = """lines AS (SELECT doc_id AS doc, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS t FROM documents WHERE length(trim(text)) > 0),
heads AS (SELECT doc, i, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS pos, CAST(length(t) % 3 + 1 AS INT) AS level, t FROM lines WHERE i % 3 = 0 AND regexp_matches(t, '[^ ]'))"""


@query(f"WITH {_MD} SELECT doc, CAST(pos AS INT) AS pos, level, trim(t) AS title FROM heads")
def md_sections(spark, sf):
    return sections.headed(ln.markdown(spark, sf)).select("doc", "pos", "level", "title")


@query(f"""WITH {_MD} SELECT a.doc, CAST(a.pos AS INT) AS pos, CAST(coalesce(max(b.pos), -1) AS INT) AS parent FROM heads a LEFT JOIN heads b ON b.doc = a.doc AND b.pos < a.pos AND b.level < a.level
AND NOT EXISTS (SELECT 1 FROM heads c WHERE c.doc = a.doc AND c.pos > b.pos AND c.pos < a.pos AND c.level <= b.level) GROUP BY 1, 2""")
def section_parent(spark, sf):
    return sections.with_parents(sections.headed(ln.markdown(spark, sf))).select("doc", "pos", F.coalesce("parent", F.lit(-1)).cast("int").alias("parent"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INT) AS words FROM documents")
def word_counts(spark, sf):
    return ln.table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
SELECT doc_id, count(*) AS n, max(length(trim(x))) AS longest FROM p WHERE len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) > 30 GROUP BY 1""")
def paragraph_split(spark, sf):
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    d = ln.table(spark, sf, "documents").select("doc_id", F.explode(text.paragraphs(body)).alias("p"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("p")).cast("long").alias("longest"))


_BM25 = """c AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM c), tf AS (SELECT doc_id, dl, term, count(*) AS f FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM c) GROUP BY 1, 2, 3),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY term, n), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT * FROM (VALUES ('a', 'the', 1), ('a', 'license', 2), ('b', 'und', 1), ('b', 'der', 1)) v(query, term, times)),
s AS (SELECT query, doc_id AS doc, sum(times * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN idf USING (term) JOIN q USING (term), n GROUP BY 1, 2)"""


def _bm25(spark, sf):
    corpus = spread(ln.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.words(F.lower("text")).alias("tokens"))
    asked = spark.createDataFrame([("a", ["the", "license", "license"], 1), ("b", ["und", "der"], 2)], "query string, tokens array<string>, ord int")
    return bm25.scores(corpus, asked), asked


@query(f"WITH {_BM25} SELECT query, doc, round(score, 6) AS score FROM s")
def bm25_scores(spark, sf):
    return _bm25(spark, sf)[0].withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS n FROM s WHERE score >= 2.0) SELECT query, doc, round(score, 6) AS score FROM r WHERE n <= 15")
def bm25_tag_top15(spark, sf):
    scored = _bm25(spark, sf)[0]
    best = bm25.top(scored.withColumns({"exact": F.col("score"), "score": F.round("score", 9)}), bm25.TAG_TOP, bm25.TAG_LEAST)
    return best.select("query", "doc", F.round("exact", 6).alias("score"))


_BEST = "ORDER BY round(score, 9) DESC, doc LIMIT 1"


@query(f"""WITH {_BM25}, a AS (SELECT * FROM s WHERE query = 'a' AND score > 1.3 {_BEST}), b AS (SELECT * FROM s WHERE query = 'b' AND score > 1.3 AND doc NOT IN (SELECT doc FROM a) {_BEST})
SELECT query, doc, round(round(score, 9), 6) AS score FROM a UNION ALL SELECT query, doc, round(round(score, 9), 6) FROM b""")
def bm25_greedy_sections(spark, sf):
    scored, asked = _bm25(spark, sf)
    return bm25.greedy(scored.withColumn("score", F.round("score", 9)), asked).withColumn("score", F.round("score", 6))


_CLEAN = [("2,118.5", "2118.5"), ("1, 234", "1234"), ("$ (45.2)", "-45.2"), ("3.5x", "3.5"), ("(1,234)", "-1234"), ("-5", "-5"), ("12%", None), ("—", None), ("N/A", None), ("0", None), ("0.00", None), ("1.234", "1234"), ("(1.234)", "-1.234"), ("1.234x", "1234"), ("1_000", "1_000"), ("1d", None), ("nan", None)]


@query(f"""WITH v AS (SELECT * FROM (VALUES {", ".join(f"({i}, {repr(b) if b else 'NULL'})" for i, (_, b) in enumerate(_CLEAN))}) v(k, value)),
p AS (SELECT p_partkey, p_partkey % {len(_CLEAN) + 1} AS k FROM part)
SELECT p_partkey, CASE WHEN p.k = {len(_CLEAN)} THEN CAST(p_partkey + 1 AS VARCHAR) ELSE value END AS value FROM p LEFT JOIN v USING (k)""")
def metric_clean(spark, sf):
    """Every part's value in one of the forms in which filings write values."""
    forms = F.array(*[F.lit(a) for a, _ in _CLEAN])
    k = (F.col("p_partkey") % (len(_CLEAN) + 1)).cast("int")
    raw = F.coalesce(F.get(forms, k), F.concat(F.lit("$ "), (F.col("p_partkey") + 1).cast("string")))
    return ln.table(spark, sf, "part").select("p_partkey", numbers.clean_value(raw).alias("value"))


@query("""WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: length(x) >= 2)) AS w FROM documents),
u AS (SELECT DISTINCT upper(left(w, 1)) || lower(substr(w, 2)) AS w FROM w)
SELECT w AS word, lower(w) || ' net of ' || 'ebitda' AS tokens FROM u""")
def camel_tokens(spark, sf):
    """Every word of the documents in a tag with an acronym behind it."""
    words = ln.table(spark, sf, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where("length(w) >= 2")
    capital = F.concat(F.upper(F.left("w", F.lit(1))), F.lower(F.substring("w", 2, 1 << 20))).alias("word")
    tag = F.concat("word", F.lit("NetOfEBITDA"))
    return words.select(capital).distinct().select("word", F.array_join(tokens.tag_tokens(tag), " ").alias("tokens"))


_STEM = "CASE WHEN suffix(w, 'ings') AND length(w) >= 7 THEN left(w, length(w) - 4) WHEN suffix(w, 'ing') AND length(w) >= 6 THEN left(w, length(w) - 3) WHEN suffix(w, 'ies') AND length(w) >= 6 THEN left(w, length(w) - 3) WHEN suffix(w, 'es') AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN suffix(w, 's') AND length(w) >= 4 THEN left(w, length(w) - 1) ELSE w END"


@query(f"WITH t AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 2)) AS w FROM documents) SELECT w AS token, {_STEM} AS stem FROM t")
def stems(spark, sf):
    words = ln.table(spark, sf, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("token")).where("length(token) >= 2").distinct()
    return words.select("token", tokens.stem(F.col("token")).alias("stem"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_block(spark, sf):
    reply = F.concat(F.lit("<think>[]</think> Here:\n```json\n["), "props", F.lit("]\n```"))
    rows = ln.table(spark, sf, "events").select("event_type", F.explode(text.json_array(text.without_thinking(reply), "struct<k:bigint>")).alias("d"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("d.k").alias("total"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 400) || '…' ELSE text END AS text FROM documents")
def truncated_rows(spark, sf):
    return qa.shortened(qa.cleaned(ln.table(spark, sf, "documents").select("doc_id", "text", F.lit("x").alias("source_text"))))


# Answers and scores


@query()
def cited_claims(spark, sf):
    registry = ln.risks(spark, sf).select("citation_id")
    return claims.claims(ln.answers(spark, sf), registry).select("answer_id", "claim_id", "claim_text", "raw_citation", "resolved_citation")


@query("""WITH l AS (SELECT conv_id, turn, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id || '-' || turn AS answer_id, lpad(CAST((conv_id * 7 + i) % 90 AS VARCHAR), 6, '0') AS n FROM l WHERE i % 2 = 0)
SELECT answer_id, 'R' || n AS raw_citation, CASE WHEN CAST(n AS INT) < 60 THEN 'R' || n ELSE '?R' || n END AS resolved_citation, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def citation_resolve(spark, sf):
    cites = ln.answers(spark, sf).select("answer_id", F.explode(text.citations(F.col("answer"))).alias("raw_citation"))
    known = spark.range(60).select(F.format_string("R%06d", "id").alias("citation_id"))
    return claims.resolved(cites, known).groupBy("answer_id", "raw_citation", "resolved_citation").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT doc_id // 10 AS batch, doc_id % 10 + 1 AS item, quality FROM labels), n AS (SELECT batch, unnest(range(1, 11)) AS item FROM (SELECT DISTINCT batch FROM b))
SELECT batch, CAST(item AS INT) AS item, coalesce(quality = 1, FALSE) AS verdict, CASE WHEN quality IS NULL THEN 'Could not parse LLM response.' ELSE 'because ' || quality END AS explanation FROM n LEFT JOIN b USING (batch, item)""")
def verdict_parse(spark, sf):
    lb = ln.table(spark, sf, "labels").select(F.expr("doc_id div 10").alias("batch"), (F.col("doc_id") % 10 + 1).alias("item"), "quality")
    line = F.concat(F.col("item").cast("string"), F.lit(": "), F.when(F.col("quality") == 1, "yes").otherwise("NO"), F.lit(" — because "), F.col("quality").cast("string"))
    replies = lb.groupBy("batch").agg(F.array_join(F.collect_list(line), "\n").alias("reply")).withColumn("n", F.lit(10))
    return claims.verdicts(replies, ["batch"])


@query("SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS n_true, round(avg(quality), 6) AS score FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def precision_by_type(spark, sf):
    rows = ln.table(spark, sf, "documents").select("doc_id", "source").join(ln.table(spark, sf, "labels"), "doc_id").withColumn("ok", F.col("quality") == 1)
    return scores.share_true(rows, "ok", "doc_id", ["source"]).withColumn("score", F.round("score", 6))


_FAITH = "CASE WHEN quality = 1 THEN 1.0 WHEN toxic = 0 AND doc_id % 2 = 0 THEN 0.0 ELSE 0.5 END"


@query(f"SELECT round(avg({_FAITH}), 6) AS score, count(*) FILTER (quality = 1) AS n_correct, count(*) FILTER (quality = 0 AND toxic = 0 AND doc_id % 2 = 0) AS n_fabricated, count(*) FILTER (quality = 0 AND NOT (toxic = 0 AND doc_id % 2 = 0)) AS n_error, count(*) AS n_claims FROM labels")
def faithfulness_score(spark, sf):
    lb = ln.table(spark, sf, "labels")
    rows = lb.select(F.col("doc_id").cast("string").alias("claim_id"), (F.col("quality") == 1).alias("is_correct_source"), F.when((F.col("toxic") == 0) & (F.col("doc_id") % 2 == 0), " fabricated ").otherwise("ERROR").alias("correct_source"))
    return scores.faithfulness(rows).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT avg(quality) AS a, avg(1 - toxic) AS b FROM labels), v AS (SELECT (a + b) / 2 AS e, a AS f, b AS p FROM q)
SELECT 'evidence_quality' AS component, CAST(0.3 AS DOUBLE) AS weight, round(e, 6) AS score, round(0.3 * e, 6) AS weighted_contribution, NULL AS gate FROM v
UNION ALL SELECT 'faithfulness', 0.25, round(f, 6), round(0.25 * f, 6), NULL FROM v UNION ALL SELECT 'context_precision', 0.25, round(p, 6), round(0.25 * p, 6), NULL FROM v
UNION ALL SELECT 'answer_relevancy', 0.2, NULL, CAST(0 AS DOUBLE), NULL FROM v
UNION ALL SELECT 'OVERALL', 1.0, round(0.3 * e + 0.25 * f + 0.25 * p, 6), round(0.3 * e + 0.25 * f + 0.25 * p, 6),
  CASE WHEN 0.3 * e + 0.25 * f + 0.25 * p >= 0.8 THEN 'PASS' WHEN 0.3 * e + 0.25 * f + 0.25 * p >= 0.65 THEN 'WARNING' ELSE 'FAIL' END FROM v""")
def overall_score(spark, sf):
    """One component is missing and counts nought."""
    q = ln.table(spark, sf, "labels").agg(F.avg("quality").alias("a"), F.avg(1 - F.col("toxic")).alias("b"))
    pairs = [("risks_validation", "a"), ("target_validation", "b"), ("faithfulness", "a"), ("context_precision", "b")]
    parts = q.select(F.inline(F.array(*[F.struct(F.lit(n).alias("component"), F.col(c).alias("score")) for n, c in pairs])))
    return scores.overall(parts).withColumns({"score": F.round("score", 6), "weighted_contribution": F.round("weighted_contribution", 6)})


@query("SELECT quality AS verdict, round(avg(length(text)), 6) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length, count(*) FILTER (length(text) > 8000) AS n_long, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def chunk_length_stats(spark, sf):
    rows = ln.table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("length")).join(ln.table(spark, sf, "labels"), "doc_id")
    return scores.chunk_lengths(rows.withColumnRenamed("quality", "verdict")).withColumn("avg_length", F.round("avg_length", 6))


@query("""WITH o AS (SELECT label, embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings x WHERE x.label = embeddings.label)),
s AS (SELECT label, list_cosine_similarity(CAST(o.e AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM o JOIN embeddings v USING (label) WHERE v.vec_id <> (SELECT min(vec_id) FROM embeddings x WHERE x.label = v.label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC) AS n FROM s) SELECT label, round(sum(s) / count(*), 6) AS score FROM r WHERE n <= 3 GROUP BY 1""")
def cosine_top3_mean(spark, sf):
    """The first vector of each label against the others of it."""
    e = ln.table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("own"), F.min("vec_id").alias("own_id"))
    rest = e.join(first.select("label", "own_id"), "label").where("vec_id <> own_id").groupBy("label").agg(F.collect_list("embedding").alias("others"))
    both = first.join(rest, "label")
    return both.select("label", F.round(scores.relevancy(F.col("own"), F.col("others"))[1], 6).alias("score"))


@query("""SELECT user_id % 7 AS job, CAST(hour(ts) % 5 + 1 AS INT) AS step, strftime(min(ts) FILTER (event_type <> 'purchase'), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) FILTER (event_type = 'purchase'), '%Y-%m-%d %H:%M:%S.%f') AS ended FROM events GROUP BY 1, 2""")
def step_event_fold(spark, sf):
    e = ln.table(spark, sf, "events")
    rows = e.select((F.col("user_id") % 7).alias("job_id"), (F.hour("ts") % 5 + 1).cast("int").alias("step"), F.when(F.col("event_type") == "purchase", "done").otherwise("running").alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return steps.folded(rows).select(F.col("job_id").alias("job"), "step", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("started", "ended")])


@query()
def html_paragraphs(spark, sf):
    """Pages as Markdown sections."""
    from .sources import filings

    filings.small_batches(spark)
    md = ln.table(spark, sf, "pages").select(F.col("page_id").alias("doc"), filings.markdown_of(F.col("html")).alias("text"))
    return sections.parse(md).select("doc", "pos", "title", "level", "word_count")


from . import answer_queries, run_queries, source_queries, store_queries  # noqa: E402, F401
