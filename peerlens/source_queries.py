"""Queries that write a source's files from the benchmark tables and read them with the scans, and queries over sections."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lenses as ln
from .functions import entities, numbers, text
from .operators import decisions, facts, scores, sections
from .plans import patterns
from .registry import query
from .sources import filings, shared, tables
from .streaming import steps


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the cluster shares; below the warehouse where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_files"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def files(rows: DataFrame, label: str) -> str:
    """Writes rows (file, value) as one text file each and gives the pattern that reads them."""
    return written(rows.repartition("file"), label)


def written(rows: DataFrame, label: str) -> str:
    """The same for rows that are dealt by file already."""
    path = scratch(rows.sparkSession, label)
    with shared.passing(rows.sparkSession):
        rows.write.partitionBy("file").option("compression", "gzip").text(path)
    return f"{path}/*"


def dealt_to(key: Column, rows: int, each: int, least: int = 1) -> Column:
    """The number of a file, by key, so that files of about `each` rows hold them all: files become more, not larger."""
    return F.pmod(F.xxhash64(key), F.lit(max(least, -(-rows // each))))


def json_files(rows: DataFrame, bucket: Column, label: str) -> str:
    """Rows as JSON arrays, one file for each bucket."""
    return files(rows.groupBy(bucket.cast("string").alias("file")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")), label)


@query("""SELECT p_brand AS src, 'HAS_METRIC' AS rel, p_name AS tgt, CAST(p_size AS VARCHAR) AS value, p_size AS page FROM part
UNION ALL SELECT n_name, 'OPERATES_IN', 'Industry ' || n_regionkey, NULL, NULL FROM nation""")
def relation_files(spark, sf):
    """Files of both layouts: lists of relations, and one validated relation."""
    p, n = ln.table(spark, sf, "part"), ln.table(spark, sf, "nation")

    def relation(src: Column, rel: str, tgt: Column, **more: Column) -> Column:
        props = {"value": more.pop("value")} if "value" in more else {}
        target = F.struct(F.lit("T").alias("type"), tgt.alias("name"), *[F.create_map(F.lit(k), v).alias("properties") for k, v in props.items()])
        return F.struct(F.struct(F.lit("S").alias("type"), src.alias("name")).alias("src"), target.alias("tgt"), F.lit(rel).alias("rel"), *[c.alias(k) for k, c in more.items()])

    listed = p.groupBy(F.concat_ws("-", "p_brand", dealt_to(F.col("p_partkey"), p.count(), 20_000)).alias("file")).agg(F.to_json(F.struct(F.collect_list(relation(F.col("p_brand"), "HAS_METRIC", F.col("p_name"), value=F.col("p_size").cast("string"), source_page=F.col("p_size"))).alias("relations"))).alias("value"))
    single = n.select(F.col("n_name").alias("file"), F.to_json(F.struct(relation(F.col("n_name"), "OPERATES_IN", F.concat(F.lit("Industry "), "n_regionkey")).alias("validated_relation"))).alias("value"))
    found = tables.relations(spark, files(listed.unionByName(single), "relations"))
    return found.select(F.col("src.name").alias("src"), "rel", F.col("tgt.name").alias("tgt"), F.col("tgt.properties")["value"].alias("value"), F.col("source_page").alias("page"))


@query("SELECT event_id || ':f.htm' AS id, lpad(CAST(user_id AS VARCHAR), 10, '0') AS cik, 'User ' || user_id AS name, event_type AS form, strftime(ts, '%Y-%m-%d') AS filing_date FROM events")
def search_pages(spark, sf):
    e = ln.table(spark, sf, "events")
    cik = F.lpad(F.col("user_id").cast("string"), 10, "0")
    source = F.struct(F.array(cik).alias("ciks"), F.array(F.concat(F.lit("User "), "user_id", F.lit("  (CIK "), cik, F.lit(")"))).alias("display_names"), F.col("event_type").alias("form"), F.lit("a").alias("adsh"), F.date_format("ts", "yyyy-MM-dd").alias("file_date"))
    hit = F.struct(F.concat(F.col("event_id").cast("string"), F.lit(":f.htm")).alias("_id"), source.alias("_source"))
    pages = e.groupBy(dealt_to(F.col("event_id"), e.count(), 2_500, 40).cast("string").alias("file")).agg(F.to_json(F.struct(F.struct(F.collect_list(hit).alias("hits")).alias("hits"))).alias("value"))
    return tables.search_hits(spark, files(pages, "search")).select("id", "cik", "name", "form", "filing_date")


def _fact_files(spark, sf):
    """company facts as the service gives them: taxonomy to tag to unit to entries."""
    file = dealt_to(F.col("cik").cast("string"), ln.table(spark, sf, "supplier").count(), 60, 16).cast("string")
    # Dealt by file once: all that is nested below stays where it is.
    found = shared.dealt(ln.facts(spark, sf).withColumn("file", file), "file")
    units = found.groupBy("file", "cik", "taxonomy", "tag", "unit").agg(F.collect_list(F.struct("end", "val", "fy", "fp", "form", "filed")).alias("entries"))
    content = F.struct(F.concat(F.lit("Label of "), F.first("tag")).alias("label"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("unit", "entries")))).alias("units"))
    tags = units.groupBy("file", "cik", "taxonomy", "tag").agg(content.alias("content"))
    kinds = tags.groupBy("file", "cik", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("tag", "content"))).alias("tags"))
    docs = kinds.groupBy("file", "cik").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "tags"))).alias("facts"))
    doc = F.struct(F.col("cik").cast("string").alias("cik"), F.concat(F.lit("Company "), "cik").alias("entityName"), "facts")
    return tables.company_facts(spark, written(docs.groupBy("file").agg(F.to_json(F.collect_list(doc)).alias("value")), "facts"))


@query(f"""WITH {ln.FACTS} SELECT CAST(cik AS VARCHAR) AS cik, taxonomy, tag, 'Label of ' || tag AS label, unit, CAST(dense_rank() OVER (PARTITION BY cik, taxonomy, tag ORDER BY unit) - 1 AS INT) AS unit_ord,
  count(*) AS n, max(val) AS top, min("end") AS first_end, min(fy) AS first_fy, count(*) FILTER (form = '10-K') AS annual FROM facts GROUP BY cik, taxonomy, tag, unit""")
def facts_exploded(spark, sf):
    every = facts.explode_facts(_fact_files(spark, sf))
    return every.groupBy("cik", "taxonomy", "tag", "label", "unit", "unit_ord").agg(F.count("*").alias("n"), F.max("val").alias("top"), F.min("end").alias("first_end"), F.min("fy").alias("first_fy"), F.count_if(F.col("form") == "10-K").alias("annual"))


@query(f"""WITH {ln.FACTS}, o AS (SELECT *, CASE taxonomy WHEN 'us-gaap' THEN 1 ELSE 2 END AS ord FROM facts), l AS (SELECT *, max(ord) OVER (PARTITION BY cik, tag) AS last FROM o)
SELECT cik, tag, taxonomy, count(*) AS n, max(val) AS top FROM l WHERE ord = last GROUP BY 1, 2, 3""")
def facts_last_taxonomy(spark, sf):
    rows = ln.facts(spark, sf).withColumn("ord", F.when(F.col("taxonomy") == "us-gaap", 1).otherwise(2))
    return facts.last_taxonomy(rows).groupBy("cik", "tag", "taxonomy").agg(F.count("*").alias("n"), F.max("val").alias("top"))


@query("SELECT 'Tag' || p_partkey AS tag, p_name AS label FROM part")
def taxonomy_labels(spark, sf):
    """Label linkbases, of bounded size, with a locator, an arc, a standard label and a documentation for each part."""
    p = ln.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_name")
    parts = (
        '<link:loc xlink:type="locator" xlink:href="gaap.xsd#us-gaap_Tag', F.col("k"), '" xlink:label="loc_', F.col("k"), '"/>\n<link:labelArc xlink:from="loc_', F.col("k"), '" xlink:to="lab_', F.col("k"),
        '"/>\n<link:label xlink:label="lab_', F.col("k"), '" xlink:role="http://www.xbrl.org/2003/role/label">', F.col("p_name"),
        '</link:label>\n<link:label xlink:label="lab_', F.col("k"), '" xlink:role="http://www.xbrl.org/2003/role/documentation">about it</link:label>',
    )
    body = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    file = F.concat(F.lit("labels-"), dealt_to(F.col("k"), p.count(), 20_000))
    return tables.taxonomy(spark, files(p.select(file.alias("file"), body.alias("value")), "taxonomy"))


@query("""SELECT 'C' || doc_id AS dimension, CAST(quality AS DOUBLE) AS score, 'why "' || toxic || '",' || chr(10) || 'so' AS note FROM labels
UNION ALL SELECT '(weighted)', round(avg(quality), 6), '' FROM labels""")
def results_csv_scores(spark, sf):
    """Detail rows and a summary row as CSV, read again as a scorecard and one score."""
    lb = ln.table(spark, sf, "labels")
    flag = F.when(F.col("quality") == 1, "True").otherwise("False")
    detail = lb.select(F.concat(F.lit("C"), "doc_id").alias("citation_id"), flag.alias("is_relevant"), F.concat(F.lit('why "'), "toxic", F.lit('",\nso')).alias("explanation"))
    summary = lb.agg(F.format_string("%.6f", F.avg("quality")).alias("is_relevant")).select(F.lit("** MEAN **").alias("citation_id"), "is_relevant", F.lit("").alias("explanation"))
    path = scratch(spark, "results")
    tables.write_csv(detail, summary, path)
    back = tables.results_csv(spark, path)
    one = scores.weighted(back, "context_precision").select(F.lit("(weighted)").alias("dimension"), F.round("weighted", 6).alias("score"), F.lit("").alias("note"))
    return scores.scorecard(back, "context_precision").unionByName(one)


@query("""WITH s AS (SELECT user_id AS job, list_sort(list(DISTINCT CAST(hour(ts) % 5 + 1 AS INT)) FILTER (event_type = 'purchase')) AS done FROM events GROUP BY 1)
SELECT CAST(job AS VARCHAR) AS job_id, len(coalesce(done, [])) AS n_done, CAST(list_min(list_filter([1, 2, 3, 4, 5], lambda k: NOT list_contains(coalesce(done, []), k))) AS INT) AS step FROM s""")
def job_states(spark, sf):
    """States of jobs as JSON, and the first step that each hasn't completed."""
    e = ln.table(spark, sf, "events")
    done = F.collect_set(F.when(F.col("event_type") == "purchase", (F.hour("ts") % 5 + 1).cast("int")))
    states = e.groupBy(F.col("user_id").cast("string").alias("job_id")).agg(F.sort_array(done).alias("completed_steps")).withColumn("main_company", F.concat(F.lit("C"), "job_id"))
    back = tables.job_state(spark, json_files(states, dealt_to(F.col("job_id"), e.count(), 10_000, 8), "states"))
    return back.join(steps.next_step(back.select("job_id", "completed_steps")), "job_id").select("job_id", F.size("completed_steps").cast("long").alias("n_done"), "step")


@query("SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-31' - INTERVAL 30 DAY")
def cache_fresh(spark, sf):
    """What a cache of 30 days still holds on a day."""
    cached = ln.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("cached_at"))
    return tables.fresh(cached, now=F.lit("1998-01-31").cast("timestamp")).select("k", F.date_format("cached_at", "yyyy-MM-dd").alias("day"))


@query(r"""SELECT doc_id, md5(CASE WHEN length(coalesce(text, '')) + 2 > 7 THEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') ELSE '... 5' END) AS section FROM documents""")
def item_1a_sections(spark, sf):
    """The longest risk section, behind the short one of a table of contents."""
    body = F.concat(F.lit("Item 1A. Risk Factors ... 5\nItem 1B 6\nITEM 1A RISK FACTORS\n"), F.coalesce("text", F.lit("")), F.lit("\nItem 2. Properties"))
    return ln.table(spark, sf, "documents").select("doc_id", F.md5(text.item_1a(body).cast("binary")).alias("section"))


@query("""WITH c AS (SELECT printf('%04d', n_regionkey * 100) AS code, min(n_nationkey) AS seq FROM nation WHERE n_regionkey <> 1 GROUP BY 1)
SELECT code FROM (SELECT code, row_number() OVER (ORDER BY seq) AS n FROM c) WHERE n = 2""")
def chosen_industry(spark, sf):
    """Of the distinct codes that exist, the second one is named."""
    n = ln.table(spark, sf, "nation")
    found = n.select(F.format_string("%04d", F.col("n_regionkey") * 100).alias("code"), F.col("n_nationkey").alias("seq"))
    valid = n.where("n_regionkey <> 1").select(F.format_string("%04d", F.col("n_regionkey") * 100).alias("code")).distinct()
    return decisions.chosen_industry(found, valid, spark.createDataFrame([(2,)], "n int"))


@query(f"""WITH {ln.SUPPLIERS}, {ln.PEERS}, {ln.METRICS} SELECT company, category, count(*) AS n, max(value) AS top FROM metrics
WHERE company = '{ln.TARGET}' OR company IN (SELECT name FROM peers) GROUP BY 1, 2 ORDER BY company, category LIMIT 100""")
def free_question(spark, sf):
    """Free SQL sees the target and its peers only, and gets a limit."""
    asked = "with m as (select company, category, value from graph_metrics) select company, category, count(*) as n, max(value) as top from m group by company, category order by company, category;"
    return patterns.run_sql(ln.graph(spark, sf), asked, ln.TARGET)


@query("""WITH k AS (SELECT *, p_partkey % 3 AS k FROM part), v AS (SELECT * FROM (VALUES (0, 'FACES_RISK'), (1, 'HAS_METRIC'), (2, 'OPERATES_IN')) v(k, relation))
SELECT relation, count(*) AS n, count(*) FILTER (WHERE p_size % 4 <> 0) AS n_whole FROM k JOIN v USING (k) GROUP BY 1""")
def relation_registry(spark, sf):
    """Raw entities of every registered relation, one for each part, of which every fourth by size lacks its first field."""
    out = None
    for k, name in enumerate(n for n in entities.relations() if n.isupper()):
        kind = entities.relation(name)
        fields = [c.split() for c in kind.schema.split(", ")]
        value = lambda n, t: (F.when((F.col("p_size") % 4 != 0) | F.lit(n != kind.required[0]), F.lit("1" if n in ("value", "source_index") else "x"))).cast(t).alias(n)  # noqa: B023, E731
        raw = ln.table(spark, sf, "part").where(F.col("p_partkey") % 3 == k).select(*[value(n, t) for n, t in fields])
        one = raw.agg(F.count(F.lit(1)).alias("n")).join(kind.parse(entities.required(raw, kind.required), "Acme").agg(F.count(F.lit(1)).alias("n_whole"))).select(F.lit(name).alias("relation"), "n", "n_whole")
        out = one if out is None else out.unionByName(one)
    return out


# Sections

_PARTS = r"""lines AS (SELECT doc_id AS doc, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS t FROM documents WHERE length(trim(text)) > 0),
marked AS (SELECT *, i % 3 = 0 AND regexp_matches(t, '[^ ]') AS head, CASE WHEN i % 3 = 0 THEN repeat('#', CAST(length(t) % 3 + 1 AS INT)) || ' ' || t WHEN i % 5 = 4 THEN '<<<PAGE_BREAK>>>' || chr(10) || '12' || chr(10) || '<<<PAGE_BREAK>>>' ELSE t END AS x FROM lines),
placed AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) - 1 AS pos FROM marked),
secs AS (SELECT doc, CAST(pos AS INT) AS pos, max(CASE WHEN head THEN length(t) % 3 + 1 END) AS level, regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN x END, chr(10) ORDER BY i), ''), '^\s+|\s+$', '', 'g') AS raw FROM placed WHERE pos >= 0 GROUP BY 1, 2),
leafy AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY doc ORDER BY pos) <= level, TRUE) AS leaf, list_transform(string_split(raw, '<<<PAGE_BREAK>>>'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')) AS parts FROM secs),
paged AS (SELECT *, CAST(coalesce(sum(CASE WHEN leaf THEN len(parts) ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS INT) AS first_page FROM leafy),
one AS (SELECT doc, pos, unnest(range(0, len(parts))) AS k, unnest(parts) AS content FROM paged WHERE leaf),
kept AS (SELECT * FROM one WHERE content <> '' AND NOT regexp_matches(content, '^\s*\d+\s*$')),
sized AS (SELECT doc, pos, min(k) AS lo, max(k) AS hi, sum(length(content)) AS chars, sum(len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> ''))) AS words FROM kept GROUP BY 1, 2),
pages AS (SELECT p.doc, p.pos, level, leaf, CASE WHEN leaf THEN CAST(first_page + coalesce(lo, len(parts)) AS INT) END AS start_page, CASE WHEN leaf THEN CAST(first_page + coalesce(hi, len(parts)) AS INT) END AS end_page,
  CASE WHEN leaf THEN CAST(CASE WHEN lo IS NULL THEN length(raw) ELSE chars END AS BIGINT) END AS text_length, CASE WHEN leaf THEN CAST(CASE WHEN lo IS NULL THEN len(list_filter(regexp_split_to_array(raw, '\s+'), lambda w: w <> '')) ELSE words END AS BIGINT) END AS word_count
  FROM paged p LEFT JOIN sized s ON s.doc = p.doc AND s.pos = p.pos)"""


@query(f"WITH {_PARTS} SELECT doc, pos, start_page, end_page, word_count, text_length FROM pages WHERE leaf")
def page_split_counter(spark, sf):
    out = sections.with_pages(sections.with_parents(sections.headed(ln.markdown(spark, sf))))
    return out.where("leaf").select("doc", "pos", "start_page", "end_page", "word_count", "text_length")


@query(f"""WITH RECURSIVE {_PARTS},
parents AS (SELECT a.doc, a.pos, max(b.pos) AS parent FROM pages a JOIN pages b ON b.doc = a.doc AND b.pos < a.pos AND b.level < a.level
  AND NOT EXISTS (SELECT 1 FROM pages c WHERE c.doc = a.doc AND c.pos > b.pos AND c.pos < a.pos AND c.level <= b.level) GROUP BY 1, 2),
up AS (SELECT doc, pos AS leaf_pos, parent AS above FROM parents UNION ALL SELECT up.doc, leaf_pos, p.parent FROM up JOIN parents p ON p.doc = up.doc AND p.pos = up.above),
sums AS (SELECT up.doc, above, sum(word_count) AS words, sum(text_length) AS chars FROM up JOIN pages l ON l.doc = up.doc AND l.pos = leaf_pos AND l.leaf GROUP BY 1, 2)
SELECT p.doc, p.pos, leaf, CAST(coalesce(word_count, words, 0) AS BIGINT) AS word_count, CAST(coalesce(text_length, chars, 0) AS BIGINT) AS text_length FROM pages p LEFT JOIN sums s ON s.doc = p.doc AND s.above = p.pos""")
def section_rollup(spark, sf):
    return sections.parse(ln.markdown(spark, sf)).select("doc", "pos", "leaf", "word_count", "text_length")


@query(f"""WITH {_PARTS}, p AS (SELECT o.doc, o.pos, k, content, row_number() OVER (PARTITION BY o.doc ORDER BY o.pos, k) AS n
  FROM (SELECT * FROM kept UNION ALL SELECT g.doc, g.pos, 0, raw FROM paged g WHERE leaf AND NOT EXISTS (SELECT 1 FROM kept x WHERE x.doc = g.doc AND x.pos = g.pos)) o)
SELECT doc, count(*) AS n, md5(string_agg(content, chr(10) || chr(10) ORDER BY n)) AS text FROM p WHERE n <= 4 GROUP BY 1""")
def first_pages(spark, sf):
    """The first four pages, from which a company's name is read."""
    top = sections.first_pages(sections.parse(ln.markdown(spark, sf)))
    return top.select("doc", F.col("n").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT s_suppkey, s_name AS name FROM supplier")
def company_names(spark, sf):
    """Names that a model gives in quotes, checked for placeholders."""
    reply = F.concat(F.lit(' "'), "s_name", F.lit('"\n'))
    return ln.table(spark, sf, "supplier").select("s_suppkey", sections.guarded_company(sections.company_name(reply)).alias("name"))


@query("""SELECT doc_id AS doc, 0 AS pos, 'PART I' AS title, 1 AS level, 1 AS start_page, 1 AS end_page FROM documents
UNION ALL SELECT doc_id, 1, 'Item ' || (doc_id % 9 + 1) || '. Business', 2, 2, 3 FROM documents UNION ALL SELECT doc_id, 2, 'A heading', 3, 4, 4 FROM documents""")
def html_headings(spark, sf):
    """Headings, page breaks and tables of pages made around the documents' texts."""
    clean = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(F.lit("Item "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(". Business"))
    html = F.concat(
        F.lit('<div id="DSPFiXBRLHidden">hidden</div><p>PART I</p><p>Item 4. Not bold, so it is no heading</p><div><span style="font-weight:700">'), item, F.lit("</span></div><p>Body "), clean,
        F.lit("</p><hr/><p>More <a href='x'>words</a></p><table><tr><td><div><b>Item 3. In a table</b></div></td></tr></table><div><b>"), item, F.lit("</b></div><h3>A <i>heading</i></h3><img src='x'/>end"),
    )
    filings.small_batches(spark)
    md = ln.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), filings.markdown_of(html).alias("text"))
    out = sections.with_pages(sections.with_parents(sections.headed(md)).withColumn("leaf", F.lit(True)))
    return out.select("doc", "pos", "title", "level", "start_page", "end_page")


# Batches

_FOLD = """{name} AS (SELECT k, 1 AS place, 0 AS own, CASE WHEN n >= 5000 THEN 1 ELSE 0 END AS batch, CASE WHEN n >= 5000 THEN 0 ELSE n END AS held FROM sizes WHERE place = 1
UNION ALL SELECT s.k, s.place, f.batch + CASE WHEN s.n >= 5000 AND f.held > 0 THEN 1 ELSE 0 END,
  CASE WHEN s.n >= 5000 THEN f.batch + CASE WHEN f.held > 0 THEN 1 ELSE 0 END + 1 WHEN f.held + s.n >= 5000 THEN f.batch + 1 ELSE f.batch END,
  CASE WHEN s.n >= 5000 OR f.held + s.n >= 5000 THEN 0 ELSE f.held + s.n END FROM {name} f JOIN sizes s ON s.k = f.k AND s.place = f.place + 1)"""


@query(f"""WITH RECURSIVE sizes AS (SELECT doc_id AS k, generate_subscripts(x, 1) AS place, unnest(list_transform(x, lambda s: length(s))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
{_FOLD.format(name='f')} SELECT k AS doc_id, CAST(max(own) + 1 AS INT) AS n_batches, CAST(count(*) AS INT) AS n_lines FROM f GROUP BY 1""")
def size_batches(spark, sf):
    """Batches of lines, closed at 5000 characters."""
    d = ln.table(spark, sf, "documents").select("doc_id", F.transform(F.split("text", "\n"), F.length).alias("lengths"))
    return d.select("doc_id", decisions.size_batches(F.col("lengths")).alias("b")).select("doc_id", (F.array_max("b") + 1).alias("n_batches"), F.size("b").alias("n_lines"))


@query("""WITH RECURSIVE items AS (SELECT p_brand AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS item, p_size AS n FROM part),
slices AS (SELECT k, item, unnest(range(0, n, 10)) AS start, n FROM items),
s AS (SELECT k, item, start, least(10, n - start) AS n, row_number() OVER (PARTITION BY k ORDER BY item, start) AS place FROM slices),
f AS (SELECT k, place, 0 AS call, n AS held FROM s WHERE place = 1 UNION ALL SELECT s.k, s.place, CASE WHEN f.held + s.n > 10 THEN f.call + 1 ELSE f.call END, CASE WHEN f.held + s.n > 10 THEN s.n ELSE f.held + s.n END FROM f JOIN s ON s.k = f.k AND s.place = f.place + 1)
SELECT s.k AS brand, CAST(item AS INT) AS item, CAST(start AS INT) AS start, CAST(s.n AS INT) AS n, CAST(call AS INT) AS call FROM s JOIN f ON f.k = s.k AND f.place = s.place""")
def evaluation_calls(spark, sf):
    """Evaluations of at most ten a call; items with more are cut into slices."""
    return decisions.sliced_calls(ln.table(spark, sf, "part"), ["p_brand"], ["p_partkey"], "p_size").withColumnRenamed("p_brand", "brand")


@query("""SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS padded, 'https://www.sec.gov/Archives/edgar/data/' || s_suppkey || '/' || '0001' || s_nationkey || '/f.htm' AS url,
CAST(s_suppkey AS VARCHAR) AS of_link, s_name AS clean FROM supplier WHERE s_suppkey > 0""")
def filing_links(spark, sf):
    """CIKs with and without noughts, links to filings, CIKs of links, names without their CIK."""
    s = ln.table(spark, sf, "supplier").where("s_suppkey > 0")
    padded = numbers.padded_cik(F.col("s_suppkey").cast("string"))
    return s.select(
        "s_suppkey",
        padded.alias("padded"),
        numbers.filing_url(padded, F.concat(F.lit("00-01-"), F.col("s_nationkey").cast("string")), F.lit("f.htm")).alias("url"),
        numbers.cik_of_url(F.concat(F.lit("https://data.sec.gov/api/xbrl/companyfacts/CIK"), padded, F.lit(".json"))).alias("of_link"),
        text.without_cik_suffix(F.concat("s_name", F.lit(" (CIK "), padded, F.lit(")"))).alias("clean"),
    )
