"""The benchmark tables seen as filings, facts, graphs and texts, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORY = {"ECONOMY": "Leverage", "PROMO": "Coverage", "LARGE": "Liquidity", "SMALL": "Profitability", "STANDARD": "Debt Structure"}
TARGET = "Supplier#000000000"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """s_suppkey, name, region."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_name").alias("name"), F.col("n_regionkey").alias("region"))


SUPPLIERS = "suppliers AS (SELECT s_suppkey, s_name AS name, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def category(column: str = "p_type"):
    out = F.lit("Other")
    for kind, name in CATEGORY.items():
        out = F.when(F.col(column) == kind, name).otherwise(out)
    return out


CATEGORY_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY.items()) + " ELSE 'Other' END"


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """company, category, metric_type (brand), year, value, name, seq: sums of prices, exact in cents."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", category().alias("category"))
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").cast("string").alias("year"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    names = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("company"))
    both = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(names, F.col("l_suppkey") == F.col("s_suppkey"))
    # By the company's name, so that conditions on companies reach the scan of suppliers.
    summed = both.groupBy("company", "category", F.col("p_brand").alias("metric_type"), "year").agg(F.sum("price").cast("double").alias("value"))
    name = F.concat("metric_type", F.lit(" ("), "year", F.lit(")"))
    return summed.select("company", "category", "metric_type", "year", "value", name.alias("name"), F.concat_ws("|", "category", "metric_type", "year").alias("seq"), F.col("metric_type").alias("gaap_concept"))


METRICS = f"""metrics AS (
  SELECT s_name AS company, {CATEGORY_SQL} AS category, p_brand AS metric_type, CAST(year(l_shipdate) AS VARCHAR) AS year,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4)"""


def peers(spark: SparkSession, sf: str) -> DataFrame:
    """All other suppliers of the target's region."""
    s = suppliers(spark, sf)
    region = s.where(F.col("s_suppkey") == 0).select(F.col("region").alias("home"))
    return s.join(F.broadcast(region), F.col("region") == F.col("home")).where("s_suppkey <> 0").select(F.col("name"), "region")


PEERS = "peers AS (SELECT name FROM suppliers WHERE region = (SELECT region FROM suppliers WHERE s_suppkey = 0) AND s_suppkey > 0)"


def risks(spark: SparkSession, sf: str) -> DataFrame:
    """company (the source), name and description (both the whole text), seq, citation_id of every document."""
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("company"), F.col("text").alias("name"), F.col("text").alias("description"), F.col("doc_id").alias("seq"), F.format_string("R%06d", "doc_id").alias("citation_id"))


def graph(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    s = suppliers(spark, sf)
    target = s.where(F.col("s_suppkey") == 0).select("name")
    region = table(spark, sf, "region")
    return {
        "targets": target,
        "peers": peers(spark, sf).select("name"),
        "competes": peers(spark, sf).select(F.col("name").alias("peer"), F.lit(TARGET).alias("target")),
        "metrics": metrics(spark, sf),
        "industries": s.select(F.col("name").alias("company"), F.concat(F.lit("Industry "), F.col("region").cast("string")).alias("industry")),
        "codes": region.select(F.concat(F.lit("Industry "), F.col("r_regionkey").cast("string")).alias("industry"), F.format_string("%04d", F.col("r_regionkey") * 100 + 1).alias("code")),
        "risks": risks(spark, sf),
    }


def risk_graph(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All other sources are peers of src0."""
    g = graph(spark, sf)
    sources = g["risks"].where("company <> 'src0'").select(F.col("company").alias("peer")).distinct()
    return g | {"competes": sources.withColumn("target", F.lit("src0"))}


def facts(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    both = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(
        F.col("l_suppkey").alias("cik"),
        F.when(F.col("l_linenumber") % 3 == 0, "dei").otherwise("us-gaap").alias("taxonomy"),
        F.col("p_brand").alias("tag"),
        F.when(F.col("l_linenumber") % 4 == 0, "shares").otherwise("USD").alias("unit"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("end"),
        F.col("l_extendedprice").alias("val"),
        F.year("o_orderdate").alias("fy"),
        F.when(F.col("l_linestatus") == "F", "FY").otherwise("Q").alias("fp"),
        F.when(F.col("l_returnflag") == "R", "10-K").when(F.col("l_returnflag") == "A", "10-K/A").otherwise("8-K").alias("form"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"),
    )


FACTS = """facts AS (
  SELECT l_suppkey AS cik, CASE WHEN l_linenumber % 3 = 0 THEN 'dei' ELSE 'us-gaap' END AS taxonomy, p_brand AS tag,
         CASE WHEN l_linenumber % 4 = 0 THEN 'shares' ELSE 'USD' END AS unit, strftime(l_shipdate, '%Y-%m-%d') AS "end",
         l_extendedprice AS val, year(o_orderdate) AS fy, CASE WHEN l_linestatus = 'F' THEN 'FY' ELSE 'Q' END AS fp,
         CASE l_returnflag WHEN 'R' THEN '10-K' WHEN 'A' THEN '10-K/A' ELSE '8-K' END AS form,
         strftime(o_orderdate, '%Y-%m-%d') AS filed
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of parts: idx, chunk (brand), name, value, unit, year, category, gaap_concept, metric_type."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").cast("int").alias("idx"),
        F.col("p_brand").alias("chunk"),
        F.col("p_name").alias("name"),
        F.col("p_size").cast("string").alias("value"),
        F.lit("ratio").alias("unit"),
        (F.col("p_partkey") % 4 + 2020).cast("string").alias("year"),
        category().alias("category"),
        F.element_at(F.split("p_name", " "), 1).alias("gaap_concept"),
        F.col("p_name").alias("metric_type"),
    )


ENTITIES = f"""entities AS (
  SELECT CAST(p_partkey AS INT) AS idx, p_brand AS chunk, p_name AS name, CAST(p_size AS VARCHAR) AS value, 'ratio' AS unit,
         CAST(p_partkey % 4 + 2020 AS VARCHAR) AS year, {CATEGORY_SQL} AS category, string_split(p_name, ' ')[1] AS gaap_concept, p_name AS metric_type
  FROM part)"""


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """For nine parts in ten: an action by the key, a target among the next keys, some of them missing."""
    k = F.col("p_partkey")
    action = F.when(k % 7 == 0, "REMOVE").when(k % 5 == 0, "MERGE").when(k % 3 == 0, "FIX").otherwise("KEEP")
    rows = table(spark, sf, "part").where(k % 10 != 9)
    return rows.select(k.cast("int").alias("idx"), action.alias("action"), (k + F.when(k % 2 == 0, 25).otherwise(1_000_000)).cast("int").alias("merge_into"), (k % 100).cast("string").alias("value"), F.lit("USD").alias("unit"), F.lit(None).cast("string").alias("gaap_concept"), F.lit("Coverage").alias("category"), F.lit("").alias("reason"))


DECISIONS = """decisions AS (
  SELECT CAST(p_partkey AS INT) AS idx, CASE WHEN p_partkey % 7 = 0 THEN 'REMOVE' WHEN p_partkey % 5 = 0 THEN 'MERGE' WHEN p_partkey % 3 = 0 THEN 'FIX' ELSE 'KEEP' END AS action,
         CAST(p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 25 ELSE 1000000 END AS INT) AS merge_into, CAST(p_partkey % 100 AS VARCHAR) AS value, 'USD' AS unit
  FROM part WHERE p_partkey % 10 <> 9)"""


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose every third line is a heading and every fifth a page break or a page number."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), F.length(x) % 3 + 1), F.lit(" "), x)).when(i % 5 == 4, F.lit("<<<PAGE_BREAK>>>\n12\n<<<PAGE_BREAK>>>")).otherwise(x),
    )
    return table(spark, sf, "documents").where("length(trim(text)) > 0").select(F.col("doc_id").alias("doc"), F.array_join(lines, "\n").alias("text"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of the assistant with a citation behind every second line."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    cited = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(x, F.lit(" [CITE:R"), F.lpad(((F.col("conv_id") * 7 + i) % 90).cast("string"), 6, "0"), F.lit("]"))).otherwise(x))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.array_join(cited, "\n").alias("answer"))
