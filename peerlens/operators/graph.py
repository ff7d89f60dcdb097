"""A property graph as one DataFrame of nodes for each label and one of edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..sources.shared import dealt
from .numbering import numbered

EDGES = "src_label string, src string, rel string, dst_label string, dst string, props map<string,string>"


def upsert_nodes(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str = "seq", on_create: Sequence[str] = ()) -> DataFrame:
    """New properties overwrite old ones where they are given; of several writes to a key the last given value counts.
    Columns in on_create are only set when the node is made."""
    props = [c for c in new.columns if c not in {*keys, seq}]
    if not props:  # nodes that have a key only
        return old.join(new.select(*keys).distinct(), list(keys), "full")
    last = new.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_new_{c}") if c not in on_create else F.min_by(c, seq).alias(f"_new_{c}") for c in props])
    both = old.join(last, list(keys), "full")
    cols = [F.coalesce(f"_new_{c}", c).alias(c) if c in old.columns and c not in on_create else F.coalesce(c, f"_new_{c}").alias(c) if c in old.columns else F.col(f"_new_{c}").alias(c) for c in props]
    return both.select(*keys, *cols, *[c for c in old.columns if c not in {*keys, *props}])


def stamped(old: DataFrame, new: DataFrame, keys: Sequence[str], at: Column, seq: str = "seq") -> DataFrame:
    """upsert_nodes with created_at, set when a node is made, and updated_at, set when a later write finds it."""
    out = upsert_nodes(old, new.withColumn("created_at", at), keys, seq, on_create=("created_at",))
    found = old.select(*keys).join(new.select(*keys).distinct(), list(keys), "left_semi").withColumn("_found", F.lit(True))
    before = F.col("updated_at") if "updated_at" in old.columns else F.lit(None)
    return out.join(found, list(keys), "left").withColumn("updated_at", F.when(F.col("_found"), at).otherwise(before)).drop("_found")


def _ends(nodes: DataFrame) -> DataFrame:
    """_end (label and key in one column) of the nodes. Dealt by number, so that edges that meet them in a sort-merge join stay
    in as many tasks; in one column, as Spark deals by the key alone where labels are constants."""
    given = nodes.where(F.col("label").isNotNull() & F.col("key").isNotNull())
    return dealt(given.select(F.struct("label", "key").alias("_end")), "_end").distinct()


def _at(of: str) -> Column:
    """Whether an edge's end is the node of _ends; one without label or key is none."""
    return F.struct(F.col(f"{of}_label").alias("label"), F.col(of).alias("key")) == F.col("_end")


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """Edges whose two ends exist (nodes: label, key); equal ones once, the properties of the last write by seq counting
    (all writes without that column count as one, and the largest properties by name count)."""
    ends = _ends(nodes)
    ok = new.join(ends, _at("src"), "left_semi").join(ends, _at("dst"), "left_semi")
    written = F.col(seq).cast("long") if seq in new.columns else F.lit(0).cast("long")
    key = ["src_label", "src", "rel", "dst_label", "dst"]
    place = lambda step, at: F.struct(F.lit(step).alias("step"), at.alias("at"), F.to_json("props").alias("tie")).alias("_place")
    every = old.select(*key, "props", place(0, F.lit(0).cast("long"))).unionByName(ok.select(*key, "props", place(1, written)))
    return dealt(every, *key).groupBy(*key).agg(F.max_by("props", "_place").alias("props"))


def sic_edges(industries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, key, code, industry, sector) and edges HAS_SIC_CODE of industries (industry, sic) whose sic is given."""
    given = industries.where(F.col("sic").isNotNull())
    nodes = given.select(F.lit("SICCode").alias("label"), F.col("sic.code").alias("key"), "sic.*").dropDuplicates(["key"])
    edges = given.select(F.lit("Industry").alias("src_label"), F.col("industry").alias("src"), F.lit("HAS_SIC_CODE").alias("rel"), F.lit("SICCode").alias("dst_label"), F.col("sic.code").alias("dst"))
    return nodes, edges.distinct().withColumn("props", F.create_map().cast("map<string,string>"))


def dropped_edges(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that upsert_edges leaves out, as an end is missing."""
    ends = _ends(nodes)
    return new.join(ends, _at("src"), "left_anti").unionByName(new.join(ends, _at("src"), "left_semi").join(ends, _at("dst"), "left_anti"))


def replace_of_company(old: DataFrame, new: DataFrame, company: str = "company") -> DataFrame:
    """Rows of the companies in new are replaced as a whole."""
    return old.join(new.select(company).distinct(), company, "left_anti").unionByName(new, allowMissingColumns=True)


def having_edge(nodes: DataFrame, edges: DataFrame, rel: str, of: str = "src") -> DataFrame:
    """Nodes (label, key) at that end of some edge of the kind; the other end must exist, too."""
    there = nodes.select(F.col("label").alias("_l"), F.col("key").alias("_k"))
    far = "dst" if of == "src" else "src"
    own = edges.where(F.col("rel") == rel).join(there, (F.col(f"{far}_label") == F.col("_l")) & (F.col(far) == F.col("_k")), "left_semi")
    return nodes.join(own.select(F.col(f"{of}_label").alias("label"), F.col(of).alias("key")).distinct(), ["label", "key"], "left_semi")


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes in gone (label, key) and without their edges."""
    g = gone.select("label", "key").distinct()
    left = edges.join(g, (F.col("src_label") == F.col("label")) & (F.col("src") == F.col("key")), "left_anti")
    left = left.join(g, (F.col("dst_label") == F.col("label")) & (F.col("dst") == F.col("key")), "left_anti")
    return nodes.join(g, ["label", "key"], "left_anti"), left


def cleared(df: DataFrame) -> DataFrame:
    return df.limit(0)


def target_metrics(entities: DataFrame) -> DataFrame:
    """Parsed metrics as nodes: the concept defaults to the type, an unknown category is Other."""
    return entities.withColumns(
        {
            "gaap_concept": F.coalesce(F.when(F.length("gaap_concept") > 0, F.col("gaap_concept")), F.col("metric_type")),
            "category": numbers.known_category(F.col("category")),
        }
    )


def peer_metrics(facts: DataFrame, category_of: DataFrame) -> DataFrame:
    """Peers' facts as nodes: dollars in millions, the category from the target's metric of that type (the first by name,
    if its metrics of one type have several)."""
    joined = facts.join(category_of.groupBy("metric_type").agg(F.min("category").alias("_category")), "metric_type", "left")
    return joined.withColumns(
        {
            "value": numbers.in_millions(F.col("val"), F.col("unit")),
            "unit": F.when(F.col("unit") == "USD", "$ million").otherwise(F.col("unit")),
            "category": F.coalesce("_category", F.lit("Other")),
            "name": F.concat(F.coalesce("label", "tag"), F.lit(" ("), F.coalesce(F.col("fy").cast("string"), F.substring("end", 1, 4)), F.lit(")")),
        }
    ).drop("_category")


def competes_with(peers: DataFrame, target: DataFrame) -> DataFrame:
    """An edge from every peer to the target (one row), but for the target itself."""
    one = F.broadcast(target.select(F.col("name").alias("dst")).limit(1))
    both = peers.select(F.col("name").alias("src")).distinct().join(one)
    return both.where(F.lower(F.trim("src")) != F.lower(F.trim("dst"))).select("src", F.lit("COMPETES_WITH").alias("rel"), "dst")


def operates_in(peers: DataFrame, target_industries: DataFrame) -> DataFrame:
    """Peers take over the target's industries."""
    few = F.broadcast(target_industries.select(F.col("industry").alias("dst")).distinct())
    return peers.select(F.col("name").alias("src")).distinct().join(few).select("src", F.lit("OPERATES_IN").alias("rel"), "dst")


def without_target(candidates: DataFrame, target: DataFrame, name: str = "name") -> DataFrame:
    key = F.lower(F.trim(F.col(name)))
    return candidates.withColumn("_key", key).join(target.select(F.lower(F.trim("name")).alias("_key")), "_key", "left_anti").drop("_key")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), name, n; most frequent first."""
    n = nodes.groupBy(F.col("label").alias("name")).count().withColumn("kind", F.lit("node"))
    e = edges.groupBy(F.col("rel").alias("name")).count().withColumn("kind", F.lit("edge"))
    return n.unionByName(e).select("kind", "name", F.col("count").alias("n")).orderBy("kind", F.desc("n"), "name")


def citation_ids(df: DataFrame, prefix: str, order: Sequence[str], job: Sequence[str]) -> DataFrame:
    """citation_id: the prefix and a running number of four digits, within each job."""
    if not job:
        raise ValueError("citations are numbered within jobs; name the columns that tell them apart")
    return numbered(df, job, order, "_n").withColumn("citation_id", F.format_string(f"{prefix}%04d", "_n")).drop("_n")


def risk_ids(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return numbered(df, ["cik"], order, "_n").withColumn("risk_id", F.format_string("%s_risk_%d", F.col("cik").cast("string"), "_n")).drop("_n")
