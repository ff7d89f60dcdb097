"""Graph questions as typed plans. Every plan is bound to one target company, and every list and result is capped.

A graph is a dict of DataFrames: targets (name), peers (name), competes (peer, target), risks and metrics (company, ...,
seq), industries (company, industry), codes (industry, code).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import stored

#: Items in a list, rows in a result.
TARGET_RISKS, PEER_RISKS, TARGET_METRICS, PEER_METRICS = 15, 10, 20, 15
ROWS = {"lists": 20, "metrics": 50, "risks": 100, "all": 200}
RISK_FIELDS = ("citation_id", "risk_id", "name", "description", "why", "source_text", "document_url", "section_title", "source_page")
METRIC_FIELDS = ("citation_id", "name", "label", "gaap_concept", "value", "unit", "year", "metric_type", "xbrl_tag", "source_page", "section_title", "source_text")
TEXT_FIELDS = ("name", "description", "why", "source_text")
Graph = dict[str, DataFrame]


def capped(df: DataFrame, keys: list[str], fields: tuple[str, ...], most: int, name: str, order: str = "seq") -> DataFrame:
    """The first `most` rows of each key as an array of structs in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    top = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    item = F.struct("_n", F.struct(*[F.col(f) for f in fields if f in df.columns]).alias("item"))
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(name))


def _peers(graph: Graph, target: str) -> DataFrame:
    return graph["competes"].where(F.col("target") == target).select("peer", "target").distinct()


def _listed(rows: DataFrame, graph: Graph, target: str, by: list[str], own: tuple[tuple[str, ...], int, str], theirs: tuple[tuple[str, ...], int, str]) -> tuple[DataFrame, DataFrame]:
    """The lists of the target and of its peers (fields, how many, name), from one pass over the rows of all of them; the
    semi-join also moves below what rows aggregate. The lists are written once, as plans over answers read them often."""
    who = _peers(graph, target).select(F.col("peer").alias("company")).unionByName(rows.sparkSession.range(1).select(F.lit(target).alias("company")))
    fields = tuple(dict.fromkeys((*own[0], *theirs[0])))
    every = capped(rows.join(who, "company", "left_semi"), ["company", *by], fields, max(own[1], theirs[1]), "items")
    every = stored(every, "lists")

    def cut(side: tuple[tuple[str, ...], int, str]) -> Column:
        there = [f.name for f in every.schema["items"].dataType.elementType.fields if f.name in side[0]]
        return F.transform(F.slice("items", 1, side[1]), lambda x: F.struct(*[x[f].alias(f) for f in there])).alias(side[2])

    return (
        every.where(F.col("company") == target).select(F.col("company").alias("target"), *by, cut(own)),
        every.select(F.col("company").alias("peer"), *by, cut(theirs)),
    )


def risks(graph: Graph, target: str, topics: list[str] | None = None) -> DataFrame:
    """target, target_risks, peer, peer_risks. Without any fitting risk of the target there is no row; a peer without
    fitting risks has an empty list, and no peer at all gives one row with a null peer."""
    there = [c for c in TEXT_FIELDS if c in graph["risks"].columns]
    fitting = graph["risks"].where(text.contains_any([F.col(c) for c in there], topics or []))
    own, theirs = _listed(fitting, graph, target, [], (RISK_FIELDS, TARGET_RISKS, "target_risks"), (RISK_FIELDS, PEER_RISKS, "peer_risks"))
    # The filter sits below the outer join, so a peer without hits stays.
    both = own.join(_peers(graph, target), "target", "left").join(theirs, "peer", "left")
    empty = F.array().cast(theirs.schema["peer_risks"].dataType)
    return both.select("target", "target_risks", "peer", F.coalesce("peer_risks", empty).alias("peer_risks")).orderBy("peer").limit(ROWS["lists"])


def metrics(graph: Graph, target: str, categories: list[str] | None = None) -> DataFrame:
    """target, category, target_metrics, peer, peer_metrics: the peer's metrics of the same category."""
    rows = graph["metrics"]
    if categories:
        rows = rows.where(F.col("category").isin(*categories))
    own, theirs = _listed(rows, graph, target, ["category"], (METRIC_FIELDS, TARGET_METRICS, "target_metrics"), ((*METRIC_FIELDS, "source_url"), PEER_METRICS, "peer_metrics"))
    both = own.join(_peers(graph, target), "target", "left").join(theirs, ["peer", "category"], "left")
    empty = F.array().cast(theirs.schema["peer_metrics"].dataType)
    return both.select("target", "category", "target_metrics", "peer", F.coalesce("peer_metrics", empty).alias("peer_metrics")).orderBy("category", "peer").limit(ROWS["lists"])


def companies(graph: Graph) -> DataFrame:
    return graph["targets"].select("name").distinct().orderBy("name")


def ready(graph: Graph) -> DataFrame:
    return graph["targets"].agg(F.count("*").alias("n"), (F.count("*") > 0).alias("ready"))


def sic_codes(graph: Graph, target: str) -> DataFrame:
    """Distinct codes of the target's industries; fails if there is none."""
    codes = graph["industries"].where(F.col("company") == target).join(graph["codes"], "industry").select("code").distinct()
    none = codes.agg(F.count("*").alias("n"))
    guard = F.when(F.col("n") == 0, F.raise_error(F.lit("no industry code for the target"))).otherwise(F.lit(True))
    return codes.join(F.broadcast(none.select(guard.alias("ok")))).where("ok").select("code")


def target_metric_types(graph: Graph, target: str) -> DataFrame:
    """metric_type, year, gaap_concept: the first metric of each type; type and year come from the name where missing."""
    from ..functions.tokens import metric_parts

    kind, year = metric_parts(F.col("name"))
    own = graph["metrics"].where(F.col("company") == target).select("seq", F.coalesce("metric_type", kind).alias("metric_type"), F.coalesce("year", year).alias("year"), "gaap_concept")
    w = Window.partitionBy("metric_type").orderBy("seq")
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("metric_type", "year", "gaap_concept")


@dataclass(frozen=True)
class Question:
    """What a question asks for, as a typed plan."""

    target: str
    strategies: tuple[str, ...] = ("risks", "metrics")
    topics: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)


STRATEGIES = ("risks", "metrics")


def chosen_strategies(reply: str) -> tuple[str, ...]:
    """`metrics` alone where a router says so, else both."""
    return ("metrics",) if reply.strip().lower() == "metrics" else STRATEGIES


def strategies_of(reply: Column) -> tuple[Column, Column]:
    """The chosen and the skipped strategies of a router's replies, as lists."""
    every = F.array(*map(F.lit, STRATEGIES))
    chosen = F.when(F.lower(text.strip(F.coalesce(reply, F.lit("")))) == "metrics", F.array(F.lit("metrics"))).otherwise(every)
    return chosen, F.array_except(every, chosen)


def skipped_strategies(chosen: tuple[str, ...]) -> tuple[str, ...]:
    """All strategies but these, in their order."""
    return tuple(s for s in STRATEGIES if s not in chosen)


def ask(graph: Graph, question: Question) -> DataFrame:
    """The rows of all strategies, in order, as one table with _strategy and seq; equal rows once."""
    from ..operators import dedup

    parts = []
    for k, name in enumerate(s for s in STRATEGIES if s in question.strategies):
        rows = risks(graph, question.target, question.topics) if name == "risks" else metrics(graph, question.target, question.categories)
        w = Window.partitionBy(F.lit(1)).orderBy(F.col("peer").asc_nulls_first(), *(["category"] if name == "metrics" else []))
        parts.append(rows.withColumn("_strategy", F.lit(name)).withColumn("seq", F.row_number().over(w) + k * 1000))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return dedup.rows(out)


#: Rows of a free query that names no limit, if it collects lists and if not.
FREE_ROWS = {True: 20, False: 100}
#: Nodes of which a plan that only reads consists, as the parser names them.
_READS = frozenset(
    "Project Aggregate Filter Sort Distinct Union Except Intersect Offset GlobalLimit LocalLimit SubqueryAlias UnresolvedWith UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedInlineTable OneRowRelation Join LateralJoin Generate WithWindowDefinition CTERelationDef Pivot Unpivot".split()
)
#: The columns by which each view is cut down to what concerns one target: its own rows or its peers'.
_OWNERS = {"targets": "name", "peers": "name", "competes": "target", "risks": "company", "metrics": "company", "industries": "company"}


#: Functions that a free query may call: of values, of lists and of groups; none that reaches beyond its rows.
FUNCTIONS = frozenset(
    """count sum avg mean min max min_by max_by first last any_value median percentile percentile_approx stddev stddev_pop stddev_samp variance var_pop var_samp corr
    count_if approx_count_distinct bool_and bool_or every some any collect_list collect_set array_agg listagg string_agg mode
    row_number rank dense_rank percent_rank cume_dist ntile lag lead nth_value
    lower upper trim ltrim rtrim btrim length char_length character_length concat concat_ws substring substr left right instr locate position replace translate split split_part
    regexp_like regexp_extract regexp_extract_all regexp_replace regexp_count rlike like ilike startswith endswith contains lpad rpad initcap reverse repeat format_number format_string printf
    abs ceil ceiling floor round bround sqrt power pow exp ln log log10 log2 sign signum mod pmod greatest least try_divide try_add try_subtract try_multiply try_cast try_to_number
    coalesce nvl nvl2 nullif ifnull if isnull isnotnull isnan nanvl zeroifnull nullifzero
    year month day quarter dayofmonth dayofweek dayofyear date date_add date_sub date_diff datediff date_format date_trunc trunc to_date to_timestamp months_between add_months make_date
    array array_contains array_distinct array_join array_max array_min array_size array_sort sort_array array_union array_intersect array_except array_position array_remove arrays_zip
    cardinality size element_at get slice flatten transform filter exists forall aggregate reduce explode explode_outer posexplode posexplode_outer inline inline_outer sequence
    map map_keys map_values map_from_entries map_entries struct named_struct to_json string int bigint double float decimal boolean""".split()
)
COLLECTING = frozenset({"collect_list", "collect_set", "array_agg", "listagg", "string_agg"})


class QueryRefused(ValueError):
    pass


def _plan_nodes(plan) -> list:
    """All nodes of a parsed plan, those of its subqueries and named parts included."""
    out, left = [], [plan]
    while left:
        node = left.pop()
        out.append(node)
        for group in (node.children(), node.innerChildren()):
            left += [group.apply(i) for i in range(group.size())]
    return out


def _expressions(nodes: list) -> list:
    """All expressions of these nodes, as the parser gives them; those of subqueries are their plans' own."""
    left, out = [], []
    for node in nodes:
        every = node.expressions()
        left += [every.apply(i) for i in range(every.size())]
    while left:
        e = left.pop()
        out.append(e)
        below = e.children()
        left += [below.apply(i) for i in range(below.size())]
    return out


def called(nodes: list) -> set[str]:
    """Names of the functions that a parsed plan calls; fails where a name isn't plainly there."""
    out = set()
    for e in _expressions(nodes):
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = e.nameParts()
            out.add(".".join(parts.apply(i).lower() for i in range(parts.size())))
        elif kind == "UnresolvedGenerator":
            out.add(e.name().unquotedString().lower())
        elif "UnresolvedIdentifier" in kind or kind in ("ScalarSubqueryReference", "CallMethodViaReflection", "PythonUDF"):
            raise QueryRefused(f"{kind} is not allowed")
    return out


def checked_sql(spark, query: str, views: set[str]) -> tuple[bool, bool]:
    """Fails unless the query only reads, only these views and what it names itself, and calls allowed functions only.
    Says whether the whole result has a limit, and whether lists are collected."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    nodes = _plan_nodes(plan)
    kinds = {n.getClass().getSimpleName().rstrip("$") for n in nodes}
    if not kinds <= _READS:
        raise QueryRefused(f"only queries can be run, not {', '.join(sorted(kinds - _READS))}")
    own = set()
    for n in nodes:
        if n.getClass().getSimpleName() == "UnresolvedWith":
            pairs = n.cteRelations()
            own |= {pairs.apply(i)._1().lower() for i in range(pairs.size())}
    # Inside its own definition such a name would mean a table of the catalog.
    taken = sorted(name for name in own if name in views or spark.catalog.tableExists(name))
    named = {n.tableName().lower() for n in nodes if n.getClass().getSimpleName() == "UnresolvedRelation"}
    if taken or not named <= views | own:
        raise QueryRefused(f"no such view of the graph: {', '.join(taken or sorted(named - views - own))}")
    functions = called(nodes)
    if not functions <= FUNCTIONS:
        raise QueryRefused(f"these functions can't be called: {', '.join(sorted(functions - FUNCTIONS))}")
    top = plan
    while top.getClass().getSimpleName() in ("UnresolvedWith", "SubqueryAlias"):
        top = top.child()
    return top.getClass().getSimpleName() == "GlobalLimit", bool(functions & COLLECTING)


def isolated(graph: Graph, target: str) -> Graph:
    """Every view with only the rows of the target and of its peers."""
    peers = _peers(graph, target).select(F.col("peer").alias("_who"))
    who = peers.unionByName(graph["targets"].where(F.col("name") == target).select(F.col("name").alias("_who"))).distinct()
    out = {}
    for name, df in graph.items():
        owner = _OWNERS.get(name)
        if name in ("targets", "competes"):
            out[name] = df.where(F.col(owner) == target)
        elif owner:
            out[name] = df.join(who, F.col(owner) == F.col("_who"), "left_semi")
        else:
            out[name] = df
    return out


def run_sql(graph: Graph, query: str, target: str, **args) -> DataFrame:
    """Free SQL over the graph's views (graph_risks etc.), for one target. It must only read; each view holds the rows of
    the target and its peers only; without a limit of its own the result gets one. The views' names are those of one call,
    so questions that run side by side don't see each other's."""
    spark = graph["targets"].sparkSession
    mark = uuid.uuid4().hex[:12]
    text_ = query.strip().rstrip(";").strip()
    limited, lists = checked_sql(spark, text_, {f"graph_{name}" for name in graph})
    own = re.sub(r"(?i)\bgraph_(" + "|".join(sorted(graph)) + r")\b", lambda m: f"graph_{mark}_{m[1].lower()}", text_)
    names = {name: f"graph_{mark}_{name}" for name in graph}
    try:
        for name, df in isolated(graph, target).items():
            df.createOrReplaceTempView(names[name])
        out = spark.sql(own, args=args or None)
        return out if limited else out.limit(FREE_ROWS[lists])
    finally:
        # The plan has been resolved, so it doesn't need the names any more.
        for name in names.values():
            spark.catalog.dropTempView(name)


def run_repaired(graph: Graph, write: Callable[[str], str], target: str, tries: int = 2) -> tuple[str, DataFrame | None, str]:
    """Asks for a query (write gets the last error, empty at first) and runs it, with one more attempt after an error.
    Gives the query, its rows (None if all attempts failed) and the last error."""
    error, query = "", ""
    for _ in range(tries):
        query = write(error)
        try:
            return query, run_sql(graph, query, target), ""
        except (AnalysisException, QueryRefused) as failed:
            error = str(failed)
    return query, None, error
