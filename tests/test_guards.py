"""What must not happen: writes and foreign companies in free SQL, mixed jobs, lost last writes, deep pages."""

import pytest
from pyspark.sql import functions as F

from peerlens.operators import decisions, dedup, facts, graph, sections
from peerlens.plans import patterns
from peerlens.sources import filings


@pytest.fixture(scope="module")
def g(spark):
    rows = lambda kind: spark.createDataFrame([(c, f"{kind} of {c}", i) for i, c in enumerate("TPQ")], "company string, name string, seq int")
    return {
        "targets": spark.createDataFrame([("T",), ("U",)], "name string"),
        "peers": spark.createDataFrame([("P",), ("Q",)], "name string"),
        "competes": spark.createDataFrame([("P", "T"), ("Q", "U")], "peer string, target string"),
        "risks": rows("risk"),
        "metrics": rows("metric"),
    }


def test_free_sql_cannot_write(spark, g):
    spark.sql("create table if not exists victim (name string) using parquet")
    for attack in (
        "with x as (select 'a' as name) insert into victim select name from x",
        "insert into victim values ('a')",
        "drop table victim",
        "create table other using parquet as select * from graph_risks",
        "from graph_risks insert into victim select name",
        "set spark.sql.shuffle.partitions = 1",
    ):
        with pytest.raises((patterns.QueryRefused, Exception)):
            patterns.run_sql(g, attack, "T")
    assert spark.table("victim").count() == 0 and not spark.catalog.tableExists("other")


def test_free_sql_sees_one_company(spark, g):
    spark.sql("create table if not exists victim (name string) using parquet")
    seen = {r.company for r in patterns.run_sql(g, "select company from graph_risks", "T").collect()}
    assert seen == {"T", "P"}
    assert [r.name for r in patterns.run_sql(g, "SELECT name FROM GRAPH_TARGETS;", "T").collect()] == ["T"]
    for attack in ("select * from victim", "with victim as (select * from victim) select * from victim", "select * from graph_risks where name in (select name from victim)", "select * from parquet.`/tmp`", "select * from graph_other"):
        with pytest.raises(patterns.QueryRefused):
            patterns.run_sql(g, attack, "T")
    # Two questions side by side keep their own views, and none is left behind.
    one, two = patterns.run_sql(g, "select company from graph_metrics", "T"), patterns.run_sql(g, "select company from graph_metrics", "U")
    assert {r.company for r in one.collect()} == {"T", "P"} and {r.company for r in two.collect()} == {"Q"}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("graph_")]


def test_free_sql_calls_no_other_code(spark, g):
    name = "peer.owned"
    for attack in (
        f"select reflect('java.lang.System', 'setProperty', '{name}', 'x')",
        f"select name from graph_risks where java_method('java.lang.System', 'setProperty', '{name}', 'x') is null",
        f"select name from graph_risks order by (select max(reflect('java.lang.System', 'setProperty', '{name}', 'x')) from graph_targets)",
        f"select transform(array(1), x -> reflect('java.lang.System', 'setProperty', '{name}', 'x')) from graph_risks",
        f"select name, count(*) over (partition by try_reflect('java.lang.System', 'setProperty', '{name}', 'x')) as n from graph_risks",
        f"select name from graph_risks group by name having max(reflect('java.lang.System', 'setProperty', '{name}', 'x')) is null",
        f"select identifier('reflect')('java.lang.System', 'setProperty', '{name}', 'x')",
        f"select system.builtin.reflect('java.lang.System', 'setProperty', '{name}', 'x')",
        "select x from graph_risks lateral view stack(1, reflect('a', 'b')) t as x",
        "select input_file_name() from graph_risks",
        "select raise_error(name) from graph_risks",
        "select * from range(10)",
    ):
        with pytest.raises(patterns.QueryRefused):
            patterns.run_sql(g, attack, "T")
    assert spark._jvm.java.lang.System.getProperty(name) is None
    ok = "select upper(name) as n, row_number() over (order by name) as k, case when company = 'T' then 1 else 0 end as own, cast(seq as string) as s from graph_risks where name like 'risk%'"
    assert patterns.run_sql(g, ok, "T").count() == 2
    assert patterns.run_sql(g, "select e from graph_risks lateral view explode(split(name, ' ')) t as e", "T").count() == 6


def test_free_sql_limits_and_repair(spark, g):
    many = g | {"risks": spark.range(300).select(F.lit("T").alias("company"), F.col("id").cast("string").alias("name"), F.col("id").alias("seq"))}
    assert patterns.run_sql(many, "select name from graph_risks", "T").count() == 100
    assert patterns.run_sql(many, "select name, collect_list(seq) as s from graph_risks group by name", "T").count() == 20
    assert patterns.run_sql(many, "select name from graph_risks limit 150", "T").count() == 150
    # A word in a text and a limit inside don't count as the result's own; one behind other parts does.
    assert patterns.run_sql(many, "select name, 'no limit' as t from graph_risks", "T").count() == 100
    assert patterns.run_sql(many, "select r.name from graph_risks r join (select name from graph_targets limit 1) t on true", "T").count() == 100
    assert patterns.run_sql(many, "with x as (select name from graph_risks limit 250) select name from x", "T").count() == 100
    assert patterns.run_sql(many, "with x as (select name from graph_risks) select name from x order by name limit 120", "T").count() == 120
    asked = []

    def write(error):
        asked.append(error)
        return "select nosuch from graph_risks" if not error else "select name from graph_risks"

    query, rows, error = patterns.run_repaired(many, write, "T")
    assert rows.count() == 100 and not error and len(asked) == 2 and "nosuch" in asked[1]
    assert patterns.run_repaired(many, lambda _: "selec", "T")[1] is None


def test_jobs_stay_apart(spark):
    rows = [(j, i, "c", f"m{i}") for j in "ab" for i in range(3)]
    both = spark.createDataFrame(rows, "job string, idx int, chunk string, name string")
    said = spark.createDataFrame([("a", 0, "REMOVE", None), ("a", 1, "MERGE", 2)], "job string, idx int, action string, merge_into int")
    left = {(r.job, r.idx) for r in decisions.apply_merges(both, said, ["job"]).collect()}
    assert left == {("a", 2), ("b", 0), ("b", 1), ("b", 2)}
    assert {(r.job, r.idx) for r in decisions.within_chunk(both, said, fix=(), job=["job"]).collect()} == left
    replies = spark.createDataFrame([("a", '[{"idx": 1, "action": "KEEP"}]'), ("b", '[{"idx": 1, "action": "REMOVE"}]')], "job string, reply string")
    assert {(r.job, r.idx, r.action) for r in decisions.parse(replies, job=["job"]).collect()} == {("a", 1, "KEEP"), ("b", 1, "REMOVE")}
    with pytest.raises(ValueError):
        graph.citation_ids(both, "X", ["idx"], [])


def test_last_edge_write_and_units(spark):
    nodes = spark.createDataFrame([("C", "a"), ("M", "m")], "label string, key string")
    new = spark.createDataFrame([("C", "a", "R", "M", "m", {"p": str(v)}, s) for v, s in ((1, 3), (2, 9), (3, 5))], graph.EDGES + ", seq int")
    old = new.where("seq = 3").drop("seq")
    assert graph.upsert_edges(old, new, nodes).first().props == {"p": "2"}
    units = spark.createDataFrame([("1", "T", "shares", 0, 1.0), ("1", "T", "EUR", 1, 2.0), ("2", "T", "shares", 0, 3.0), ("2", "T", "USD", 1, 4.0)], "cik string, tag string, unit string, unit_ord int, val double")
    assert sorted(r.val for r in facts.preferred_unit(units, ["cik", "tag"]).collect()) == [1.0, 4.0]


def test_nested_lists_with_nulls(spark):
    schema = "seq int, peer string, target_risks array<struct<risk_id:string,name:string>>, peer_risks array<struct<name:string>>"
    rows = [(1, "p", [("r", "x"), (None, None), ("", "x")], None), (2, "q", [("r", "y"), (None, "x")], [("n",), ("n",)]), (3, None, None, [("n",)])]
    got = {r.seq: r for r in dedup.nested(spark.createDataFrame(rows, schema), ["target_risks", "peer_risks"], ["risk_id", "name"], "seq").collect()}
    assert [tuple(x) for x in got[1].target_risks] == [("r", "x"), (None, None), ("", "x")] and got[1].peer_risks is None
    assert [tuple(x) for x in got[2].target_risks] == [(None, "x")] and len(got[2].peer_risks) == 1
    assert got[3].target_risks is None and len(got[3].peer_risks) == 1


def test_deep_pages(spark):
    long = " ".join(["text"] * 60)
    deep = "<div>" * 5000 + f"<p>PART I</p>{long}<b>bold</b>" + "</div>" * 5000
    assert filings.to_markdown(deep) == f"# PART I\n\n{long}**bold**\n"
    wide = "<table><tr><td>a</td><td><p>PART II</p></td></tr></table><ul><li>x<li>y</ul><h2>Two <i>words</i></h2>"
    assert filings.to_markdown(wide) == "a |\n\nPART II\n\n|\n\n* x\n* y\n\n## Two words\n"


def test_ancestors(spark):
    rows = [("d", i, k, "x") for i, k in enumerate([1, 3, 2, 4, 6, 2, 5, 1, 2])]
    got = sections.with_parents(spark.createDataFrame(rows, "doc string, pos int, level int, raw string")).orderBy("pos").collect()
    assert [r.above for r in got] == [[], [0], [0], [2, 0], [3, 2, 0], [0], [5, 0], [], [7]]
    assert all(r.parent == (r.above[0] if r.above else None) for r in got)
