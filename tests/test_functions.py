"""Scalar functions against fixed tables."""

from pyspark.sql import functions as F

from peerlens.functions import numbers as n
from peerlens.functions import text as t
from peerlens.functions import tokens as k


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_text(spark):
    got = values(spark, [("  a b \n",)], "c string", t.strip(F.col("c")), t.word_count(F.col("c")))
    assert got == [("a b", 2)]
    got = values(spark, [("<think>x [1]</think> Out: [1, [2]] end",), ("none",)], "c string", t.json_block(t.without_thinking(F.col("c"))))
    assert got == [("[1, [2]]",), (None,)]
    assert values(spark, [("```json\n[1]\n```",)], "c string", t.without_fences(F.col("c"))) == [("[1]",)]
    assert values(spark, [("x ```cypher\nMATCH\n``` y",), ("plain",)], "c string", t.fenced(F.col("c"))) == [("MATCH",), ("plain",)]
    assert values(spark, [("1. One\nx\n 2.  Two\n3. Three",)], "c string", t.numbered_lines(F.col("c"), 2)) == [(["One", "Two"],)]
    assert values(spark, [("ACME did. acme.co",)], "c string", t.masked(F.col("c"), F.lit("Acme"))) == [("the company did. the company.co",)]
    assert values(spark, [("short<think>long inner</think>",), ("y" * 100 + "<think>z</think>",)], "c string", t.reasoning_trace(F.col("c"))) == [("long inner",), ("y" * 100,)]
    assert values(spark, [("a [CITE:R1][cite: M2 ] b",)], "c string", t.without_citations(F.col("c")), t.citations(F.col("c"))) == [("a  b", ["R1", "M2"])]
    long = "ITEM 1A. Risk Factors toc Item 1B x Item 1A  Risk Factors the long text of risks Item 2. y"
    assert values(spark, [(long,), ("none",)], "c string", t.item_1a(F.col("c"))) == [("the long text of risks",), (t.NO_RISKS,)]
    assert values(spark, [("x" * 401,)], "c string", t.truncated(F.col("c"))) == [("x" * 400 + "…",)]
    assert values(spark, [("Acme Inc  (CIK 0001234)",)], "c string", t.without_cik_suffix(F.col("c"))) == [("Acme Inc",)]
    assert values(spark, [(["p", "q"],)], "c array<string>", t.numbered(F.col("c"))) == [("[0]\np\n\n[1]\nq",)]


def test_numbers(spark):
    urls = [("https://x/CIK0001801602.json",), ("https://x/CIK0000000000.json",), ("none",), (None,)]
    assert values(spark, urls, "c string", n.cik_of_url(F.col("c"))) == [("1801602",), ("0",), (None,), (None,)]
    pairs = [("108", "$ million", 110e6), ("100", "$ million", 110e6), ("0", "x", 0.0), ("5", "x", 0.0), ("bad", "x", 1.0)]
    got = values(spark, pairs, "v string, u string, g double", n.values_match(n.scaled(F.col("v"), F.col("u")), F.col("g")))
    assert got == [(True,), (False,), (True,), (False,), (False,)]
    assert values(spark, [("1_000",), ("1d",), ("nan",), ("1e3",), (".5",), ("-",)], "c string", n.to_number(F.col("c"))) == [(1000.0,), (None,), (None,), (1000.0,), (0.5,), (None,)]
    first, last = n.fiscal_window(F.lit(2024))
    assert [str(x) for x in values(spark, [(1,)], "i int", first, last)[0]] == ["2024-07-01", "2025-06-30"]
    vec = [([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])]
    assert values(spark, vec, "a array<double>, b array<double>", n.cosine(F.col("a"), F.col("b"))) == [(0.0,), (0.0,), (1.0,)]
    assert values(spark, [([0.1, 0.9, 0.5, 0.4],), ([],)], "a array<double>", F.round(n.top_mean(F.col("a")), 6)) == [(0.6,), (0.0,)]
    assert values(spark, [(0.7,), (0.6,), (0.4,)], "a double", n.gate(F.col("a"), 0.7, 0.5)) == [("PASS",), ("WARNING",), ("FAIL",)]
    assert values(spark, [("1,234.56789",), ("x",)], "c string", n.value_key(F.col("c"))) == [(1234.5679,), (None,)]


def test_tokens(spark):
    words = ["earnings", "operating", "liabilities", "taxes", "assets", "sales", "expenses", "series", "ties", "gas"]
    got = [r[0] for r in values(spark, [(w,) for w in words], "c string", k.stem(F.col("c")))]
    assert got == ["earn", "operat", "liabilit", "tax", "asset", "sal", "expens", "ser", "tie", "gas"]
    assert values(spark, [("The of",), ("Cost of Sales",)], "c string", k.query_tokens(F.col("c"))) == [(["the", "of"],), (["cost", "sal"],)]
    assert values(spark, [("Net  Income (Loss)",), ("Dividends",)], "c string", k.concept_keys(F.col("c"))) == [(["net income (loss)", "net income", "net income (loss)"],), (["dividends", "dividends", "dividend"],)]
    assert values(spark, [("Revenue (2023)",), ("Revenue",)], "c string", *k.metric_parts(F.col("c"))) == [("Revenue", "2023"), ("Revenue", None)]


def test_rounded_like_python(spark):
    """Also where the text of a double ends with a 5 behind the fourth place."""
    values = [k / 1_000_000 for k in range(50, 60_000, 100)] + [-0.00145, -0.00135, 0.5, 0.0, 2.00005, 1234.56785, 0.00012500000001, 1 / 3, 0.03125, 98765.43215]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", n.rounded(F.col("v"), 4).alias("r")).collect()
    assert [r.r for r in got] == [round(r.v, 4) for r in got]
    assert any(round(v, 4) != float(f"{int(v * 10_000 + 0.5) / 10_000:.4f}") for v in values[:600])
