"""Numbers in filings: cleaning, units, tolerance, fiscal windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: What stands for "no value", and the categories a metric can have.
PLACEHOLDERS = ("—", "–", "-", "N/A", "n/a", "NA", "na")
KNOWN_CATEGORIES = ("Leverage", "Coverage", "Liquidity", "Profitability", "Debt Structure")
MILLION = ("$ million", "million", "$ millions")
THOUSAND = ("$ thousand", "thousand", "$ thousands")
_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def to_number(c: Column) -> Column:
    """As a double where the text is a plain decimal number, else null; nan and infinity are no values."""
    return F.when(c.rlike(_NUMBER), F.regexp_replace(c, "_", "").try_cast("double"))


def clean_value(c: Column) -> Column:
    """A reported value without signs of currency, grouping and multiples; null if it is no number or nought."""
    raw = strip(c)
    joined = F.regexp_replace(raw, r"(\d),\s+(\d)", "$1,$2")
    bare = F.regexp_replace(joined, r"(?U)[,₹#$€£¥\s]", "")
    bare = F.regexp_replace(bare, r"[xX]$", "")
    # Scans often show a grouping comma as a point.
    bare = F.when(bare.rlike(r"^\d{1,3}\.\d{3}$"), F.regexp_replace(bare, r"\.", "")).otherwise(bare)
    bare = F.regexp_replace(bare, r"^\(([0-9.]+)\)$", "-$1")
    return F.when(raw.isin(*PLACEHOLDERS) | (F.coalesce(to_number(bare), F.lit(0.0)) == 0), None).otherwise(bare)


def was_scan_fixed(c: Column) -> Column:
    """Whether clean_value took a point for a grouping comma."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"(?U)[,₹#$€£¥\s]", ""), r"[xX]$", "")
    return bare.rlike(r"^\d{1,3}\.\d{3}$")


def value_key(c: Column) -> Column:
    """A value to four places, for comparison; null if it is no number."""
    return F.round(to_number(strip(F.replace(c, F.lit(","), F.lit("")))), 4)


def known_category(c: Column) -> Column:
    return F.when(c.isin(*KNOWN_CATEGORIES), c).otherwise("Other")


def rounded(c: Column, places: int = 4) -> Column:
    """To the nearest decimal by the exact value of the double, ties to the even digit. A double that is written with a 5
    behind the last place is seldom exactly halfway; the exact product's sign tells on which side it lies."""
    scale = 10 ** (places + 1)
    half = F.rint(c * scale)
    tie = (F.pmod(F.abs(half), F.lit(10)) == 5) & (c == half / scale)
    # In two halves of its digits, whose products with the scale are exact, so the sign of the rest is, too.
    wide = c * 134_217_729.0
    high = wide - (wide - c)
    side = (high * float(scale) - half) + (c - high) * float(scale)
    down = F.floor(half / 10)
    nearest = F.when(side > 0, down + 1).when(side < 0, down).otherwise(F.when(down % 2 == 0, down).otherwise(down + 1))
    return F.when(tie, nearest / 10**places).otherwise(F.round(c, places))


def in_millions(value: Column, unit: Column) -> Column:
    return F.when(unit == "USD", rounded(value / 1_000_000, 4)).otherwise(value)


def scaled(value: Column, unit: Column) -> Column:
    u = F.lower(strip(F.coalesce(unit, F.lit(""))))
    number = to_number(F.replace(strip(value), F.lit(","), F.lit("")))
    return F.when(u.isin(*MILLION), number * 1_000_000).when(u.isin(*THOUSAND), number * 1_000).otherwise(number)


def values_match(ours: Column, truth: Column, tolerance: float = 0.02) -> Column:
    """Within the relative tolerance; nought matches nought only; null never matches."""
    return F.coalesce(F.when(truth == 0, ours == 0).otherwise(F.abs(ours - truth) / F.abs(truth) <= tolerance), F.lit(False))


def fiscal_window(fy: Column) -> tuple[Column, Column]:
    """First and last end date of a fiscal year's annual report."""
    return F.make_date(fy, F.lit(7), F.lit(1)), F.make_date(fy + 1, F.lit(6), F.lit(30))


def gate(score: Column, passed: float, warned: float) -> Column:
    return F.when(score >= passed, "PASS").when(score >= warned, "WARNING").otherwise("FAIL")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, nought if one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def top_mean(values: Column, n: int = 3) -> Column:
    top = F.slice(F.sort_array(values, asc=False), 1, n)
    return F.when(F.size(top) > 0, F.aggregate(top, F.lit(0.0), lambda s, v: s + v) / F.size(top)).otherwise(0.0)


def cik_of_url(url: Column) -> Column:
    """The CIK in a link without leading noughts; null if there is none."""
    found = F.regexp_extract(url, r"CIK0*(\d+)", 1)
    return F.when(found != "", found)


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik, 10, "0")


def filing_url(cik: Column, accession: Column, file: Column) -> Column:
    return F.format_string("https://www.sec.gov/Archives/edgar/data/%s/%s/%s", F.regexp_replace(cik, "^0+", ""), F.replace(accession, F.lit("-"), F.lit("")), file)
