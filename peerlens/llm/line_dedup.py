"""Deletes later copies of repeated runs of lines: a suffix array over line ids by distributed prefix doubling, in DataFrame
functions only.

1. Every line that has words gets an id, the rank of its name (128 bits of hash) among all names. Lines that occur once
   fall out. Each line that is left begins a suffix: the sequence of ids from it to its document's end.
2. Prefix doubling orders the suffixes: the pair of the ranks of two neighbouring prefixes of 2^k ids names the prefix of
   2^(k+1) ids; the distinct pairs that occur more than once are sorted (by ranges, over all partitions), and their places
   in that order are the next ranks. Suffixes whose pair occurs once differ from all others and fall out, so each round
   has fewer rows. log2(`min_words`) rounds are enough, as will be seen.
3. Suffixes that share their first n ids stand side by side in the order: an interval of common prefix n, named by the
   ranks of its first and its last 2^k ids (2^k <= n < 2^(k+1)). The first member by place keeps its lines, and the others'
   prefixes are later copies. A run counts when its lines have `min_words` words or more; for each suffix the intervals of
   the shortest counting prefix, of all longer ones that don't count without their first line, and of counting pairs of
   lines are taken. Each line of a longer repeated run, and each two neighbours in it (between which there may be lines
   without words), lie in such a prefix of one of the run's suffixes, and such a prefix occurs wherever the run does. So
   the deletions are those of all maximal repeated runs, and `min_words` lines at most, which bounds the rounds, tell them.

Names and ranks are aggregated before they are joined to rows again, so an id that a third of all lines have is one row
there, and the join can be split on the side of the lines. Each round is written to shared storage.

Defined cases: order is by doc_id (null first), then text, then line. Rows with equal doc_id and text are one document:
all get the same result. A null text stays null; an empty one stays empty. Lines without words join runs but start and
end none. A very long text is one row of arrays while it is cut into lines and put together again; in between its lines
are rows. Other columns pass through, whatever their names; those added are text_kept, n_lines, n_removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 10


def _span(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _lines(body: Column) -> Column:
    return F.split(body, "\n", -1)


def _words(body: Column) -> Column:
    """Words in every line."""
    spaced = F.translate(body, "\t\x0b\x0c\r", "    ")
    return F.transform(_lines(spaced), lambda x: F.size(F.array_remove(F.split(x, " ", -1), "")))


def _longest(min_words: int) -> int:
    """Lines in the longest prefix that matters."""
    return max(2, min_words)


def _suffixes(docs: DataFrame, text: str, min_words: int) -> DataFrame:
    """doc_id, th (the document), i (the line's number among those with words), x1, x2 (the line's name), least and most:
    how many lines the shortest and the longest prefix have whose intervals matter (least is null where no prefix counts)."""
    body = F.col(text)
    base = docs.where(body.isNotNull() & (body != "")).select("doc_id", F.xxhash64(body).alias("th"), _lines(body).alias("line"), _words(body).alias("w"))
    worded = base.select("doc_id", "th", F.filter(F.arrays_zip("line", "w"), lambda x: x["w"] > 0).alias("z"))
    worded = worded.select("doc_id", "th", "z", F.col("z.w").alias("ws"))
    rows = F.transform(
        "z", lambda x, i: F.struct(i.alias("i"), F.xxhash64(x["line"]).alias("x1"), F.xxhash64(F.lit(7), x["line"]).alias("x2"), F.slice("ws", i + 1, _longest(min_words)).alias("next"))
    )
    each = worded.select("doc_id", "th", F.inline(rows))
    # Every line has a word, so `min_words` lines always count.
    own = [F.coalesce(F.get("next", F.lit(k)), F.lit(0)) for k in range(_longest(min_words))]
    least = F.lit(None).cast("int")
    most = F.lit(0)
    for n in range(_longest(min_words), 0, -1):
        least = F.when(sum(own[1:n], own[0]) >= min_words, n).otherwise(least)
        most = most + F.when((F.size("next") >= n) & (sum(own[1:n], F.lit(0)) < min_words), 1).otherwise(0)
    return each.select("doc_id", "th", "i", "x1", "x2", least.alias("least"), F.greatest(least, most, F.when(least == 1, F.least(F.size("next"), F.lit(2)))).alias("most"))


def _ranks(rows: DataFrame) -> DataFrame:
    """x1, x2 and r, the place in the order of (x1, x2), of every name that several rows have."""
    names = rows.where("x2 is not null").groupBy("x1", "x2").agg(F.count("*").alias("n")).where("n > 1").select("x1", "x2")
    # Numbers that rise within a partition and from one partition to the next.
    return names.repartitionByRange("x1", "x2").sortWithinPartitions("x1", "x2").withColumn("r", F.monotonically_increasing_id())


def _levels(docs: DataFrame, text: str, min_words: int) -> list[DataFrame]:
    """For k = 0, 1, ...: the suffixes whose first 2^k ids occur again, with their rank r (x1) and those of the suffixes
    that begin further on, as far as they are needed: near (an array) and x2 (2^k lines further)."""
    rows = common.stored(_suffixes(docs, text, min_words), "lines")
    levels = []
    longest = _longest(min_words)
    for k in range(longest.bit_length()):
        ranks = common.stored(_ranks(rows), "ranks")
        known = rows.select("doc_id", "th", "i", "x1", "x2", "least", "most").join(ranks, ["x1", "x2"])
        inside = Window.partitionBy("doc_id", "th").orderBy("i")
        at = [F.first("r").over(inside.rangeBetween(d, d)) for d in range(1, min(1 << k, longest - (1 << k) + 1))]
        further = F.first("r").over(inside.rangeBetween(1 << k, 1 << k))
        found = known.select("doc_id", "th", "i", "least", "most", F.col("r").alias("x1"), further.alias("x2"), F.array("r", *at).alias("near"))
        levels.append(common.stored(found, "suffixes"))
        if not k:
            common.removed(rows)
        common.removed(ranks)
        rows = levels[-1]
    return levels


def _intervals(level: DataFrame, k: int) -> DataFrame:
    """x1, x2, n (the interval's name and its depth) and the place of each member, for the depths from 2^k on."""
    low, high = F.greatest("least", F.lit(1 << k)), F.least("most", F.lit((2 << k) - 1))
    depths = F.when(F.col("least").isNotNull() & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    each = level.select("doc_id", "th", "i", "x1", "near", F.explode(depths).alias("n"))
    return each.select(F.col("x1"), F.get("near", F.col("n") - F.lit(1 << k)).alias("x2"), "n", "doc_id", "th", "i").where("x2 is not null")


def later_copies(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, key (the document) and spans (array of i, n: lines with words) of what is a later copy."""
    levels = _levels(docs, text, min_words)
    members = _intervals(levels[0], 0)
    for k, level in enumerate(levels[1:], 1):
        members = members.unionByName(_intervals(level, k))
    place = F.struct("doc_id", "th", "i")
    # Partial minima: an interval that holds a third of all rows is one row here. They are written, as only a join of two
    # exchanges can be split where one name is very frequent.
    repeated = common.stored(members.groupBy("x1", "x2", "n").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("x1", "x2", "n", "first"), "intervals")
    later = members.join(repeated, ["x1", "x2", "n"]).where(place > F.col("first"))
    spans = later.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("key")).agg(F.collect_set(F.struct("i", "n")).alias("spans"))
    out = common.stored(spans, "spans")
    for done in (*levels, repeated):
        common.removed(done)
    return out


ADDED = ("text_kept", "n_lines", "n_removed")


def line_dedup(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text_kept (the lines that stay, in order), n_lines and n_removed; columns of these names are replaced."""
    spans = later_copies(docs, text, min_words)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED]).alias("doc"), F.col("doc_id").alias("own"), F.xxhash64(F.col(text)).alias("th"))
    joined = packed.join(spans, F.col("own").eqNullSafe(F.col("id")) & (F.col("th") == F.col("key")), "left")
    body = F.col("doc")[text]
    joined = joined.select("doc", F.when(F.col("spans").isNotNull(), _without(body, F.col("spans"))).alias("cut"))
    return joined.select(
        "doc.*",
        F.coalesce(F.col("cut.kept"), body).alias("text_kept"),
        F.when(body.isNull() | (body == ""), F.lit(0)).otherwise(F.size(_lines(body))).cast("long").alias("n_lines"),
        F.coalesce(F.col("cut.n"), F.lit(0)).cast("long").alias("n_removed"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once. A column would do, but the optimiser may put its expression in its place, and
    inside a lambda that runs for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(body: Column, spans: Column) -> Column:
    """kept, n: the text without the lines of the spans (i, n: lines with words), and how many they are."""

    def cut(all_: Column, at: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform(all_["spans"], lambda s: F.sequence(F.get(at, s["i"]), F.get(at, s["i"] + s["n"] - 1)))))
        return _let(gone, lambda g: F.struct(F.array_join(F.transform(F.array_except(_span(F.size(all_["lines"])), g), lambda i: F.get(all_["lines"], i)), "\n").alias("kept"), F.size(g).alias("n")))

    given = F.struct(_lines(body).alias("lines"), _words(body).alias("w"), spans.alias("spans"))
    return _let(given, lambda x: _let(F.filter(_span(F.size(x["w"])), lambda i: F.get(x["w"], i) > 0), lambda at: cut(x, at)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, and a digest of what stays."""
    out = line_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text_kept"), F.lit("")), 256).alias("kept_sha256"))


#: Runs are compared as texts here. All runs of 10 words or more, and of 10 lines at most, that each of a longer one's lines lies in.
OP9_SQL = r"""WITH lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text <> ''),
worded AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS total
  FROM (SELECT *, len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM lines) WHERE w > 0),
runs AS (SELECT a.doc_id, a.i AS b, z.i AS e FROM worded a JOIN worded z ON z.doc_id = a.doc_id AND z.i BETWEEN a.i AND a.i + 9 AND z.total - a.total + a.w >= 10),
named AS (SELECT r.doc_id, b, e, min(pos) AS first_at, max(pos) AS last_at, string_agg(t, chr(10) ORDER BY i) AS name FROM runs r JOIN worded w ON w.doc_id = r.doc_id AND i BETWEEN b AND e GROUP BY 1, 2, 3),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, b) AS n FROM named) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first_at, last_at + 1)) AS pos FROM later),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN t END, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY 1)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""
