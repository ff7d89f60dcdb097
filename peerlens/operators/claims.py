"""Claims and citations in answers, and the replies of judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Abbreviations that end no sentence, and starts of paragraphs and sentences that hold no claim.
ABBREVIATIONS = ("Inc", "Corp", "Ltd", "Co", "vs", "Dr", "Mr", "Mrs", "Ms", "MTI", "NL", "VALHI", "No", "Vol", "Fig", "Dept", "Div")
SKIPPED_PARAGRAPHS = ("**sources", "sources:", "- ")
SKIPPED_SENTENCES = ("**sources", "sources:", "- [", "#")
CITE = r"(?i)\[CITE:([^\]]+)\]"
UNPARSED = "Could not parse LLM response."
#: Where a sentence ends and the next begins, and the line in which a judge answers for an item.
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z(\$\-])"
VERDICT = r"(?i)^(\d+)\s*[:.)]\s*(YES|NO)\s*[-—–:]\s*(.*)"


def _starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.lower(c).startswith(p)
    return out


def sentences(c: Column) -> Column:
    """Split behind . ! ? before a capital, bracket, dollar or dash; not behind abbreviations, not inside [...]."""
    # Full stops of abbreviations, and white space within brackets, get marks that the split does not see.
    hidden = F.regexp_replace(c, rf"(?i)\b({'|'.join(ABBREVIATIONS)})\.", "$1\u0001")
    hidden = F.regexp_replace(hidden, r"(?U)\s(?=[^\[\]]*\])", "\u0002")
    parts = F.split(hidden, SENTENCE_END)
    return F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\u0001"), F.lit(".")), F.lit("\u0002"), F.lit(" ")))


def answer_sentences(answer: Column) -> Column:
    """Of all paragraphs but lists of sources."""
    paragraphs = F.filter(F.transform(F.split(answer, r"\n{2,}"), text.strip), lambda p: (p != "") & ~_starts(p, SKIPPED_PARAGRAPHS))
    split = F.flatten(F.transform(paragraphs, lambda p: F.transform(sentences(p), text.strip)))
    return F.filter(split, lambda s: (s != "") & ~_starts(s, SKIPPED_SENTENCES) & s.rlike(CITE))


def fragments(sentence: Column) -> Column:
    """(anchor, cite) for each citation: the text before it; citations side by side share one anchor."""
    texts = F.transform(F.split(sentence, CITE), text.strip)
    cites = text.citations(sentence)
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<struct<anchor:string,cite:string>>").alias("out"))
    pairs = F.zip_with(F.slice(texts, F.lit(1), F.size(cites)), cites, lambda t, c: F.struct(t.alias("t"), c.alias("c")))

    def step(a: Column, p: Column) -> Column:
        last = F.when(p["t"] != "", p["t"]).otherwise(a["last"])
        anchor = F.when(last != "", last).otherwise(text.without_citations(sentence))
        return F.struct(last.alias("last"), F.concat(a["out"], F.array(F.struct(anchor.alias("anchor"), p["c"].alias("cite")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda a: a["out"])


def claims(answers: DataFrame, registry: DataFrame, key: str = "answer_id", answer: str = "answer", one: int = 6, several: int = 4) -> DataFrame:
    """A row for each cited claim: claim_id (C001 ...), claim_text, claim_text_raw, raw_citation, resolved_citation (the id,
    or ? and the id where the registry hasn't got it), co_citations, sentence_context. A claim has `one` words or more, or
    `several` if its sentence has more than one citation."""
    s = answers.select(F.col(key), F.posexplode(answer_sentences(F.col(answer))).alias("s", "sentence"))
    s = s.withColumn("pairs", fragments(F.col("sentence")))
    many = F.size("pairs") > 1
    rows = s.select(key, "s", "sentence", many.alias("many"), "pairs", F.posexplode("pairs").alias("i", "pair"))
    raw = F.when(F.col("many"), F.col("pair.anchor")).otherwise(F.col("sentence"))
    bare = text.without_citations(raw)
    co = F.transform(F.filter("pairs", lambda p, j: (p["anchor"] == F.col("pair.anchor")) & (j != F.col("i"))), lambda p: p["cite"])
    out = rows.select(
        key,
        "s",
        "i",
        bare.alias("claim_text"),
        raw.alias("claim_text_raw"),
        F.col("pair.cite").alias("raw_citation"),
        F.when(F.col("many"), co).otherwise(F.array().cast("array<string>")).alias("co_citations"),
        text.without_citations(F.col("sentence")).alias("sentence_context"),
        "many",
    ).where(text.word_count(F.col("claim_text")) >= F.when(F.col("many"), several).otherwise(one))
    w = Window.partitionBy(key).orderBy("s", "i")
    numbered = out.withColumn("claim_id", F.format_string("C%03d", F.row_number().over(w)))
    return resolved(numbered, registry).drop("s", "i", "many")


def resolved(df: DataFrame, registry: DataFrame, raw: str = "raw_citation") -> DataFrame:
    known = registry.select(F.col("citation_id").alias("_id")).distinct()
    both = df.join(known, F.col(raw) == F.col("_id"), "left")
    return both.withColumn("resolved_citation", F.when(F.col("_id").isNotNull(), F.col(raw)).otherwise(F.concat(F.lit("?"), F.col(raw)))).drop("_id")


def verdicts(replies: DataFrame, keys: list[str], reply: str = "reply", n: str = "n") -> DataFrame:
    """Lines `3: YES - why` of each reply, for its items 1 to n: item, verdict, explanation; the last line of an item counts,
    and an item without one has failed."""
    lines = replies.select(*keys, F.col(n).alias("_n"), F.posexplode(F.split(reply, "\n")).alias("_line", "t")).withColumn("t", text.strip(F.col("t")))
    hit = lines.where(F.col("t").rlike(VERDICT)).select(
        *keys, "_line", F.regexp_extract("t", VERDICT, 1).try_cast("int").alias("item"), (F.upper(F.regexp_extract("t", VERDICT, 2)) == "YES").alias("verdict"), text.strip(F.regexp_extract("t", VERDICT, 3)).alias("explanation")
    )
    last = hit.groupBy(*keys, "item").agg(F.max_by(F.struct("verdict", "explanation"), "_line").alias("v"))
    items = replies.where(F.col(n) > 0).select(*keys, F.explode(F.sequence(F.lit(1), F.col(n))).alias("item"))
    return items.join(last, [*keys, "item"], "left").select(*keys, "item", F.coalesce("v.verdict", F.lit(False)).alias("verdict"), F.coalesce("v.explanation", F.lit(UNPARSED)).alias("explanation"))


#: The forms in which judges answer for chunk and theme, tried in this order.
PAIR_FORMS = (
    r"(?i)^(?:Chunk\s*)?(\d+)\.(\d+)(?:\.\d+)?\s*[:.)]\s*(YES|NO)\s*[-—–]?\s*(.*)",
    r"(?i)^<chunk>\.(\d+)\.(\d+)(?:\.\d+)?\s*[:.)]\s*(YES|NO)\s*[-—–]?\s*(.*)",
    r"(?i)^(?:Chunk\s*)?(\d+)\.(\d+)(?:\.\d+)?\s+(YES|NO)\s+(.*)",
    r"(?i)^(?:Chunk\s*)?(\d+)\.(\d+)(?:\.\d+)?.*?(YES|NO)(?:\s*[-—–:]\s*|\s+)(.*)",
    r"(?i)^(\d+)-(\d+)\s*[:.)]\s*(YES|NO)\s*[-—–]?\s*(.*)",
    r"(?i)^\*{0,2}(\d+)\.(\d+)\*{0,2}\s*[:.)]\s*(YES|NO)\s*[-—–]?\s*(.*)",
)


def pair_verdicts(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """chunk, theme, verdict, explanation of every line that one of the forms fits."""
    lines = replies.select(*keys, F.posexplode(F.split(reply, "\n")).alias("_line", "t")).withColumn("t", text.strip(F.col("t")))
    forms = [F.when(F.col("t").rlike(p), F.struct(*[F.regexp_extract("t", p, g).alias(x) for g, x in enumerate(("c", "h", "v", "e"), 1)])) for p in PAIR_FORMS]
    hit = lines.withColumn("m", F.coalesce(*forms)).where("m is not null")
    last = hit.groupBy(*keys, F.col("m.c").try_cast("int").alias("chunk"), F.col("m.h").try_cast("int").alias("theme")).agg(F.max_by("m", "_line").alias("m"))
    return last.select(*keys, "chunk", "theme", (F.upper("m.v") == "YES").alias("verdict"), text.strip(F.col("m.e")).alias("explanation"))


def attribution_blocks(replies: DataFrame, keys: list[str], valid: DataFrame, reply: str = "reply") -> DataFrame:
    """claim_id, used_source, correct_source, is_correct, explanation of blocks CLAIM_ID, USED_SOURCE, CORRECT_SOURCE,
    EXPLANATION, ---. Unknown ids get a question mark; the last block of a claim counts."""
    lines = replies.select(*keys, F.posexplode(F.split(reply, "\n")).alias("line", "t")).withColumn("t", text.strip(F.col("t")))
    starts = F.upper("t").startswith("CLAIM_ID:")
    w = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = lines.withColumn("block", F.count_if(starts).over(w)).where("block > 0")
    # What follows the closing dashes, up to the next block, belongs to none.
    wb = Window.partitionBy(*keys, "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("closed", F.count_if(F.col("t") == "---").over(wb)).where("closed = 0")

    def last(name: str) -> Column:
        return F.max_by(text.strip(F.regexp_extract("t", r"^[^:]*:(.*)$", 1)), F.when(F.upper("t").startswith(name + ":"), F.col("line"))).alias(name.lower())

    blocks = inside.groupBy(*keys, "block").agg(last("CLAIM_ID"), last("USED_SOURCE"), last("CORRECT_SOURCE"), last("EXPLANATION"))
    blocks = blocks.where(F.length("claim_id") > 0)
    newest = Window.partitionBy(*keys, "claim_id").orderBy(F.desc("block"))
    blocks = blocks.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "block")
    used = F.upper("used_source")
    given = F.upper("correct_source")
    better = F.when(given.startswith("NO:"), text.strip(F.substring(given, 4, 1_000_000))).otherwise(given)
    ids = valid.select(F.col("citation_id").alias("_id")).distinct()
    both = blocks.withColumns({"_used": used, "_better": better, "_given": given})
    both = both.join(ids.withColumnRenamed("_id", "_u"), F.col("_used") == F.col("_u"), "left").join(ids.withColumnRenamed("_id", "_b"), F.col("_better") == F.col("_b"), "left")
    used_id = F.when(F.col("_used").isNull(), "UNKNOWN").when((F.col("_used") == "NONE") | F.col("_u").isNotNull(), F.col("_used")).otherwise(F.concat(F.lit("?"), F.col("_used")))
    return both.select(
        *keys,
        "claim_id",
        used_id.alias("used_source"),
        F.when(F.col("_given") == "YES", used_id).when(F.col("_given") == "FABRICATED", "FABRICATED").when(F.col("_b").isNotNull(), F.col("_better")).otherwise(F.concat(F.lit("?"), F.col("_better"))).alias("correct_source"),
        F.when(F.col("_given").isNotNull(), F.col("_given") == "YES").alias("is_correct"),
        "explanation",
    )


def attributed(claims_: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """claims with used_source, correct_source and is_correct_source. Without a block: ERROR; an unresolved citation is
    never correct."""
    both = claims_.join(blocks, [*keys, "claim_id"], "left")
    unresolved = F.col("resolved_citation").startswith("?")
    return both.withColumns(
        {
            "correct_source": F.coalesce("correct_source", F.lit("ERROR")),
            "is_correct_source": F.coalesce(F.col("is_correct"), F.lit(False)) & ~unresolved,
            "used_source": F.col("resolved_citation"),
            "explanation": F.coalesce("explanation", F.lit("No reply for this claim")),
        }
    ).drop("is_correct")
