"""Finds and removes passages of a benchmark with a generalised suffix automaton over its items' words.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. One automaton holds all items; every
document streams through it once, and the state tells the longest match that ends at each word. A match of `window`
words, or of a whole item that is shorter, makes its words hit. Stretches of words too short for a match, since the words
around them are in no item, never reach the automaton.

The items are sent to every task only up to `block_bytes` of text at a time, whose automaton takes about 125 times that
much memory while the driver builds it and 33 times in a task (measured on a megabyte of random words); a larger benchmark is dealt into blocks, each with an
automaton of its own, and the documents pass one block after the other, adding spans. What one pass gives is written
before the next one reads it, so that no worker holds two automata. An item is never divided.

Defined cases: a null or empty text has no words and is never contaminated; null or empty items match nothing; a null
item_id counts as the empty text; items with equal ids count once; repeated rows are judged alike; a null
doc_id is passed on; with an empty benchmark nothing is hit; an empty table gives no rows; a very long text is streamed like any other, in memory that its
words need. `scan` replaces columns of docs that are called like an added one; `decontaminate` leaves all as they are.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 13
BLOCK_BYTES = 1 << 20
_NONE: tuple = ()

#: Byte by byte: letters to lower case, everything that is in no word to a space.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

SPAN = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("e", T.IntegerType())])
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """All substrings of several word sequences. State 0 is the empty one."""

    def __init__(self, items: Sequence[tuple[str, Sequence[int]]], window: int):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.own: list[set[int]] = [set()]
        self.whole: list[list[tuple[int, int]]] = [[]]
        self.names = [name for name, _ in items]
        self.shortest = min((min(len(seq), window) for _, seq in items if len(seq)), default=window)
        for k, (_, seq) in enumerate(items):
            last = 0
            for word in seq:
                last = self._extend(last, word)
        for k, (_, seq) in enumerate(items):
            self._mark(k, seq)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        # Items are looked up at states of `window` words or more only.
        for v in reversed(order):
            if self.size[self.link[v]] >= window:
                self.own[self.link[v]] |= self.own[v]
        for v in order:
            if self.link[v] > 0 and self.whole[self.link[v]]:
                self.whole[v] = self.whole[v] + self.whole[self.link[v]]
        # Most states lead to one other and belong to no item: small forms, and shared ones for what is empty.
        self.own = [tuple(s) if s and n >= window else _NONE for s, n in zip(self.own, self.size, strict=True)]
        self.whole = [tuple(w) if w else _NONE for w in self.whole]
        self.size, self.link = array("i", self.size), array("i", self.link)
        self.word, self.next = array("i", [-1] * len(self.size)), array("i", [0] * len(self.size))
        for v, step in enumerate(self.step):
            if len(step) == 1:
                ((self.word[v], self.next[v]),) = step.items()
        self.branch = {v: step for v, step in enumerate(self.step) if len(step) > 1}
        del self.step

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.own.append(set())
        self.whole.append([])
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the strings of q that are no longer than p's and one word."""
        new = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, word: int) -> int:
        q = self.step[last].get(word)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
        new = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        return new

    def _mark(self, item: int, seq: Sequence[int]) -> None:
        v = 0
        for word in seq:
            v = self.step[v][word]
            self.own[v].add(item)
        if 0 < len(seq) < self.window:
            self.whole[v].append((len(seq), item))

    def matches(self, seq: Sequence[int]) -> Iterator[tuple[int, int, set[int]]]:
        """For each place with a match: first word, place behind the last one, items."""
        v, size, least = 0, 0, self.window
        only, after, branch = self.word, self.next, self.branch
        for at, word in enumerate(seq, 1):
            while True:
                to = after[v] if only[v] == word else branch[v].get(word) if v in branch else None
                if to is not None:
                    v, size = to, size + 1
                    break
                if not v:
                    size = 0
                    break
                v = self.link[v]
                size = self.size[v]
            found: set[int] = set()
            longest = 0
            if size >= least:
                u = v
                while self.size[self.link[u]] >= least:
                    u = self.link[u]
                found, longest = set(self.own[u]), least
            for n, item in self.whole[v]:
                if n <= size:
                    found.add(item)
                    longest = max(longest, n)
            if longest:
                yield at - longest, at, found


@dataclass
class Detector:
    """What the tasks get: an automaton and the numbers of the words it knows."""

    automaton: SuffixAutomaton
    known: dict[bytes, int]

    @classmethod
    def of(cls, items: Sequence[tuple[str, bytes]], window: int) -> Detector:
        known: dict[bytes, int] = {}
        seqs = [(name, [known.setdefault(w, len(known)) for w in words(text)]) for name, text in items]
        return cls(SuffixAutomaton(seqs, window), known)

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        auto, known = self.automaton, self.known
        inside = np.fromiter(map(known.__contains__, tokens), np.int8, len(tokens))
        edges = np.flatnonzero(np.diff(inside, prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        for b, e in zip(*(x[ends - starts >= auto.shortest].tolist() for x in (starts, ends)), strict=True):
            for first, behind, found in auto.matches([known[w] for w in tokens[b:e]]):
                items.update(auto.names[k] for k in found)
                if spans and b + first <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], b + first), b + behind)
                    while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                        last = spans.pop()
                        spans[-1] = (min(last[0], spans[-1][0]), last[1])
                else:
                    spans.append((b + first, b + behind))
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _pass(docs: DataFrame, block: Sequence[tuple[str, bytes]], window: int, text: str, first: bool) -> DataFrame:
    detector = docs.sparkSession.sparkContext.broadcast(Detector.of(block, window))
    names = [n for n in docs.columns if n not in ADDED.names]
    raw = common.fresh([*docs.columns, *ADDED.names], "bytes")
    lean = docs.select(*[f"`{n}`" for n in docs.columns], common.text_bytes(f"`{text}`").alias(raw))
    schema = T.StructType([docs.schema[n] for n in names] + ADDED.fields)
    types = {"items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        scan = detector.value.scan
        for batch in common.slices(batches, raw):
            n_words, n_hit, items, spans = [], [], [], []
            before = None if first else (batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            for k, body in enumerate(common.binary_list(batch.column(raw))):
                tokens = words(body)
                found, names_ = scan(tokens)
                if before:
                    found += [(s["b"], s["e"]) for s in before[0][k]]
                    names_ |= set(before[1][k])
                found = _merged(found)
                n_words.append(len(tokens))
                n_hit.append(sum(e - b for b, e in found))
                items.append(sorted(names_))
                spans.append([{"b": b, "e": e} for b, e in found])
            added = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, types["items"]), pa.array(spans, types["spans"])]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + added, names=names + ADDED.names)

    return lean.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (ids, sorted as text) and spans (of hit words: first, behind the last)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), common.text_bytes().alias("body"), F.length(common.text_bytes()).alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("body"), F.lit(blocks)))
    names = [c for c in docs.columns if c not in ADDED.names]
    out = docs.select(*[f"`{c}`" for c in names])
    for k in range(blocks):
        # At most about block_bytes reach the driver at a time.
        part = [(r["name"], bytes(r["body"])) for r in dealt.where(F.col("block") == k).collect()]
        before, out = out, _pass(out, part, window, text, first=not k)
        if k < blocks - 1:
            out = common.stored(out, "scanned")
            if k:
                common.removed(before)
    return out


def contaminated():
    """The rule: some word is hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def cut(text: str | None, spans: Sequence) -> str | None:
    """The text without its hit words, from the first byte of each span to the last."""
    if not text or not spans:
        return text
    body = text.encode()
    clean = np.frombuffer(body.translate(_TABLE), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(clean.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    parts, at = [], 0
    for span in spans:
        parts.append(body[at : starts[span["b"]]])
        at = ends[span["e"] - 1]
    return b"".join([*parts, body[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "drop", min_words: int = WINDOW, **options) -> DataFrame:
    """mode "drop": without the contaminated documents. mode "cut": all documents, but spans of min_words words or more
    are cut out of the text, as are all spans of contaminated documents."""
    text = options.pop("text", "text")
    # The columns of docs travel as one, so none can clash with the added ones.
    found = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text}`").alias("text")), benchmark, **options)
    if mode == "drop":
        return found.where(~contaminated()).select("doc.*")
    schema = T.StructType([found.schema["doc"], T.StructField("kept", T.StringType())])
    marked = found.withColumn("spans", F.when(contaminated(), F.col("spans")).otherwise(F.filter("spans", lambda s: s["e"] - s["b"] >= min_words)))

    def run(batches):
        for batch in batches:
            texts = [cut(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], names=["doc", "kept"])

    out = marked.select("doc", "text", "spans").mapInArrow(run, schema)
    return out.select(*[F.col("kept").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS t FROM benchmark),
bw AS (SELECT DISTINCT item, m, array_to_string(t[i : i + m - 1], ' ') AS k
       FROM (SELECT item, t, least(13, len(t)) AS m, unnest(range(1, len(t) - least(13, len(t)) + 2)) AS i FROM b WHERE len(t) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(t[i : i + m - 1], ' ') AS k
       FROM (SELECT doc_id, t, m, unnest(range(1, len(t) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(t) >= m)),
h AS (SELECT doc_id, i, m, item FROM dw JOIN bw USING (m, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
