"""Pieces that several corpus operators share: table access, shared storage, Arrow helpers, cached tokenisation."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from itertools import chain
from pathlib import Path
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import CLEANUP, passing  # noqa: F401

#: Separators of the words `[^\x20\x09-\x0D]+`.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


#: Rows in an Arrow batch at most, so that a batch of very long texts fits a worker beside its own arrays.
BATCH_ROWS = 1_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the workers of this application, once: the driver serves it, so they needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():  # else it has come in an archive already
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the cluster shares; set up under the warehouse where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to shared storage and rereads it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    with passing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files below a stored DataFrame that is no longer needed."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: Iterable[str], name: str) -> str:
    """The name, or a longer one if a column has it already (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def id_crc32(col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def crc_of_id(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows so that the binary column has about `limit` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.column(column)
        offsets = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Joins small batches to ones of about so many rows, for columns of short values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def binary_list(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every range, one after the other."""
    lengths = lengths.astype(np.int64, copy=False)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64, copy=False) - before, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: What this worker process keeps from task to task, by name: how to forget it.
held: dict[str, Callable[[], object]] = {}


def release(but: str = "") -> None:
    """Called when a task begins: forgets what earlier tasks of other operators have kept in this worker, and gives free
    memory back to the system."""
    for name, forget in held.items():
        if name != but:
            forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidy(f):
    """A task's function that gives memory back before and after: workers that are idle for a while keep what they hold."""

    @wraps(f)
    def run(*args, **options):
        release()
        yield from f(*args, **options)
        release()

    return run


class Numbering(dict):
    """Gives every new key the next number and notes it in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(key)
        return number


class WordIndex:
    """Maps byte words to small integers and to 64-bit hashes; forgets all when it holds too many."""

    def __init__(self, most: int = 1_000_000):
        import xxhash

        self.most, self.hash_of = most, xxhash.xxh3_64_intdigest
        self.clear()

    def clear(self) -> None:
        self.index = Numbering()
        self.hashes = np.zeros(1024, np.uint64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Valid until the next call."""
        if len(self.index) > self.most:
            self.clear()
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def hashed(self, words: list[bytes]) -> np.ndarray:
        numbers = self.numbers(words)
        new, self.index.new = self.index.new, []
        at = len(self.index) - len(new)
        if len(self.index) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(max(len(self.hashes), len(self.index)), np.uint64)])
        self.hashes[at : len(self.index)] = np.fromiter(map(self.hash_of, new), np.uint64, len(new))
        return self.hashes[numbers]


def _byte_chars() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable ones as they are, the others from 256 on."""
    out, free = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


_BYTE_CHARS = _byte_chars()
#: Letters whose lower case depends on what is around them, or has several characters.
_LOWER_ODD = frozenset("\u03a3\u0130")


#: Encoded pieces of text that a worker keeps, and bytes of the longest piece.
PIECES, LONGEST = 1_200_000, 1024
#: Bytes that end a word, and signs that may be cut off a word's end (no apostrophe, as letters behind it belong to it).
_BREAK, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[0, 10, 32]] = True
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def piece_names(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes, never 0, of pieces of the bytes; eight more bytes must follow the last piece."""
    wide = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    names = mix64((wide[begin] & _FIRST[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * _ODD))
    at, done = np.flatnonzero(sizes > 8), 8
    while len(at):
        left = sizes[at] - done
        names[at] = mix64(names[at] * _ODD + (wide[begin[at] + done] & _FIRST[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    return np.maximum(names, np.uint64(1))


class _Names:
    """Numbers 0, 1, ... of 64-bit names in the order in which they are added: a hash table in two arrays, at most half full."""

    def __init__(self):
        self.names, self.n = np.zeros(1024, np.uint64), 0
        self._sized(12)

    def _sized(self, bits: int) -> None:
        self.bits, self.keys, self.numbers = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, names: np.ndarray) -> np.ndarray:
        return (names >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, names: np.ndarray) -> np.ndarray:
        """Their numbers; -1 if unknown."""
        slot = self._slots(names)
        key = self.keys[slot]
        same = key == names
        found = np.where(same, self.numbers[slot], -1).astype(np.int64)
        at = np.flatnonzero(~same & (key > 0))
        while len(at):
            slot[at] = (slot[at] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[at]]
            same = key == names[at]
            found[at[same]] = self.numbers[slot[at[same]]]
            at = at[~same & (key > 0)]
        return found

    def add(self, names: np.ndarray) -> None:
        """Unknown ones, each once."""
        begin, self.n = self.n, self.n + len(names)
        if self.n > len(self.names):
            self.names = np.concatenate([self.names, np.zeros(max(len(self.names), len(names)), np.uint64)])
        self.names[begin : self.n] = names
        if 2 * self.n > len(self.keys):
            self._sized((2 * self.n).bit_length() + 1)
            begin = 0
        names, at = self.names[begin : self.n], np.arange(self.n - begin)
        slot = self._slots(names)
        while len(at):
            free = at[self.keys[slot[at]] == 0]
            self.keys[slot[free]] = names[free]
            in_place = np.zeros(len(names), bool)
            in_place[free] = self.keys[slot[free]] == names[free]
            won = free[in_place[free]]
            self.numbers[slot[won]] = won + begin
            at = at[~in_place[at]]
            slot[at] = (slot[at] + 1) & (len(self.keys) - 1)


class CachedEncoder:
    """Token ids of whole texts, as the tokenizers library gives them.

    Texts are cut where no token can cross: before a single ASCII space, around a single newline, and before the signs that
    end a word. Each distinct piece is encoded once and kept by its 64-bit hash (about `most` pieces; then all are
    forgotten). Texts where such a cut may not be safe (other white space beside it, no letter or digit before the signs,
    what may be a special token, a very long piece) are encoded whole.
    """

    def __init__(self, path: str, leading_space: bool, most: int = PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.most = leading_space, most
        self.lower = not leading_space
        self.bare = Tokenizer(self.tokenizer.model)
        self.plain = self._plain_works()
        self.folds = self.lower and all(self.tokenizer.encode(x, add_special_tokens=False).ids == self.tokenizer.encode(x.lower(), add_special_tokens=False).ids for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "It'S A Word"))
        self.lines = bool(self.tokenizer.encode("\n", add_special_tokens=False).ids)
        self.clear()

    def clear(self) -> None:
        self.index = _Names()
        self.starts, self.lengths, self.marks = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint8)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    @staticmethod
    def _mark(piece: str) -> int:
        """1: a cut beside it may be unsafe. 2: it doesn't end with a letter or digit, as it is or as the tokenizer rewrites it."""
        if piece == "\n":
            return 0
        word = piece[1:] if piece[:1] == " " else piece
        return 1 if not word or len(word.split()) != 1 or word[0].isspace() or word[-1].isspace() else 0 if word[-1].isalnum() and normalize("NFC", word).lower()[-1].isalnum() else 2

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces that are one run of letters each: what the model gives for their bytes' characters, without the steps
        before it, and how many ids each has."""
        if self.lower:
            pieces = [piece.lower() for piece in pieces]
        chars = [piece if piece.isascii() and piece[0] != " " else piece.encode().decode("latin-1").translate(_BYTE_CHARS) for piece in pieces]
        ids = [np.zeros(0, np.uint32)]
        # In groups, each piece followed by a sign that ends it: no letter has the sign's id.
        groups = [[x for piece in chars[k : k + 100] for x in (piece, "!")] for k in range(0, len(chars), 100)]
        for found in self.bare.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False):
            ids.append(np.array(found.ids, np.uint32))
        ids = np.concatenate(ids)
        ends = ids == self.bare.encode("!", add_special_tokens=False).ids[-1]
        return ids[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1

    def _plain_works(self) -> bool:
        """Whether the model alone gives what the whole tokenizer gives, on words of several alphabets."""
        tries = ["a", "The", "onharent", "naïve", "Éiou", "größe", "ñezll", "слово", "漢字", "zzzzqqqq"]
        tries += [" " + t for t in tries] if not self.lower else []
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(tries, add_special_tokens=False)]
        ids, lengths = self._plain(tries)
        return ids.tolist() == list(chain.from_iterable(whole)) and lengths.tolist() == list(map(len, whole))

    def _learn(self, new: list[str]) -> None:
        """Encodes the pieces that are new; they get the next numbers."""
        at, n = self.index.n, len(new)
        while at + n > len(self.starts):
            self.starts, self.lengths, self.marks = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.marks))
        easy, hard = [], []
        for i, piece in enumerate(new):
            word = piece[1:] if piece[:1] == " " and not self.lower else piece
            plain = self.plain and word.isalpha() and (word.isascii() or (is_normalized("NFC", word) and not _LOWER_ODD.intersection(word)))
            (easy if plain else hard).append(i)
            self.marks[at + i] = 0 if plain else self._mark(piece)
        flat, sizes = self._plain([new[i] for i in easy])
        self._keep(np.array(easy, np.int64) + at, flat, sizes)
        for i in range(0, len(hard), 8192):
            part = hard[i : i + 8192]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([new[k] for k in part], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(part))
            self._keep(np.array(part, np.int64) + at, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def _keep(self, numbers: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.lengths[numbers] = sizes
        self.used += len(flat)

    def _numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The pieces' numbers; new ones are encoded."""
        names = piece_names(data, begin, end - begin)
        found = self.index.find(names)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, first, which = np.unique(names[new], return_index=True, return_inverse=True)
            body, first = data.tobytes(), new[first]
            found[new] = self.index.n + which
            self._learn([body[b:e].decode() for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
            self.index.add(fresh)
        return found

    def _pieces(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the pieces of texts between zero bytes begin and end, and which are signs cut off the piece before."""
        broken = _BREAK[data]
        first, last = ~broken[1:-1] & broken[:-2], ~broken[1:-1] & broken[2:]
        if self.lines:
            line = data[1:-1] == 10
            first, last = first | line, last | line
        begin, end = np.flatnonzero(first) + 1, np.flatnonzero(last) + 2
        cut = end.copy()
        at = np.flatnonzero(_SIGN[data[end - 1]])
        while len(at):
            cut[at] -= 1
            at = at[(cut[at] > begin[at]) & _SIGN[data[cut[at] - 1]]]
        two = (cut < end) & (cut > begin)
        if self.spaced:
            begin -= data[begin - 1] == 32
        times = 1 + two
        signs = (np.cumsum(times) - 1)[two]
        begin, end = np.repeat(begin, times), np.repeat(end, times)
        begin[signs] = end[signs - 1] = cut[two]
        return begin, end, signs

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array of uint32, and the number of ids of each text."""
        if self.index.n > self.most:
            self.clear()
        body = "\0".join(texts)
        whole = set()
        if body.count("\0") != max(0, len(texts) - 1):
            whole.update(k for k, text in enumerate(texts) if "\0" in text)
            body = "\0".join("" if k in whole else text for k, text in enumerate(texts))
        data = np.frombuffer(b"\0" + body.encode() + bytes(9), np.uint8)
        if self.folds:
            # Capitals that the tokenizer takes as small letters; not those that a mark behind them may belong to.
            capital = (data[:-1] - np.uint8(65) < 26) & (data[1:] < 128)
            data = data | np.append(capital, False).astype(np.uint8) << 5
        zero = data == 0
        starts = np.flatnonzero(zero)[: len(texts) + 1]
        # White space beside white space or a text's edge, and what may be a special token.
        odd = _BREAK[data[:-1]] & _BREAK[data[1:]] & ~(zero[:-1] & zero[1:]) | (data[:-1] == 60) & (data[1:] == 124)
        at = np.flatnonzero(odd)
        own = np.zeros(len(texts) + 1, bool)
        own[np.searchsorted(starts, at + zero[at], side="right") - 1] = True
        begin, end, signs = self._pieces(data)
        own[np.searchsorted(starts, begin[end - begin > LONGEST], side="right") - 1] = True
        sizes = np.diff(np.searchsorted(begin, starts))
        if own.any():
            cut = np.zeros(len(begin), bool)
            cut[signs] = True
            stay = ~np.repeat(own[: len(texts)], sizes)
            begin, end, signs = begin[stay], end[stay], np.flatnonzero(cut[stay])
            sizes[own[: len(texts)]] = 0
            whole.update(np.flatnonzero(own).tolist())
        found = self._numbers(data, begin, end)
        marks = self.marks[found]
        unsafe = (marks & 1) > 0
        unsafe[signs] |= marks[signs - 1] > 0
        if unsafe.any():
            whole.update(np.repeat(np.arange(len(texts)), sizes)[unsafe].tolist())
        lengths = self.lengths[found]
        ids = self.pool[ragged(self.starts[found], lengths)]
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])])
        if whole:
            order = sorted(whole)
            own = dict(zip(order, (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([texts[k] for k in order], add_special_tokens=False)), strict=True))
            ends = np.cumsum(counts)
            ids = np.concatenate([own[k] if k in own else ids[ends[k] - counts[k] : ends[k]] for k in range(len(texts))])
            counts[order] = [len(own[k]) for k in order]
        return ids, counts


_encoders: dict[tuple, CachedEncoder] = {}


def encoder(path: str, leading_space: bool, most: int = PIECES) -> CachedEncoder:
    """One encoder for each worker process."""
    held["encoders"] = lambda: [one.clear() for one in _encoders.values()]
    key = (path, leading_space)
    if key not in _encoders:
        _encoders[key] = CachedEncoder(path, leading_space)
    _encoders[key].most = most
    return _encoders[key]


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
