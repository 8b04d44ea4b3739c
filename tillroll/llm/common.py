"""What the text operators share: shared-folder tables, byte and word hashing, packed shuffles."""

from __future__ import annotations

import contextlib
import contextvars
import os
import re
import tempfile
import threading
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import spread

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes handled at once by the vectorised hashing; bounds a task's memory.
GROUP_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or os.path.join(tempfile.gettempdir(), "tillroll-shared")


class _Space:
    """A workspace: its folder, the catalog entries of tables in it, and broadcast values that serve its jobs alone."""

    def __init__(self, folder: str):
        self.folder, self.tables, self.shared = folder, [], []


#: The running operators' workspaces, innermost last; each thread has its own.
_spaces: contextvars.ContextVar[tuple[_Space, ...]] = contextvars.ContextVar("tillroll_spaces", default=())


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def workspace(spark: SparkSession, label: str):
    """A folder below the shared one for the tables written meanwhile; deleted at the end, with their catalog entries and what share() sent out. What is to last goes through keep()."""
    space = _Space(f"{shared_root(spark)}/tillroll/{label}-{uuid.uuid4().hex}")
    token = _spaces.set((*_spaces.get(), space))
    try:
        yield
    finally:
        _spaces.reset(token)
        for name in space.tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for value in space.shared:
            value.destroy()
        remove(spark, space.folder)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Like materialize, but in the workspace around the innermost one."""
    token = _spaces.set(_spaces.get()[:-1])
    try:
        return materialize(df, label)
    finally:
        _spaces.reset(token)


def share(spark: SparkSession, value):
    """Broadcasts a value of bounded size for the jobs of the innermost workspace."""
    out = spark.sparkContext.broadcast(value)
    if _spaces.get():
        _spaces.get()[-1].shared.append(out)
    return out


#: Settings of the writes below: shuffle files go as soon as the write they were for is done, as what it wrote stands in the
#: shared folder; Arrow batches are small, so that a task holds a few MB of texts at once.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_lock = threading.Lock()
_writers: dict[int, int] = {}
_before: dict[int, dict] = {}


@contextlib.contextmanager
def _writing(spark: SparkSession):
    """_WRITING holds in the session until the last of its threads has left."""
    own = id(spark._jsparkSession)
    with _lock:
        if not _writers.get(own):
            _before[own] = {name: spark.conf.get(name, None) for name in _WRITING}
            for name, value in _WRITING.items():
                spark.conf.set(name, value)
        _writers[own] = _writers.get(own, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _writers[own] -= 1
            if not _writers[own]:
                for name, value in _before.pop(own).items():
                    spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def _place(spark: SparkSession, name: str) -> str:
    spaces = _spaces.get()
    return f"{spaces[-1].folder if spaces else shared_root(spark) + '/tillroll'}/{name}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back."""
    spark = df.sparkSession
    path = _place(spark, f"{label}-{uuid.uuid4().hex}")
    with _writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table that materialize() or keep() wrote."""
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        remove(df.sparkSession, folder)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Cuts the lineage like materialize, in buckets of `key`: joins on it don't shuffle these rows again."""
    spark = df.sparkSession
    name, n = f"tillroll_{label}_{uuid.uuid4().hex}", partitions(spark)
    if _spaces.get():
        _spaces.get()[-1].tables.append(name)
    with _writing(spark):
        df.repartition(n, key).write.option("path", _place(spark, name)).option("compression", "zstd").bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_id(column: str = "doc_id"):
    """The id as text for the fold rules; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


# ---------------------------------------------------------------- rows

#: What a null doc_id counts as.
NO_ID = -(1 << 63)
ROW_KEY = ["doc", "h1", "h2"]


def row_key() -> list:
    """The columns ROW_KEY of documents: the doc_id, or NO_ID, and two hashes of the text. Rows that share them are equal in doc_id and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def rows_in(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs, joined (left_semi, left_anti) with keys (ROW_KEY)."""
    own = [f"_{k}" for k in ROW_KEY]
    return docs.withColumns(dict(zip(own, row_key()))).join(keys.select(*(F.col(k).alias(o) for k, o in zip(ROW_KEY, own))), own, how).select(*docs.columns)


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_RAW = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FOLDED = _RAW.copy()
_FOLDED[65:91] = _RAW[97:123]
LUTS = {"raw": _RAW, "folded": _FOLDED}
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Entries of a table of powers; higher powers are products of one from either table.
STEP = 1 << 16


def _table(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_LOW = {base: _table(base, STEP) for base in (BASE, INVERSE)}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0..n-1."""
    if n <= STEP:
        return _LOW[base][:n]
    high = _table(pow(base, STEP, 1 << 64), -(-n // STEP))
    return (high[:, None] * _LOW[base][None, :]).ravel()[:n]


def prefix_hashes(data: np.ndarray, lut: str = "raw") -> np.ndarray:
    """Prefix polynomial hashes: the hash of data[s:e] is (H[e] - H[s]) * BASE**-s, the same wherever the bytes stand."""
    out, table = np.empty(len(data) + 1, np.uint64), LUTS[lut]
    out[0], scale, up = 0, np.uint64(1), np.uint64(pow(BASE, STEP, 1 << 64))
    for a in range(0, len(data), STEP):
        part = table[data[a : a + STEP]]
        part *= _LOW[BASE][: len(part)]
        with np.errstate(over="ignore"):
            part *= scale
            part[0] += out[a]
            scale *= up
        np.cumsum(part, out=out[a + 1 : a + 1 + len(part)])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = prefix[end] - prefix[start]
    out *= _LOW[INVERSE][start & (STEP - 1)]
    if len(prefix) > STEP:
        out *= _table(pow(INVERSE, STEP, 1 << 64), len(prefix) // STEP + 1)[start >> 16]
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of whole rows with about `most` bytes; one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than [\\x20\\x09-\\x0D] in rows that lie side by side in data; offsets[0] is 0."""
    n = int(offsets[-1])
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~SPACE[data[:n]]
    opens, closes = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    opens[inner] = solid[1:-1][inner]
    closes[inner - 1] = solid[1:-1][inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces [a, b) of a long text, of GROUP_BYTES and what is left of the last word."""
    n, at = len(data), 0
    while at < n:
        to = min(n, at + GROUP_BYTES)
        while to < n and not SPACE[data[to]]:
            step = np.flatnonzero(SPACE[data[to : to + GROUP_BYTES]])
            to = to + int(step[0]) if len(step) else min(n, to + GROUP_BYTES)
        yield at, to
        at = to


def hashed_words(data: np.ndarray, offsets: np.ndarray, lut: str = "folded") -> tuple[np.ndarray, np.ndarray]:
    """A hash and a row for each word of rows that lie side by side; a very long row goes in pieces that end at white space."""
    n = int(offsets[-1])
    if len(offsets) > 2 or n <= 2 * GROUP_BYTES:
        start, end, row = word_spans(data, offsets)
        return mix64(span_hashes(prefix_hashes(data[:n], lut), start, end)), row
    found = [_words(data[a:b], lut) for a, b in pieces(data[:n])]
    out = np.concatenate(found)
    return out, np.zeros(len(out), np.int64)


def _words(data: np.ndarray, lut: str) -> np.ndarray:
    start, end, _ = word_spans(data, np.array([0, len(data)]))
    return mix64(span_hashes(prefix_hashes(data, lut), start, end))


_WORD = np.arange(256, dtype=np.uint8)
_WORD[[b for b in range(128) if not chr(b).isalnum()]] = 32


#: Scripts written without blanks between words, by code points.
UNSPACED = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
]


class _Letters(dict):
    """What a code point becomes in a text whose words lie between blanks; learned as they occur."""

    def __missing__(self, point: int):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind == "Cf" and point != 0x200B:  # soft hyphens, joiners
            out = ""
        elif not c.isalnum() and kind[0] != "M":
            out = " "
        else:
            out = f" {c} " if any(a <= point <= b for a, b in UNSPACED) else c
        self[point] = out
        return out


_LETTERS = _Letters()


def spaced(text: str) -> str:
    """A text's words between blanks."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).translate(_LETTERS)


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash and a row for each word, as spaced() tells them, of rows that lie side by side; a very long row goes in pieces that end at white space."""
    n = int(offsets[-1])
    if len(offsets) == 2 and n > 2 * GROUP_BYTES:
        if len(cut := list(pieces(data[:n]))) > 1:
            found = [letter_words(data[a:b], np.array([0, b - a]))[0] for a, b in cut]
            return np.concatenate(found), np.zeros(sum(map(len, found)), np.int64)
    if not n or data[:n].max() < 128:
        return hashed_words(_WORD[data[:n]], offsets, "folded")  # ASCII words alone
    rows = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = data[a:b]
        rows.append(spaced(own.tobytes().decode(errors="replace")).encode() if a < b and own.max() >= 128 else _WORD[own].tobytes())
    start, end, row = word_spans(data := np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))
    return mix64(span_hashes(prefix_hashes(data, "folded"), start, end)), row


def shingles(words: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` words in order, and their rows; a row of 1 to width-1 words is one shingle."""
    if not len(words):
        return words, row
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    count = np.diff(np.append(start, len(row)))
    out = np.zeros(len(words), np.uint64)
    short = count < width
    full = len(words) - width + 1
    if full > 0:
        for j in range(width):
            out[:full] = mix64(out[:full] * np.uint64(BASE) + words[j : j + full])
    for s, c in zip(start[short].tolist(), count[short].tolist()):
        h = np.full(1, c, np.uint64)
        for j in range(c):
            h = mix64(h * np.uint64(BASE) + words[s + j : s + j + 1])
        out[s] = h[0]
    left = np.repeat(start + np.maximum(count - width, 0), count)
    keep = np.arange(len(words)) <= left
    return out[keep], row[keep]


# ---------------------------------------------------------------- packed shuffles

#: Entries that a map task holds before it hands them on.
FLUSH = 1 << 18
BLOBS = "bucket int, blob binary"


class Packer:
    """Gathers fixed-width entries in a map task and deals them out by their first column, as one blob for each bucket."""

    def __init__(self, buckets: int, first: int = 0, short: bool = False):
        """first: number of the first bucket, to keep several kinds of entries apart. short: of the first column, a hash, the upper half is sent."""
        self.buckets, self.first, self.short, self.held, self.size = buckets, first, short, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            columns = [np.concatenate(c) for c in zip(*self.held)]
            bucket = (columns[0] % np.uint64(self.buckets)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            columns, bucket = [c[order] for c in columns], bucket[order]
            if self.short:
                columns[0] = (columns[0] >> np.uint64(32)).astype(np.uint32)
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            yield pa.record_batch([pa.array(bucket[cut[:-1]].astype(np.int32) + np.int32(self.first)), pa.array([b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["bucket", "blob"])
        self.held, self.size = [], 0


def unpacked(blob: bytes, kinds: list) -> list[np.ndarray]:
    n, out, at = len(blob) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def by_bucket(blobs: DataFrame, kinds: list | Callable[[int], list], f: Callable[..., Iterator[pa.RecordBatch]], schema: str, parts: int) -> DataFrame:
    """Applies f to each bucket's number and columns, after a shuffle of the blobs. kinds: the columns' types, or a function from a bucket's number to them."""

    def task(batches):
        now, held = None, []

        def done():
            if held:
                yield from f(now, *[np.concatenate(c) for c in zip(*(unpacked(b, kinds(now) if callable(kinds) else kinds) for b in held))])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    yield from done()
                    now, held = bucket, []
                held.append(blob.as_py())
        yield from done()

    return blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(task, schema)


def runs(batches, keys: list[str], least: int = 2) -> Iterator[pa.Table]:
    """Tables of at least `least` consecutive rows that agree in the integer columns `keys`."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not len(table):
            continue
        k = [table.column(c).to_numpy() for c in keys]
        cut = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in k], axis=0)))).tolist()
        for a, b in zip(cut, cut[1:]):
            if b - a >= least:
                yield table.slice(a, b - a)
        rest = table.slice(cut[-1])
    if rest is not None and len(rest) >= least:
        yield rest
