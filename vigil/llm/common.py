"""Helpers shared by the text operators: the shared folder, materialised tables, and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised routines look at together; a longer document is one block of its own.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/vigil-checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_folder"] = path
    return out


def settle(df: DataFrame) -> DataFrame:
    """As materialise, and the files of the shuffles that made df go at once, not when the driver collects its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return materialise(df)
    finally:
        conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables whose successors have been written."""
    for t in tables:
        if path := t.__dict__.pop("_folder", None):
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with a name for value, which is then computed once a row although body uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key() -> list:
    """Columns k1, k2 that tell rows apart by content; rows alike in id and text share them and get the same result.

    k1 is doc_id, and 0 where that is null: then, and only then, k2 is odd.
    """
    doc_id = F.col("doc_id").cast("long")
    return [
        F.coalesce(doc_id, F.lit(0)).alias("k1"),
        F.xxhash64("text").bitwiseAND(-2).bitwiseOR(doc_id.isNull().cast("long")).alias("k2"),
    ]


def without_id(k2: Column) -> Column:
    """Whether a row's doc_id is null, from its key."""
    return k2.bitwiseAND(1) == 1


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, (256, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SPACE = np.ones(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Byte classes that make up words: anything but ASCII white space, or digits, letters and all beyond ASCII.
WORD_BYTES = {"space": _SPACE, "alnum": _ALNUM}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_HASH = _table(20240607)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), elementwise."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


class Words:
    """Words of some documents in text order: byte spans in buf, the first word of each document, 64-bit hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, kind: str, lower: bool):
        base, end = int(offsets[0]), int(offsets[-1])
        raw = buf[base:end]
        self.buf = _LOWER[raw] if lower else raw
        self.offsets = offsets - base
        word = WORD_BYTES[kind][self.buf]
        n = len(word)
        first = word.copy()
        last = word.copy()
        if n:
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            at = self.offsets[:-1][self.offsets[:-1] < n]
            first[at] = word[at]
            to = self.offsets[1:][self.offsets[1:] > 0] - 1
            last[to] = word[to]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.docs = np.searchsorted(self.starts, self.offsets)  # word index where each document begins, and the end
        self._word = word

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.flatnonzero(self._word)
        begin = np.cumsum(lengths) - lengths
        pos = np.arange(len(at)) - np.repeat(begin, lengths)
        with np.errstate(over="ignore"):
            v = _HASH.ravel().take((self.buf[at].astype(np.int64) << 6) | (pos & 63))
            if lengths.max() > 64:
                v = v * ((pos >> 6).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) * np.uint64(2) + np.uint64(1))
            return mix(np.add.reduceat(v, begin) + lengths.astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def blocks(column: pa.Array, kind: str, lower: bool, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) over a string column, a bounded number of bytes at a time."""
    buf, off = utf8_parts(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j, Words(buf, off[i : j + 1], kind, lower)
        i = j


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: Bits of the filter that keeps rows which aren't wanted out of a shuffle, as a power of two.
_FILTER_BITS = 22


def trim() -> None:
    """Give freed memory back, so that an idle worker keeps little beside its imports."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class KeyFilter:
    """A bitmap of fixed size over row keys' hashes (k2): no key that is wanted is missed, and few others pass."""

    def __init__(self, wanted: DataFrame):
        bits = wanted.select(F.shiftrightunsigned(F.col("k2"), 64 - _FILTER_BITS).alias("b")).select(F.shiftright("b", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v"))
        bitmap = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
        words = bits.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # at once: a row for each word of the bitmap at most
        bitmap[np.asarray(words["w"])] = np.asarray(words["v"])
        self.shared = wanted.sparkSession.sparkContext.broadcast(bitmap)

    def test(self, k2: pa.Array) -> pa.Array:
        """Which rows may be wanted; for use within tasks."""
        h = np.asarray(k2).view(np.uint64) >> np.uint64(64 - _FILTER_BITS)
        return pa.array((self.shared.value[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)).astype(np.int64)) & 1 == 1)

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows (with k2) that may be wanted."""
        at, test = rows.columns.index("k2"), self.test

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(test(b.column(at)))
            trim()

        return rows.mapInArrow(run, rows.schema)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """By elimination with pivots of the greatest size, elementwise: no threaded library runs in the driver."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], axis=1)
    for i in range(n):
        j = i + int(np.abs(both[i:, i]).argmax())
        if j != i:
            both[[i, j]] = both[[j, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        rows = np.flatnonzero(factor)
        both[rows] -= factor[rows, None] * both[i]
    return both[:, n:]
