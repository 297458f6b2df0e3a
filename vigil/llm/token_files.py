"""Token ids as flat binary files that training jobs memory-map, with 64-bit document offsets.

Layout of a folder, one set of files for each shard (shards and the documents in them ascend by doc_id):
  shard-00000.ids   ids, little-endian unsigned integers of 2 bytes (4 for vocabularies beyond 65,536)
  shard-00000.off   n + 1 little-endian 64-bit offsets, in ids, of its n documents; the last is the shard's length
  shard-00000.doc   n little-endian 64-bit doc_ids, then n bytes that are 1 where the doc_id is null
The manifest (a small table) has each shard's documents and ids; exclusive prefix sums of them are the shards' bases.

Shards are ranges of doc_id of about equal bytes, chosen before anything is encoded, so that encoded documents are
shuffled once, each shard to a task of its own, and never kept elsewhere. Rows of one doc_id may lie in several shards;
they are parted by a hash of the text and the row's place.

Every document ends with end_id. Null text counts as empty. Null doc_ids come first; rows with equal doc_id are
ordered by a hash of their texts, so results don't depend on the order of the input. Other columns are ignored. A retried task
writes under a name of its own and renames at the end, so a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.bpe import encoder
from vigil.llm.common import shared_dir

#: Bytes of ids that a shard should have.
SHARD_BYTES = 64 << 20
_NULL = -(1 << 63)


#: What a task may take when bounds are found: shards' worth of rows, and rows.
_TASK_SHARDS, _TASK_ROWS = 8, 2_000_000


def _tie():
    """Parts the rows of a doc_id: by text first, then by place, so that equal rows stay together but can be split."""
    return F.xxhash64("text").bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 32))


def shard_bounds(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[list[int], list[int]]:
    """Upper (doc_id, tie) of all shards but the last; a shard has about shard_bytes of ids, at two bytes for three of text.

    Only doc_ids, ties and sizes are sorted, in ranges of (doc_id, tie), so that a doc_id with very many rows spreads over
    tasks like any other rows; sizes are added up along each range, and a shard ends wherever another shard's worth is
    full, and where a range ends. What is collected is one row a shard.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), _tie().alias("tie"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    n, size = rows.agg(F.count("*"), F.sum("size")).first()
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-2 * (size or 0) // (3 * shard_bytes)))
    if not n or shards < 2:
        return [], []
    most = size / shards

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, full, last, open_ = 0, 0, None, False
        for b in batches:
            doc, tie, sizes = (np.asarray(b.column(i)) for i in range(3))
            if not len(doc):
                continue
            worth = ((filled + np.cumsum(sizes)) // most).astype(np.int64)
            at = np.flatnonzero(np.diff(worth, prepend=full))
            filled, full, last = filled + int(sizes.sum()), int(worth[-1]), (doc[-1], tie[-1])
            open_ = not len(at) or at[-1] != len(doc) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tie[at])], ["doc", "tie"])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["doc", "tie"])

    ranges = max(1, shards // _TASK_SHARDS, n // _TASK_ROWS)
    ordered = rows.repartitionByRange(ranges, "doc", "tie").sortWithinPartitions("doc", "tie")
    out = sorted({(r.doc, r.tie) for r in ordered.mapInArrow(ends, "doc long, tie long").collect()})[:-1]  # the last row of all ends no shard
    return [d for d, _ in out], [t for _, t in out]


def _shard_of(doc: np.ndarray, tie: np.ndarray, upper: np.ndarray, ties: np.ndarray) -> np.ndarray:
    at = np.searchsorted(upper, doc)
    there = np.flatnonzero(at < len(upper))
    there = there[upper[at[there]] == doc[there]]  # rows whose doc_id is that of a bound: the tie decides
    for d in np.unique(doc[there]):
        mine = there[doc[there] == d]
        first, end = np.searchsorted(upper, d), np.searchsorted(upper, d, "right")
        at[mine] = first + np.searchsorted(ties[first:end], tie[mine])
    return at.astype(np.int32)


def encode(docs: DataFrame, tokenizer: str, end_id: int, bounds: tuple[list[int], list[int]]) -> DataFrame:
    """doc_id, tie, shard, ids (little-endian binary, with the end id) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        upper, ties = (np.array(x, dtype=np.int64) for x in bounds)
        for b in batches:
            shard = pa.array(_shard_of(np.asarray(b.column(0).fill_null(_NULL)), np.asarray(b.column(2)), upper, ties))
            for i, j, ids, at in enc.ended(b.column(1), end_id):
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at.astype(np.int64) * enc.width), pa.py_buffer(ids)])
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), shard.slice(i, j - i), raw.cast(pa.binary())], ["doc_id", "tie", "shard", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", _tie().alias("tie"))
    return rows.mapInArrow(run, "doc_id long, tie long, shard int, ids binary")


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _ShardWriter:
    """The three files of one shard, under a name of its own until close()."""

    def __init__(self, files, top: str, shard: int, width: int):
        self.files, self.top, self.shard, self.width = files, top, shard, width
        self.name = f"{top}/.{uuid.uuid4().hex}"
        self.out = files.open_output_stream(f"{self.name}.ids")
        self.at, self.offsets, self.ids, self.nulls = 0, [np.zeros(1, "<i8")], [], []

    def add(self, docs: pa.Array, ids: pa.Array) -> None:
        off = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        self.out.write(ids.buffers()[2].slice(int(off[0]), int(off[-1] - off[0])))
        self.offsets.append((self.at + (off[1:] - off[0]) // self.width).astype("<i8"))
        self.at = int(self.offsets[-1][-1])
        self.ids.append(np.asarray(docs.fill_null(0)).astype("<i8"))
        self.nulls.append(np.asarray(docs.is_null()).astype(np.uint8))

    def close(self) -> tuple[int, int, int]:
        self.out.close()
        for end, parts in (("off", self.offsets), ("doc", self.ids + self.nulls)):
            with self.files.open_output_stream(f"{self.name}.{end}") as out:
                for p in parts:
                    out.write(p.tobytes())
        for end in ("ids", "off", "doc"):
            self.files.move(f"{self.name}.{end}", f"{self.top}/shard-{self.shard:05d}.{end}")
        return self.shard, sum(map(len, self.ids)), self.at


def write(encoded: DataFrame, shards: int, width: int, folder: str) -> list[tuple[int, int, int]]:
    """Write encoded documents; the manifest as (shard, documents, ids) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _fs(folder)
        files.create_dir(top, recursive=True)
        writer, done = None, []
        for b in batches:
            shard = np.asarray(b.column(2))
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if writer is None or writer.shard != shard[i]:
                    if writer:
                        done.append(writer.close())
                    writer = _ShardWriter(files, top, int(shard[i]), width)
                writer.add(b.column(0).slice(i, j - i), b.column(3).slice(i, j - i))
        if writer:
            done.append(writer.close())
        s, n, ids = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(n, pa.int64()), pa.array(ids, pa.int64())], ["shard", "docs", "ids"])

    ordered = encoded.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie")
    return sorted(tuple(r) for r in ordered.mapInArrow(run, "shard int, docs long, ids long").collect())


def read(spark: SparkSession, folder: str, width: int, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, from the memory-mapped files."""
    bases = dict(zip((s for s, _, _ in manifest), accumulate((n for _, _, n in manifest), initial=0), strict=False))
    code = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _fs(folder)

        def opened(name: str):
            path = f"{top}/{name}"
            if not files.get_file_info(path).size:
                return np.zeros(0, np.uint8)
            if files.type_name == "local":
                return np.memmap(path, np.uint8, "r")
            with files.open_input_file(path) as f:
                return np.frombuffer(f.read(), np.uint8)

        for b in batches:
            for shard in filter(bases.__contains__, b.column(0).to_pylist()):
                raw = opened(f"shard-{shard:05d}.ids")
                off = np.frombuffer(opened(f"shard-{shard:05d}.off").tobytes(), "<i8")
                doc = opened(f"shard-{shard:05d}.doc").tobytes()
                n = len(off) - 1
                ids, null = np.frombuffer(doc, "<i8", n), np.frombuffer(doc, np.uint8, n, 8 * n)
                for i in range(0, n, 5000):
                    j = min(n, i + 5000)
                    cut = off[i : j + 1] * width
                    whole = raw[cut[0] : cut[-1]].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[i:j], pa.int64(), mask=null[i:j].astype(bool)),
                            pa.array(off[i:j] + bases[shard], pa.int64()),
                            pa.array(np.diff(off[i : j + 1]), pa.int64()),
                            pa.array([_crc(np.frombuffer(whole[a:b], code)) for a, b in zip(cut[:-1] - cut[0], cut[1:] - cut[0], strict=True)], pa.int64()),
                            pa.array([whole[a:b] for a, b in zip(cut[:-1] - cut[0], cut[1:] - cut[0], strict=True)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    last = max([s for s, _, _ in manifest], default=-1)
    shards = spark.range(0, last + 1, 1, last + 2)
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode, write and read back; folder: where the files go (default: a fresh one in the shared folder)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens"
    width = encoder(tokenizer).width
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bounds = shard_bounds(docs)
    manifest = write(encode(docs, tokenizer, end_id, bounds), len(bounds[0]) + 1, width, folder)
    return read(spark, folder, width, manifest)
