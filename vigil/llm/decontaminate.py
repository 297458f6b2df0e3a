"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised n-grams, scanned over whole documents.

Words are runs of [0-9a-z] and of anything beyond ASCII, after A-Z is lower-cased. A window is `n` consecutive words of
an item; an item with fewer words, but some, is one window by itself. Documents are hashed word by word and window by
window with numpy; a window whose hash is in the set is a candidate, and counts only after its words are compared.

The benchmark is read in blocks of at most BLOCK_WORDS words (and one item). A block becomes sorted arrays of hashes and
places, once, and is broadcast; a benchmark beyond that takes one pass per block over the documents (a stated query set
in blocks), each written before the next begins, and spans of all passes are merged, so neither the driver's memory nor
a worker's grows with the benchmark. Nothing is shuffled.

Null text has no words and no hits; an empty benchmark hits nothing. Items without text or words are skipped; an item
with null id hits, but has no id to list. Items that repeat an id count once. Rows are independent, so repeated rows
repeat their result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import Words, blocks, discard, materialise, mix, trim, utf8_parts

BLOCK_WORDS = 2_000_000
#: Rows of a batch that are cut together.
ROWS = 1_000
SCHEMA = "doc_id long, text string, n_words long, spans array<int>, items array<string>"


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, from those of the words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        return mix(out + np.uint64(n))


class BenchmarkSet:
    """Windows of some items by length: sorted hashes, and where in the items' words each begins. Built once a block, then broadcast."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.ids = [i for i, _ in items]
        w = Words(*utf8_parts(pa.array([t for _, t in items], pa.string())), "alnum", True)
        h, counts = w.hashes(), w.counts
        self.words = w
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            x = window_hashes(h, k)
            end = np.repeat(w.docs[1:], counts)
            whole = np.repeat(np.minimum(counts, n) == k, counts)
            at = np.flatnonzero(whole[: len(x)] & (np.arange(len(x)) + k <= end[: len(x)]))
            at = at[np.argsort(x[at], kind="stable")]
            self.by_length[k] = x[at], at

    def scan(self, w: Words, h: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, words, items) of every window in w that is a benchmark's; never across documents."""
        last = np.repeat(w.docs[1:], w.counts)  # for each word, where its document's words end
        for k, (keys, places) in sorted(self.by_length.items()):
            x = window_hashes(h, k)
            if not len(x) or not len(keys):
                continue
            at = np.searchsorted(keys, x)
            hit = np.flatnonzero((keys[np.minimum(at, len(keys) - 1)] == x) & (np.arange(len(x)) + k <= last[: len(x)]))
            for p in hit.tolist():
                words = [w.text(j) for j in range(p, p + k)]
                same = [q for q in places[at[p] : np.searchsorted(keys, x[p], side="right")].tolist() if words == [self.words.text(j) for j in range(q, q + k)]]
                if same:
                    owners = np.searchsorted(self.words.docs, same, side="right") - 1
                    yield p, k, {self.ids[i] for i in owners.tolist() if self.ids[i] is not None}


def merge(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping or touching [begin, end) spans joined, as a flat list."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _item_blocks(benchmark: DataFrame, most: int, n: int) -> Iterator[BenchmarkSet]:
    block, size, some = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t) // 4 + 1
        if size > most:
            yield BenchmarkSet(block, n)
            block, size, some = [], 0, True
    if block or not some:
        yield BenchmarkSet(block, n)


def _start(docs: DataFrame) -> list:
    return [F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items")]


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (flat begin, end of hit words, merged) and items (sorted ids) of each document."""
    spark, out, last = docs.sparkSession, docs.select(*_start(docs)), None
    for known in _item_blocks(benchmark, block_words, n):
        if last is not None:  # one block at a time: the pass before is written first
            new = materialise(out)
            discard(last)
            last = out = new
        else:
            last = out
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(known)), SCHEMA)
    return out.drop("text")


def _pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            spans, items, counts = b.column(3).to_pylist(), b.column(4).to_pylist(), np.zeros(b.num_rows, np.int64)
            for i, j, w in blocks(b.column(1), "alnum", True):
                counts[i:j] = w.counts
                new: dict[int, tuple[list, set]] = {}
                for p, k, ids in known.scan(w, w.hashes()):
                    d = int(np.searchsorted(w.docs, p, side="right")) - 1
                    s, found = new.setdefault(d, ([], set()))
                    s.append((p - int(w.docs[d]), p - int(w.docs[d]) + k))
                    found |= ids
                for d, (s, found) in new.items():
                    old = spans[i + d]
                    spans[i + d] = merge(s + list(zip(old[::2], old[1::2], strict=True)))
                    items[i + d] = sorted(found.union(items[i + d]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

    return run


def digest(leaks: DataFrame) -> DataFrame:
    """Counts, a digest of the item ids, and the verdict (a twentieth of the words or more are hit)."""
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> IF(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return leaks.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the documents that are contaminated, and the others without their hit words; columns stay.

    Removed words go with the white space and punctuation between them; n_chars follows where it is a column.
    """
    names = docs.columns
    whole = [f for f in docs.schema if f.name != "text"]
    wide = docs.select(*_start(docs), F.struct(*[F.col(f"`{f.name}`") for f in whole]).alias("rest"))
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in wide.schema])
    step = None
    for known in _item_blocks(benchmark, block_words, n):
        if step is not None:
            new = materialise(wide.mapInArrow(_carry(step), schema))
            discard(wide)
            wide = new
        step = _pass(spark.sparkContext.broadcast(known))
    # the last pass and the cut share a worker: two for each task would hold the same texts twice
    wide = wide.mapInArrow(_carry(_both(step, _cut)), schema).where("text is not null or n_words is not null")
    out = wide.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in names])
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def _both(first, second):
    return lambda batches: second(first(batches))


def _carry(step):
    """step over the first five columns, with the struct of the others beside them, ROWS rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = []

        def narrow() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, ROWS):
                    part = b.slice(i, ROWS)
                    rest.append(part.column(5))
                    yield part.select([0, 1, 2, 3, 4])

        for b in step(narrow()):
            yield pa.RecordBatch.from_arrays([*b.columns, rest.pop(0)], [*b.schema.names, "rest"])
        trim()

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit words go; a contaminated document is marked by null text and null n_words."""
    for b in batches:
        spans, counts = b.column(3).to_pylist(), b.column(2)
        hit = pa.array([bool(s) for s in spans], pa.bool_())
        texts, gone = [], []
        for r, s in enumerate(spans):
            if not s:
                continue
            n_hit, n_words = sum(s[1::2]) - sum(s[::2]), counts[r].as_py()
            if 20 * n_hit >= n_words:
                texts.append(None)
                gone.append(None)
                continue
            raw = b.column(1)[r].as_py().encode()
            w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), "alnum", True)
            keep, at = [], 0
            for x, y in zip(s[::2], s[1::2], strict=True):
                keep.append(raw[at : w.starts[x]])
                at = int(w.starts[y]) if y < len(w) else len(raw)
            texts.append(b"".join([*keep, raw[at:]]).decode())
            gone.append(n_words)
        text = pc.replace_with_mask(b.column(1), hit, pa.array(texts, b.column(1).type))
        yield pa.RecordBatch.from_arrays([b.column(0), text, pc.replace_with_mask(counts, hit, pa.array(gone, pa.int64())), b.column(3), b.column(4)], b.schema.names)
