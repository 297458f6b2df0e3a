"""Substring dedup: passages of at least `window` words that occur more than once are found by FM-indexes and removed.

1. Every window of `window` words has a minimiser: the least-hashed run of GRAM words in it (the leftmost such). Windows
   in a row with the same minimiser form a segment, so each window of a document is in exactly one segment, and equal
   windows, wherever they are, have equal minimisers at equal places. A minimiser that occurs once has nothing to find.
2. Segments of the other minimisers are grouped by minimiser and content (pre-aggregated), and each kind goes on once,
   with its count. Kinds whose minimiser has no other kind are joined to runs with their neighbours in the document.
3. Kinds are dealt by minimiser to shards. Each shard builds an FM-index (suffix array, Burrows-Wheeler transform,
   wavelet tree, and sums of the counts in suffix order) and streams all its segments through it: backward search gives
   their matching statistics, and windows within a stretch that stands twice or more in the collection are reported as a
   bit mask. Nothing is removed that an index hasn't reported.
4. A minimiser with a great many kinds (a passage that very many documents share begins or ends there) isn't dealt as a
   whole, lest a shard grow with one passage: its windows are counted by their own hashes, and those that come up again
   are dealt one by one, each as a segment with its count.
5. Masks go back to all segments of their kind and, by document, to the texts; covered words are left out. Documents
   without any report don't take part in that shuffle (a fixed-size bitmap of keys keeps them out).

Null text has no words; texts shorter than a window lose nothing. Rows that repeat an id or a text are occurrences like
others. An empty table gives no rows. Other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import KeyFilter, Words, blocks, discard, materialise, mix, row_key, signed, trim
from vigil.llm.decontaminate import window_hashes
from vigil.llm.fm_index import FMIndex

GRAM = 10
#: Words of text in a shard's index.
SHARD_WORDS = 400_000
#: Kinds of segments beyond which a minimiser's windows are dealt one by one.
MANY_KINDS = 2_000
#: Windows of a segment, or of a run of segments, that a bit mask has room for.
MOST_WINDOWS = 60
_PARTS = pa.list_(pa.struct([("minimiser", pa.int64()), ("content", pa.int64()), ("of", pa.int32()), ("n", pa.int32()), ("alone", pa.bool_())]))


def _gram(window: int) -> int:
    """Words of a minimiser; of long windows more, so that a segment never has more than MOST_WINDOWS."""
    return max(1, min(GRAM, window // 2), window + 1 - MOST_WINDOWS)


def segments_of(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of all documents in w: first window's word index, number of windows, minimiser hash of each segment."""
    gram = _gram(window)
    span = window - gram + 1
    g = window_hashes(h, gram)
    if len(g) < span:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    order = mix(g ^ np.uint64(0x5851F42D4C957F2D))
    order = order & ~np.uint64(63)  # room for the place, so that the leftmost of equals is the least
    views = np.lib.stride_tricks.sliding_window_view(order, span)
    place = np.empty(len(views), np.int64)
    for i in range(0, len(views), 1 << 15):
        place[i : i + (1 << 15)] = np.argmin(views[i : i + (1 << 15)], axis=1)
    place += np.arange(len(views))
    last = np.repeat(w.docs[1:], w.counts)
    at = np.arange(len(views))
    valid = at + window <= last[: len(views)]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    doc = np.repeat(np.arange(len(w.counts)), w.counts)[: len(views)]
    first[1:] |= valid[1:] & (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(valid & np.append(~valid[1:] | first[1:], True)) + 1
    return starts, ends - starts, g[place[starts]]


def _find_segments(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = np.asarray(b.column(0)), np.asarray(b.column(1))
            for i, _, w in blocks(b.column(2), "space", False):
                h = w.hashes()
                at, n, minimiser = segments_of(w, h, window)
                doc = np.searchsorted(w.docs, at, side="right") - 1
                with np.errstate(over="ignore"):
                    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), 0x9E3779B97F4A7C15, np.uint64)]))
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[:-1])])
                    end = at + n + window - 1
                    content = mix((total[end] - total[at]) * powers[len(h) - at] + n.astype(np.uint64)) if len(at) else minimiser
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[i + doc]), pa.array(k2[i + doc]), pa.array((at - w.docs[doc]).astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(signed(minimiser)), pa.array(signed(content))],
                    ["k1", "k2", "at", "n", "minimiser", "content"],
                )
        trim()

    return docs.mapInArrow(run, "k1 long, k2 long, at int, n short, minimiser long, content long")


def _by_doc(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """text, wanted: the texts that hold the kinds (k1, k2, at, ...), each with its kinds."""
    by_doc = materialise(kinds.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n", "minimiser", "content", "times", "whole", "alone")).alias("wanted")))
    return KeyFilter(kinds).apply(docs).join(by_doc, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted")).select("text", "wanted")


def _runs(doc: np.ndarray, at: np.ndarray, n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which segments, in order, begin what is indexed together: those that occur only as a whole, one behind the other, in runs."""
    first = np.append(True, ~(whole[1:] & whole[:-1] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + n[:-1])))[: len(at)]
    begin = 0
    for x, (f, a, end) in enumerate(zip(first.tolist(), at.tolist(), (at + n).tolist(), strict=True)):
        if f or end - begin > MOST_WINDOWS:
            first[x], begin = True, a
    return first


def _extract(docs: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """One row for each segment (or run of segments) to be indexed: spread (what deals it to a shard), words (hashes), times, parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, minimiser, content, times, whole, alone = (np.asarray(c) for c in b.column(1).flatten().flatten())
            doc = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(b.column(1))))
            by = np.lexsort((content, n, at, doc))
            at, n, minimiser, content, times, whole, alone = at[by].astype(np.int64), n[by].astype(np.int64), minimiser[by], content[by], times[by], whole[by], alone[by]
            firsts = np.append(np.flatnonzero(_runs(doc, at, n, whole)), len(doc))
            for i, j, w in blocks(b.column(0), "space", False):
                h = w.hashes()
                x, y = np.searchsorted(firsts, np.searchsorted(doc, [i, j]))
                if x == y:
                    continue
                r, ends = firsts[x:y], firsts[x + 1 : y + 1]
                all_of = slice(r[0], ends[-1])
                base = w.docs[doc[r] - i]
                spans = zip((base + at[r]).tolist(), (base + at[ends - 1] + n[ends - 1] + window - 1).tolist(), strict=True)
                parts = [minimiser[all_of], content[all_of], (at[all_of] - np.repeat(at[r], ends - r)).astype(np.int32), n[all_of].astype(np.int32), alone[all_of]]
                parts = pa.StructArray.from_arrays([pa.array(p) for p in parts], fields=list(_PARTS.value_type))
                parts = pa.ListArray.from_arrays(pa.array(np.append(r, ends[-1]) - r[0], pa.int32()), parts)
                made = pa.RecordBatch.from_arrays(
                    [pa.array(minimiser[r]), pa.array([h[p:q].tobytes() for p, q in spans], pa.binary()), pa.array(np.minimum.reduceat(times[all_of], r - r[0])), parts],
                    ["spread", "words", "times", "parts"],
                )
                yield from (made.slice(k, 10_000) for k in range(0, made.num_rows, 10_000))

    return _by_doc(kinds, docs).mapInArrow(run, "spread long, words binary, times long, parts array<struct<minimiser: long, content: long, of: int, n: int, alone: boolean>>")


def _windows(docs: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """Every window of the kinds: minimiser, content, of (place in the segment), own (hash), times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(1).to_pylist()
            for i, j, w in blocks(b.column(0), "space", False):
                g = window_hashes(w.hashes(), window)
                rows = [(s["minimiser"], s["content"], s["times"], int(w.docs[d]) + s["at"], s["n"]) for d in range(j - i) for s in wanted[i + d]]
                if not rows:
                    continue
                minimiser, content, times, at, n = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                row = np.repeat(np.arange(len(n)), n)
                of = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(minimiser[row]), pa.array(content[row]), pa.array(of.astype(np.int32)), pa.array(signed(g[at[row] + of])), pa.array(times[row])], ["minimiser", "content", "of", "own", "times"])
        trim()

    return _by_doc(kinds, docs).mapInArrow(run, "minimiser long, content long, of int, own long, times long")


def index_shard(table: pa.Table, window: int) -> pa.Table:
    """Bit masks of the windows, in each segment of a shard, that stand at least twice in the collection, by the shard's index."""
    raw = table.column("words").to_pylist()
    lengths = np.array([len(r) // 8 for r in raw])
    h = np.frombuffer(b"".join(raw), np.uint64)
    codes = np.unique(h, return_inverse=True)[1] + 2
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.ones(len(h) + len(lengths), np.int64)  # symbol 1 parts the segments
    text[np.arange(len(h)) + np.repeat(np.arange(len(lengths)), lengths)] = codes
    times = np.minimum(np.asarray(table.column("times")), 2)
    index = FMIndex(text, int(lengths.max(initial=1)), np.repeat(times, lengths + 1))
    found = index.repeated_windows(text, begins, lengths, window)
    parts = table.column("parts").combine_chunks()
    row = np.repeat(np.arange(len(lengths)), np.diff(np.asarray(parts.offsets)))
    minimiser, content, of, n, alone = (np.asarray(c) for c in parts.flatten().flatten())
    mask = (found[row] >> of.astype(np.int64)) & ((np.int64(1) << n.astype(np.int64)) - 1)
    some = mask != 0
    del text, codes, h, raw, index
    trim()
    return pa.table({"minimiser": pa.array(minimiser[some]), "content": pa.array(content[some]), "mask": pa.array(mask[some]), "alone": pa.array(alone[some])})


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """k1, k2, and places: an array of (at, mask), where bit i says that the window from word at + i occurs elsewhere.

    docs has k1, k2, text.
    """
    found = materialise(_find_segments(docs, window))
    shared = materialise(found.groupBy("minimiser").agg(F.count("*").alias("times")).where("times > 1").select("minimiser"))
    some = materialise(found.join(shared, "minimiser", "left_semi"))
    discard(found, shared)
    kinds = some.groupBy("minimiser", "content", "n").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "at")).alias("where"))
    kinds = materialise(kinds.select("minimiser", "content", "n", "times", "where.*"))
    per = materialise(kinds.groupBy("minimiser").agg(F.count("*").alias("kinds")))
    all_kinds = materialise(kinds.join(per, "minimiser").withColumn("whole", F.col("kinds") == 1))
    discard(kinds, per)

    few = all_kinds.where(F.col("kinds") <= MANY_KINDS)
    many = materialise(_windows(docs, all_kinds.where(F.col("kinds") > MANY_KINDS).withColumn("alone", F.lit(False)), window))
    place = all_kinds.select("minimiser", "content", "k1", "k2", "at")
    again = many.groupBy("own").agg(F.sum("times").alias("times"), F.min(F.struct("minimiser", "content", "of")).alias("one")).where("times > 1")
    again = materialise(again.select("own", "times", "one.*"))
    again_at = again.join(place, ["minimiser", "content"]).select(F.col("own").alias("minimiser"), F.col("own").alias("content"), F.lit(1).cast("short").alias("n"), "times", "k1", "k2", (F.col("at") + F.col("of")).alias("at"), F.lit(False).alias("whole"))
    asked = materialise(few.select(*again_at.columns, F.lit(False).alias("alone")).unionByName(again_at.withColumn("alone", F.lit(True))))

    words = asked.agg(F.sum(F.when(F.col("whole"), 2 * F.col("n")).otherwise(F.col("n") + window))).first()[0] or 0
    dealt = _extract(docs, asked, window).withColumn("shard", F.pmod(F.xxhash64("spread"), F.lit(1 + words // SHARD_WORDS)))
    masks = materialise(dealt.groupBy("shard").applyInArrow(lambda t: index_shard(t, window), "minimiser long, content long, mask long, alone boolean"))
    discard(asked)
    of_many = many.join(materialise(masks.where("alone").select(F.col("content").alias("own"))), "own", "left_semi")
    of_many = of_many.groupBy("minimiser", "content").agg(F.bit_or(F.expr("shiftleft(1L, of)")).alias("mask"))
    all_masks = materialise(masks.where("NOT alone").select("minimiser", "content", "mask").unionByName(of_many))
    discard(masks, many, again)
    hits = some.join(all_masks, ["minimiser", "content"])
    places = materialise(hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "mask")).alias("places")))
    discard(some, all_masks, all_kinds)
    return places


def _spared(words: list[bytes], places: Iterator[tuple[int, int]], window: int) -> list[bytes]:
    """The words that are in no window of the places (at, mask)."""
    spans = []
    for at, m in places:
        while m:
            # a run of ones, from bit i to below bit j, is windows in a row
            beyond = m + (m & -m)
            i, j = (m & -m).bit_length() - 1, (m ^ beyond).bit_length() - 1
            spans.append((at + i, at + j - 1 + window))
            m &= beyond
    kept, done = [], 0
    for begin, end in sorted(spans):
        if begin > done:
            kept += words[done:begin]
        done = max(done, end)
    return kept + words[done:]


def _stripped(docs: DataFrame, window: int, out: dict[str, str], one: Callable[[bytes, list[bytes], list[bytes] | None], tuple]) -> DataFrame:
    """docs' columns but the text, as a struct `row`, and the columns `out`, which `one` makes of a row's text, words and kept words (None: all)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]
    row = F.struct(*others).alias("row")
    wide = docs.select(*row_key(), F.col("text").cast("string").alias("text"), row)
    places = repeated_windows(wide.select("k1", "k2", "text"), window)
    schema = T.StructType([T.StructField("row", wide.schema["row"].dataType), *T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in out.items())).fields])
    types = [pa.string() if t == "string" else pa.int64() for t in out.values()]
    known = KeyFilter(places)
    may_be_touched = known.test

    def run(touched: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not touched:
                    b = b.filter(pc.invert(may_be_touched(b.column(2))))
                sizes, places = repeat(0), iter(())
                if touched:
                    sizes = pc.list_value_length(b.column(2)).fill_null(0).to_pylist()
                    places = zip(*(c.to_pylist() for c in b.column(2).flatten().flatten()), strict=True)
                made = []
                for text, n in zip(b.column(0).cast(pa.binary()), sizes):
                    raw = text.as_py()
                    words = (raw or b"").split()  # bytes are parted at ASCII white space alone
                    made.append(one(raw, words, _spared(words, islice(places, n), window) if n else None))
                cols = list(zip(*made, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["row", *out])
            trim()

        return go

    with_places = known.apply(wide).join(places, ["k1", "k2"], "left").select("text", "row", "places").mapInArrow(run(True), schema)
    return with_places.unionByName(wide.select("text", "row", "k2").mapInArrow(run(False), schema))


def digest(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""

    def one(raw: bytes | None, words: list[bytes], kept: list[bytes] | None) -> tuple:
        left = words if kept is None else kept
        return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()

    out = _stripped(docs.select("doc_id", "text"), window, {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}, one)
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def drop_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """docs with repeated passages taken out of the text (the words left are joined by a space); columns stay.

    Texts that lose nothing stay as they are; n_chars, where it is a column, follows the text of the others.
    """

    def one(raw: bytes | None, words: list[bytes], kept: list[bytes] | None) -> tuple:
        if kept is None or len(kept) == len(words):
            return (None if raw is None else raw.decode()), None
        text = b" ".join(kept).decode()
        return text, len(text)

    out = _stripped(docs, window, {"new_text": "string", "new_chars": "long"}, one)
    cols = []
    for f in docs.schema:
        old = F.col(f"row.`{f.name}`")
        cols.append(F.col("new_text").alias("text") if f.name == "text" else (F.coalesce(F.col("new_chars").cast(f.dataType), old) if f.name == "n_chars" else old).alias(f.name))
    return out.select(*cols)
