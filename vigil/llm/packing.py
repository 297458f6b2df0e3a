"""Packing documents into fixed-length sequences as a cutting-stock problem, solved by column generation.

A document of more than `capacity` tokens is cut into whole sequences and a rest; nothing else is cut. Piece lengths
are rounded up to one of UNITS classes, and only the class histogram (at most UNITS rows) reaches the driver. There a
linear program chooses how often to use each pattern (a multiset of classes that fits a sequence); knapsack dynamic
programming prices new patterns from the program's duals until none improves it. Pattern counts are rounded down, so at
most one sequence for each of at most UNITS basic patterns, or UNITS * UNITS pieces, is left; those are placed best-fit
decreasing by their true lengths. Every piece gets its rank within its class and so its pattern, sequence and slot.

Ranks come from hashed buckets of a class (their sizes summed up, then numbered within), so that a class which holds a
third of all pieces is spread over many tasks; the hash is of a piece's place, which repeated rows don't share. Null text counts as empty and still has its end token. Rows that repeat
are packed as often as they occur; null doc_ids are packed as well. An empty table gives no sequences. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.bpe import BLOCK_BYTES, encoder, forget
from vigil.llm.common import inverted, materialise, trim

UNITS = 256
#: Bytes of text that a worker encodes together where memory is short.
_LEAN_BYTES = 1 << 20
#: Pieces that a bucket of a class should have at most.
_BUCKET_ROWS = 50_000
_TOLERANCE = 1e-9
#: The linear program is solved to this share above its bound.
_GAP = 5e-4
#: How much of the prices with the best bound so far goes into those that a pattern is sought for.
_STEADY = 0.9


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False, lean: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, place (a number of its own), and with keep_ids their ids (binary).

    lean: workers take smaller blocks and keep no tokenizer between tasks, at the cost of time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, place = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j, ids, at in enc.ended(b.column(1), end_id, _LEAN_BYTES if lean else BLOCK_BYTES):
                raw = memoryview(ids.astype("<u4").tobytes())
                n = np.diff(at)
                parts = -(-n // capacity)
                row = np.repeat(np.arange(j - i), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
                length = np.minimum(capacity, n[row] - start)
                begin = (at[row] + start) * 4
                spans = list(zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True))
                crc = pa.array([zlib.crc32(raw[x:y]) for x, y in spans], pa.int64())
                kept = pa.array([bytes(raw[x:y]) for x, y in spans] if keep_ids else [None] * len(spans), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + row)), pa.array(start), pa.array(length), crc, pa.array(n[row]), pa.array(place + np.arange(len(row))), kept], [f.split()[0] for f in schema.split(", ")])
                place += len(row)
            if lean:
                b = ids = raw = None
                trim()
        if lean:
            enc = None
            forget()
            trim()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long, ids binary"
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
    return pieces if keep_ids else pieces.drop("ids")


def _price(duals: np.ndarray, sizes: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest worth that fits `units` (unbounded knapsack)."""
    gain = np.full(units + 1, -np.inf)  # of a piece of each size; nothing for a unit left empty
    gain[sizes] = duals
    gain[1] = max(gain[1], 0.0)
    best, took = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for room in range(1, units + 1):
        worth = gain[1 : room + 1] + best[room - 1 :: -1] if room > 1 else gain[1:2] + best[:1]
        k = int(worth.argmax())
        best[room], took[room] = worth[k], k + 1
    pattern, room = np.zeros(units + 1), units
    while room > 0:
        pattern[took[room]] += 1
        room -= took[room]
    pattern = pattern[sizes]
    if len(sizes) and sizes[0] == 1 and duals[0] <= 0:
        pattern[0] = 0
    return float(best[units]), pattern


def cutting_stock(demand: dict[int, int], units: int = UNITS, most: int = 5000) -> list[tuple[dict[int, int], float]]:
    """Patterns {class: pieces} and how often to use each (a fraction), for demand pieces of each class of 1..units.

    The revised simplex method; products are sums of elementwise ones, as matrices have at most UNITS rows.
    """
    sizes = np.array(sorted(c for c, n in demand.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(c)] for c in sizes], dtype=float)
    basis = np.diag((units // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    bound, steady = 0.0, None
    for step in range(most):
        if step % 100 == 99:
            inverse = inverted(basis)
        x = (inverse * need).sum(axis=1)
        duals = inverse.sum(axis=0)
        steady = duals if steady is None else _STEADY * steady + (1 - _STEADY) * duals
        worth, pattern = _price(steady, sizes, units)
        held = float((steady * need).sum()) / worth  # no plan has fewer sequences
        if held > bound:
            bound, centre = held, steady
        steady = centre
        if (duals * pattern).sum() <= 1 + 1e-9:  # the steady prices mislead: take the true ones
            worth, pattern = _price(duals, sizes, units)
            bound = max(bound, float(x.sum()) / worth)
        if x.sum() - bound <= max(0.5, _GAP * bound) or worth <= 1 + 1e-9:
            break
        direction = (inverse * pattern).sum(axis=1)
        ratio = np.where(direction > _TOLERANCE, np.maximum(x, 0) / np.where(direction > _TOLERANCE, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse -= direction[:, None] * row
        inverse[out] = row
    x = (inverted(basis) * need).sum(axis=1)
    return [({int(c): int(k) for c, k in zip(sizes, basis[:, j], strict=True) if k}, max(0.0, float(x[j]))) for j in range(len(sizes))]


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """(class, rank, sequence, slot) for (class, rank, length): longest first, each where it leaves least room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    out = []
    open_rooms = np.zeros(capacity + 1, dtype=np.int64)
    for c, r, n in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        fits = np.flatnonzero(open_rooms[n:])
        if len(fits):
            room = n + int(fits[0])
            s = rooms[room].pop()
            open_rooms[room] -= 1
        else:
            room, s = capacity, len(filled)
            filled.append(0)
        out.append((c, r, s, filled[s]))
        filled[s] += 1
        rooms[room - n].append(s)
        open_rooms[room - n] += 1
    return out


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (with columns length and place) with sequence_id and offset; other columns stay."""
    unit = -(-capacity // UNITS)
    pieces = pieces.withColumn("_class", F.ceil(F.col("length") / unit).cast("int"))
    demand = {r["_class"]: r["count"] for r in pieces.groupBy("_class").count().collect()}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}  # class: (rank from, sequence from, pieces a sequence, slot from)
    used, sequences = dict.fromkeys(demand, 0), 0
    for pattern, times in cutting_stock(demand, capacity // unit):
        n, slot = int(times + 1e-6), 0
        n = min([n, *((demand[c] - used[c]) // k for c, k in pattern.items())])
        if n:
            for c, k in pattern.items():
                runs.setdefault(c, []).append((used[c], sequences, k, slot))
                used[c] += n * k
                slot += k
            sequences += n
    buckets = max(256, max(demand.values(), default=0) // _BUCKET_ROWS)
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    at = Window.partitionBy("_class").orderBy("_bucket")
    bases = pieces.groupBy("_class", "_bucket").agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(at) - F.col("_n")).drop("_n")
    within = Window.partitionBy("_class", "_bucket").orderBy("place")
    ranked = pieces.withColumn("_rank", F.row_number().over(within)).join(bases, ["_class", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_rank") - 1).drop("_base", "_bucket")
    ranked = materialise(ranked)
    rest_from = F.create_map(*[F.lit(x) for c in used for x in (c, used[c])])[F.col("_class")] if used else F.lit(0)
    rest = [tuple(r) for r in ranked.where(F.col("_rank") >= rest_from).select("_class", "_rank", "length").collect()]
    left = {(c, r): (s, slot) for c, r, s, slot in best_fit(rest, capacity)}
    shared = pieces.sparkSession.sparkContext.broadcast((runs, used, sequences, left))

    names = ranked.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, used, first_left, left = shared.value
        table = {c: np.array(x, dtype=np.int64) for c, x in runs.items()}
        for b in batches:
            c, r = np.asarray(b.column(names.index("_class"))), np.asarray(b.column(names.index("_rank"))).astype(np.int64)
            sequence, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c).tolist():
                mine = np.flatnonzero(c == k)
                regular = mine[r[mine] < used[k]]
                if len(regular):
                    t = table[k]
                    row = t[np.searchsorted(t[:, 0], r[regular], side="right") - 1]
                    j = r[regular] - row[:, 0]
                    sequence[regular] = row[:, 1] + j // row[:, 2]
                    slot[regular] = row[:, 3] + j % row[:, 2]
                for i in mine[r[mine] >= used[k]]:
                    s, slot[i] = left[k, int(r[i])]
                    sequence[i] = first_left + s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "_slot"])

    from pyspark.sql import types as T

    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in ranked.schema), T.StructField("sequence_id", T.LongType()), T.StructField("_slot", T.LongType())])
    order = Window.partitionBy("sequence_id").orderBy("_slot")
    placed = ranked.mapInArrow(assign, schema)
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length")).drop("_class", "_rank", "_slot")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, keep_ids: bool = False, lean: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids), sequence_id, offset of each piece of all documents."""
    return pack(materialise(cut(docs, tokenizer, end_id, capacity, keep_ids, lean)), capacity).drop("place")
