"""Language-model scores from a hidden Markov model over word classes, trained by distributed Baum-Welch.

Tokens are the words of the lower-cased text (A-Z only) and one end. A word's class is a slice of its 64-bit hash
(CLASSES of them, and one for the end), so the emission table has a fixed size whatever the vocabulary. The model is
  p(text) = p_HMM(classes of the text) * product of p(word | class),   p(word | class) = (c + 1) / (C + V + 1)
with c the word's count in training texts, C the tokens and V the distinct words of its class, all of the training rows.

Training. Each round, tasks run scaled forward and backward passes over their rows and return expected counts of starts,
transitions and emissions; these are summed over all partitions and make the next model. Every one of the ROUNDS rounds
looks at all training rows. A document is a sequence of its own. Documents of at most SEGMENT tokens are passed as a
whole; longer ones in segments of so many tokens with AROUND more of the same document on either side, which carry the
messages over the border (all that lies further away is taken for its long-run share). Every token and every transition
is counted once, starts only where documents begin.

Scoring. The scaled forward recursion runs over whole texts, so the class sequence's likelihood is exact. Word counts
are exact as well: the most frequent words, at most FREQUENT, are broadcast, all others are joined by a shuffle.

`base_score` is the unigram score with add-one smoothing: sum of log10((c + 1) / (N + V + 1)) over all tokens.

Null and blank texts have one token, the end. Rows that repeat are counted and scored as often as they occur. Null
doc_ids are training rows. Without training rows every count is 0 and the model is uniform. An empty table gives no
rows; other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Words, blocks, materialise, signed

STATES = 6
CLASSES = 8192
SEGMENT = 112
AROUND = 16
#: Segments that are looked at together.
AT_ONCE = 2048
#: Steps of the forward recursion from one scaling to the next: no product of so many emissions leaves a double's range.
UNSCALED = 8
FREQUENT = 1 << 17
ROUNDS = 10
END = np.uint64(0x0123456789ABCDEF)
_COUNT_SCHEMA = "word long, n long"
#: Distinct words that a task counts before it hands them on.
_COUNTED = 400_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def tokens_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all documents in w, each with its end, and where each document's begin (and the end of all)."""
    h, n = w.hashes(), w.counts
    at = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(at[-1]), END, np.uint64)
    if len(h):
        out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, at


def classes_of(tokens: np.ndarray) -> np.ndarray:
    return np.where(tokens == END, CLASSES, tokens >> np.uint64(64 - CLASSES.bit_length() + 1)).astype(np.uint16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = [], []

    def total() -> tuple[np.ndarray, np.ndarray]:
        w, at = np.unique(np.concatenate(words), return_inverse=True)
        return w, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

    def out(w: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(w), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(signed(w[i : i + 100_000])), pa.array(c[i : i + 100_000])], ["word", "n"])

    for b in batches:
        for _, _, w in blocks(b.column(0), "space", True):
            x, c = np.unique(tokens_of(w)[0], return_counts=True)
            words.append(x)
            counts.append(c)
            if sum(map(len, words)) > 2 * _COUNTED:
                x, c = total()
                if len(x) > _COUNTED:
                    yield from out(x, c)
                    words, counts = [], []
                else:
                    words, counts = [x], [c]
    if words:
        yield from out(*total())


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, w in blocks(b.column(0), "space", True):
            t, at = tokens_of(w)
            raw = classes_of(t).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[2 * x : 2 * y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["classes"])


class HMM:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K), (K, K), (classes + 1, K)

    @classmethod
    def initial(cls, frequency: np.ndarray) -> HMM:
        """Sticky states, each with the class frequencies shaken by fixed random factors."""
        rng = np.random.default_rng(11)
        emit = frequency[:, None] * rng.uniform(0.3, 1.7, (len(frequency), STATES))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    def stationary(self) -> np.ndarray:
        """The distribution of states far from a text's start."""
        p = self.start
        for _ in range(200):
            p = (p[:, None] * self.move).sum(axis=0)
        return p

    def expected(self, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions over the documents seq[at[i] : at[i + 1]]."""
        n = np.diff(at)
        parts = -(-n // SEGMENT)
        doc = np.repeat(np.arange(len(n)), parts)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        low, end = np.maximum(first - AROUND, 0), np.minimum(first + SEGMENT, n[doc])
        begin, length, lead, own = at[:-1][doc] + low, np.minimum(end + AROUND, n[doc]) - low, first - low, end - low
        order = np.argsort(-length, kind="stable")
        starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))
        for i in range(0, len(order), AT_ONCE):
            o = order[i : i + AT_ONCE]
            for total, more in zip((starts, moves, emits), self._passes(seq, begin[o], length[o], lead[o], own[o]), strict=True):
                total += more
        return starts, moves, emits

    def _passes(self, seq: np.ndarray, begin: np.ndarray, length: np.ndarray, lead: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward passes over segments, longest first; tokens lead to own of each are counted."""
        steps = int(length[0])
        active = np.searchsorted(-length, -np.arange(steps), side="left")  # segments with more tokens than that
        move, emit = self.move.astype(np.float32), np.ascontiguousarray(self.emit.T, np.float32)  # counts need no more digits
        back = np.ascontiguousarray(move.T)
        prior = np.where(lead == 0, self.start[:, None], self.stationary()[:, None]).astype(np.float32)
        a, given, seen = [], [], []  # a row for each state, so that arrays run along the segments
        for t, m in enumerate(active.tolist()):
            e = seq[begin[:m] + t]
            g = emit.take(e, axis=1)
            x = (prior if t == 0 else back @ a[-1][:, :m]) * g
            s = 1 / x.sum(axis=0)
            x *= s
            g *= s
            a.append(x)
            given.append(g)
            seen.append(e)
        moves, b = np.zeros((STATES, STATES)), np.ones((STATES, int(active[-1])), np.float32)
        for t in reversed(range(steps)):
            if t < steps - 1:
                m = int(active[t + 1])
                ahead = given.pop()
                ahead *= b
                b = np.ones((STATES, int(active[t])), np.float32)
                np.matmul(move, ahead, out=b[:, :m])
                mine = (lead[:m] <= t + 1) & (t + 1 < own[:m])
                if not mine.all():
                    ahead *= mine
                moves += (a[t][:, :m] @ ahead.T) * self.move
            m = int(active[t])
            a[t] *= b
            mine = (lead[:m] <= t) & (t < own[:m])
            if not mine.all():
                a[t] *= mine
        flat, where = np.concatenate(a, axis=1), np.concatenate(seen).astype(np.intp)
        emits = np.column_stack([np.bincount(where, x, CLASSES + 1) for x in flat])
        return a[0][:, lead == 0].sum(axis=1, dtype=np.float64), moves, emits

    def log10_likelihoods(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each whole sequence seq[at[i] : at[i + 1]], by the scaled forward recursion."""
        n = np.diff(at)
        order = np.argsort(-n, kind="stable")
        n, begin = n[order], at[:-1][order]
        total, active = np.zeros(len(n)), len(n)
        move, emit = np.ascontiguousarray(self.move.T), np.ascontiguousarray(self.emit.T)
        state = np.broadcast_to(self.start[:, None], (STATES, active))
        for t in range(int(n[0]) if len(n) else 0):
            x = (state if t == 0 else move @ state) * emit.take(seq[begin[:active] + t], axis=1)
            left = active
            while left and n[left - 1] <= t + 1:
                left -= 1
            if left < active:
                total[left:active] += np.log10(x[:, left:].sum(axis=0))
                x, active = x[:, :left], left
            if t % UNSCALED == UNSCALED - 1:
                s = x.sum(axis=0)
                total[:active] += np.log10(s)
                x = x / s
            state = x
        out = np.empty(len(n))
        out[order] = total
        return out


def together(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of some documents of a column, and where each one's begin (and the end of all): about as many tokens as are passed at once."""
    end = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(column), np.int64) // 2)])
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(end, end[i] + AT_ONCE * SEGMENT, side="right")) - 1)
        yield np.frombuffer(b"".join(column.slice(i, j - i).to_pylist()), np.uint16), end[i : j + 1] - end[i]
        i = j


def _round(sequences: DataFrame, model: HMM, frequency: np.ndarray) -> HMM:
    shared = sequences.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        start, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))
        for b in batches:
            for seq, at in together(b.column(0)):
                s, t, e = m.expected(seq, at)
                start, moves, emits = start + s, moves + t, emits + e
        table = np.vstack([emits, start, moves])
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(table[some, k]) for k in range(STATES))], ["row", *(f"s{k}" for k in range(STATES))])

    parts = sequences.select("classes").mapInArrow(run, "row int, " + ", ".join(f"s{k} double" for k in range(STATES)))
    table = np.zeros((CLASSES + 2 + STATES, STATES))
    for r in parts.groupBy("row").agg(*[F.sum(f"s{k}") for k in range(STATES)]).collect():
        table[r[0]] = r[1:]
    emit = table[: CLASSES + 1] + 200 * frequency[:, None]
    start, move = table[CLASSES + 1] + 1, table[CLASSES + 2 :] + 0.1
    return HMM(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(rows: DataFrame, frequency: np.ndarray) -> HMM:
    """rows: text of training documents; frequency: a smoothed distribution of classes."""
    sequences = materialise(rows.select("text").mapInArrow(_sequences, "classes binary"))
    model = HMM.initial(frequency)
    for _ in range(ROUNDS):
        model = _round(sequences, model, frequency)
    return model


def _least_count(counts: DataFrame) -> int:
    """The least power of two such that at most FREQUENT words occur so often."""
    by_size = counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("words")).orderBy(F.desc("k")).collect()
    seen, least = 0, 1 << 62
    for r in by_size:
        seen += r.words
        if seen > FREQUENT:
            break
        least = 1 << int(r.k)
    return least


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    training = rows.where("NOT held_out")
    counts = materialise(training.select("text").mapInArrow(_count, _COUNT_SCHEMA).groupBy("word").agg(F.sum("n").alias("n")))
    size, vocabulary = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())

    end = int(signed(np.array([END]))[0])
    class_of = F.when(F.col("word") == end, CLASSES).otherwise(F.shiftrightunsigned("word", 64 - CLASSES.bit_length() + 1))
    per_class = np.zeros((CLASSES + 1, 2))
    for r in counts.groupBy(class_of.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        per_class[r.c] = r.n, r.v
    mass = per_class.sum(axis=1) + 1
    model = train(training, mass / mass.sum())

    top = counts.where(F.col("n") >= _least_count(counts)).collect()
    words = np.array([r.word for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    known = words[order], np.array([r.n for r in top], np.int64)[order]
    shared = spark.sparkContext.broadcast((model, np.log10(mass), known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, log_mass, (words, n) = shared.value
        number = TaskContext.get().partitionId() << 33
        log_n = np.log10(n + 1.0)
        for b in batches:
            for i, j, w in blocks(b.column(1), "space", True, 4 << 20):
                t, at = tokens_of(w)
                seq = classes_of(t).astype(np.int64)
                hmm = model.log10_likelihoods(seq, at)
                found = np.minimum(np.searchsorted(words, t), max(0, len(words) - 1))
                hit = words[found] == t if len(words) else np.zeros(len(t), bool)
                value = np.where(hit, log_n[found], 0.0) if len(words) else np.zeros(len(t))
                rest = np.flatnonzero(~hit)
                doc = np.searchsorted(at, rest, side="right") - 1
                part = np.add.reduceat(np.column_stack([value, log_mass[seq], hit]), at[:-1])
                begins = np.searchsorted(doc, np.arange(j - i + 1))
                rare = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(signed(t[rest])))
                ids = number + np.arange(j - i)
                number += j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(at)), pa.array(part[:, 2].astype(np.int64)), pa.array(part[:, 0]), pa.array(hmm - part[:, 1]), rare],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "shape", "rare"],
                )

    scored = materialise(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, shape double, rare array<long>"))
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_logs"))
    out = scored.drop("rare").join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(size).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(size + vocabulary + 1)))).alias("base_score"),
        (logs + F.col("shape")).alias("score"),
    )
