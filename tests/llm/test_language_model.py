from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.fixtures import awkward, empty
from vigil.llm import hmm
from vigil.llm.hmm import CLASSES, HMM, STATES, score_texts


def small_model():
    rng = np.random.default_rng(4)
    emit = rng.random((CLASSES + 1, STATES))
    move = rng.random((STATES, STATES))
    return HMM(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_forward_against_all_paths():
    m = small_model()
    seqs = [[3, 8, CLASSES], [CLASSES], [5, 5, 9, CLASSES]]
    at = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    got = m.log10_likelihoods(np.array(sum(seqs, [])), at)
    for s, x in zip(seqs, got, strict=True):
        total = 0.0
        for path in itertools.product(range(STATES), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for a, b, o in zip(path, path[1:], s[1:], strict=False):
                p *= m.move[a, b] * m.emit[o, b]
            total += p
        assert x == pytest.approx(math.log10(total))


def test_expected_counts_against_all_paths():
    m, s = small_model(), [3, 8, 8, 1]
    weights, starts, moves, emits = 0.0, np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))
    for path in itertools.product(range(STATES), repeat=len(s)):
        p = m.start[path[0]] * m.emit[s[0], path[0]]
        for a, b, o in zip(path, path[1:], s[1:], strict=False):
            p *= m.move[a, b] * m.emit[o, b]
        weights += p
        starts[path[0]] += p
        for a, b in zip(path, path[1:], strict=False):
            moves[a, b] += p
        for k, o in zip(path, s, strict=True):
            emits[o, k] += p
    alone = m.expected(np.array(s), np.array([0, 4]))
    for a, b in zip(alone, (starts, moves, emits), strict=True):
        assert np.allclose(a, b / weights)
    # documents are sequences of their own: the counts of several are the sum of each one's
    other = m.expected(np.array([5, 1, 8]), np.array([0, 3]))
    both = m.expected(np.array([5, 1, 8, *s, 8]), np.array([0, 3, 7, 8]))
    last = m.expected(np.array([8]), np.array([0, 1]))
    for a, b, c, d in zip(both, alone, other, last, strict=True):
        assert np.allclose(a, b + c + d)


def test_long_documents_in_segments(monkeypatch):
    m, rng = small_model(), np.random.default_rng(4)
    seq, at = rng.integers(0, 9, 700), np.array([0, 3, 500, 540, 700])
    monkeypatch.setattr(hmm, "SEGMENT", 1000)
    whole = m.expected(seq, at)
    monkeypatch.setattr(hmm, "SEGMENT", 40)
    monkeypatch.setattr(hmm, "AROUND", 60)
    monkeypatch.setattr(hmm, "AT_ONCE", 3)
    for a, b in zip(m.expected(seq, at), whole, strict=True):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-3)
    assert whole[0].sum() == pytest.approx(4) and whole[1].sum() == pytest.approx(696) and whole[2].sum() == pytest.approx(700)


def test_segments_are_passed_together(monkeypatch):
    """Short documents share a pass as far as AT_ONCE allows, however many they are; long ones don't exceed it by more than one."""
    column = pa.array([np.array([3, 8, CLASSES], np.uint16).tobytes()] * 2000 + [b""] + [np.full(900, 5, np.uint16).tobytes()] * 3)
    m, passes, real = small_model(), [], HMM._passes
    monkeypatch.setattr(HMM, "_passes", lambda self, seq, begin, *rest: passes.append(len(begin)) or real(self, seq, begin, *rest))
    got = [m.expected(seq, at) for seq, at in hmm.together(column)]
    assert passes == [2000 + 3 * -(-900 // hmm.SEGMENT)]
    monkeypatch.setattr(hmm, "AT_ONCE", 4)
    parts = [np.diff(at).tolist() for _, at in hmm.together(column)]
    assert sum(parts, []) == [3] * 2000 + [0] + [900] * 3 and all(sum(x) <= 4 * hmm.SEGMENT or len(x) == 1 for x in parts)
    few = [m.expected(seq, at) for seq, at in hmm.together(column)]
    for a, b in zip(zip(*got, strict=True), zip(*few, strict=True), strict=True):
        assert np.allclose(sum(a), sum(b), rtol=1e-5)


def test_likelihood_of_rare_classes_stays_in_range():
    """Emissions as small as a corpus of 1e15 tokens makes them, over many steps between scalings, and texts that end at each of them."""
    m = HMM(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 1 / STATES), np.full((CLASSES + 1, STATES), 1e-28))
    n = np.arange(1, 40)
    got = m.log10_likelihoods(np.zeros(n.sum(), np.int64), np.concatenate([[0], np.cumsum(n)]))
    assert np.allclose(got, -28.0 * n, rtol=1e-12)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(0)
    seq = np.concatenate([rng.integers(0, 20, 64) + 20 * (i % 2) for i in range(40)])
    frequency = np.bincount(seq, minlength=CLASSES + 1) + 1e-3
    model, last = HMM.initial(frequency / frequency.sum()), -np.inf
    for _ in range(5):
        now = model.log10_likelihoods(seq, np.arange(0, len(seq) + 1, 64)).sum()
        assert now > last - 1e-9
        last = now
        s, t, e = model.expected(seq, np.arange(0, len(seq) + 1, 64))
        model = HMM(s / s.sum(), t / t.sum(axis=1, keepdims=True), (e + 1e-12) / (e + 1e-12).sum(axis=0))


@pytest.mark.parametrize("frequent", [1 << 17, 3])
def test_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    docs = awkward(spark, False)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = [[*brute.WORD.findall((t or "").translate(brute.LOWER)), None] for _, t in rows]
    c = Counter(x for (d, _), w in zip(rows, words, strict=True) if not held(d) for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted([(d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for (d, _), w in zip(rows, words, strict=True)], key=repr)
    got = score_texts(docs).collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_better_than_the_base_on_held_out_rows(spark):
    got = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_every_round_sees_all_training_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(d, f"a{d} b c") for d in range(20)], "doc_id long, text string")
    seen, real = [], hmm._round

    def spy(sequences, model, frequency):
        seen.append(sequences.count())
        return real(sequences, model, frequency)

    monkeypatch.setattr(hmm, "_round", spy)
    score_texts(docs).count()
    assert len(seen) == 10 and set(seen) == {sum(zlib.crc32(str(d).encode()) % 7 != 2 for d in range(20))}


def test_nothing_to_learn_from(spark):
    assert score_texts(empty(spark)).count() == 0
    only = spark.createDataFrame([(d, "a b") for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.n_known, r.base_score) for r in score_texts(only).collect()} == {(0, 0.0)}
