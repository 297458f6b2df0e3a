from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.fixtures import awkward, empty, pairs, rows_of
from vigil.llm.common import inverted
from vigil.llm.packing import best_fit, cut, cutting_stock, pack_documents
from vigil.llm.quality import BOILERPLATE, clean_documents, quality_rules
from vigil.llm.sharding import assign_shards, jump_hash

DIGEST10 = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.mark.parametrize("unique", [True, False])
def test_quality_base_against_brute_force(spark, unique):
    docs = awkward(spark, unique)
    assert rows_of(quality_rules(docs), *DIGEST10) == sorted([(d, *brute.base_rules(t)) for d, t in pairs(docs)], key=repr)
    assert quality_rules(empty(spark)).count() == 0


FURNITURE = ["Home | News | Sport", "Read more » here » now", "COPYRIGHT 2020 ALL OF US HERE", "buy now!! cheap!! wow", "a / b / c / d", "short", "Ends well.", "ok then:", "# $ % & | <", "Alle Rechte vorbehalten.", "Une ligne simple, sans plus.", "\tTabbed line of some words", "Was soll das hier, bitte?", "  "]


@pytest.mark.parametrize("source", ["awkward", "lines"])
def test_quality_verdict_and_cleaning_against_brute_force(spark, source):
    if source == "awkward":
        docs = awkward(spark, False)
    else:
        rng = random.Random(7)
        texts = ["\n".join(rng.choice(FURNITURE) if rng.random() < p else f"Sentence {rng.randrange(40)} of this text says {rng.randrange(10**6)} things, and ends." for _ in range(rng.randint(1, 12))) for p in (0.1, 0.4, 0.7, 0.9) for _ in range(60)]
        docs = spark.createDataFrame([(i, t, i, "r") for i, t in enumerate(texts)], "doc_id long, text string, clean int, row string")
    want = [(d, brute.cleaned(t or "", BOILERPLATE)) for d, t in pairs(docs)]
    assert rows_of(quality_rules(docs), "doc_id", "kept") == sorted([(d, c is not None) for d, c in want], key=repr)
    got = clean_documents(docs)
    assert got.columns == docs.columns and rows_of(got, "doc_id", "text") == sorted([(d, c) for d, c in want if c is not None], key=repr)
    assert 0 < got.count() < docs.count()
    assert clean_documents(docs.limit(0)).count() == 0


def test_quality_of_the_table_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    agree = Counter((r.quality, r.kept) for r in got.collect())
    assert agree[1, False] == 0 and agree[0, True] <= 0.05 * (agree[0, True] + agree[0, False])


def test_quality_lines(spark):
    good = "This sentence has words enough to stand, and it ends well.\n"
    nav = "Home | News | Sport | About us\n"
    docs = spark.createDataFrame([(1, good * 1 + "Another fine sentence, not at all like the other one."), (2, good + nav * 9), (3, nav + "Login | Join | Terms | Other pages to be seen here")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules(docs).collect()} == {1: True, 2: False, 3: False}


def jump(doc, shards):
    at, after, i = -1, 0, 0
    while after < shards:
        at = after
        seed = 42 if doc is None else xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest((i).to_bytes(4, "little"), seed)
        after = int((at + 1) / (((h >> 11) + 1) / (1 << 53)))
        i += 1
    return at


@pytest.mark.parametrize("unique", [True, False])
def test_sharding(spark, unique):
    docs = awkward(spark, unique)
    got = assign_shards(docs, 8).collect()
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in got], key=repr) == sorted([(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(docs)], key=repr)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in got)
    assert all((r.shard, r.grown_shard) == (jump(r.doc_id, 8), jump(r.doc_id, 9)) for r in got)
    assert assign_shards(empty(spark), 8).count() == 0


def test_sharding_into_many(spark):
    got = {r.id: r.s for r in spark.range(3000).select("id", jump_hash(F.col("id"), 1000).alias("s")).collect()}
    assert got == {i: jump(i, 1000) for i in range(3000)}


def test_sharding_moves_about_a_ninth(spark):
    got = assign_shards(spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text"), 8)
    n = Counter((r.shard, r.grown_shard) for r in got.collect())
    assert all(2300 < sum(v for (s, _), v in n.items() if s == k) < 2700 for k in range(8))
    assert 2000 < sum(v for (_, g), v in n.items() if g == 8) < 2450


def test_sharding_has_no_python(spark, sf):
    for make in (assign_shards, quality_rules, clean_documents):
        plan = make(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(spark, capacity):
    docs, path = awkward(spark, False), P.path("word_bpe_49k.json")
    got = pack_documents(docs, path, 2, capacity, keep_ids=True).collect()
    by_sequence, by_doc = {}, Counter()
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.start + r.length <= r.doc_tokens
    for places in by_sequence.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= capacity
    want = Counter()
    for doc, _, n, _ in brute.token_files(pairs(docs), path):
        want[doc] += n
    assert by_doc == want
    assert len(by_sequence) <= sum(want.values()) / capacity * 1.3 + 1
    assert pack_documents(empty(spark), path, 2).count() == 0


def test_packing_ids_are_the_texts(spark, sf):
    docs, path = spark.read.parquet(f"{sf}/documents.parquet"), P.path("word_bpe_49k.json")
    ids = {}
    for r in cut(docs, path, 2, 500, keep_ids=True).collect():
        ids.setdefault(r.doc_id, []).append((r.start, r.ids))
    want = {d: c for d, _, _, c in brute.token_files(pairs(docs), path)}
    assert {d: zlib.crc32(b"".join(x for _, x in sorted(p))) for d, p in ids.items()} == want


def test_lean_packing_cuts_alike(spark):
    docs, path = awkward(spark, False), P.path("word_bpe_49k.json")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows_of(cut(docs, path, 2, 64, lean=True), *columns) == rows_of(cut(docs, path, 2, 64), *columns)


def test_lean_packing_keeps_no_tokenizer(spark, monkeypatch):
    """The task's function is run here, as a worker would."""
    from pyspark import TaskContext

    from vigil.llm import bpe

    class Docs:
        def __getattr__(self, _):
            return lambda *x: setattr(self, "run", x[0]) or self

    monkeypatch.setattr(TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(bpe, "_ENCODERS", {})
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one text", None])], ["doc_id", "text"])
    for lean in (True, False):
        cut(docs := Docs(), P.path("word_bpe_49k.json"), 2, 64, True, lean)
        assert sum(b.num_rows for b in docs.run(iter([batch, batch]))) == 4
        assert bool(bpe._ENCODERS) is not lean
        assert not list(docs.run(iter([])))


def test_encoder_gives_the_tokenizer_few_pieces_at_once():
    from vigil.llm.bpe import Encoder

    enc, calls = Encoder(P.path("word_bpe_49k.json")), []

    class Counted:
        def __getattr__(self, name):
            return getattr(tok, name)

        def encode_batch_fast(self, pieces, **how):
            calls.append(len(pieces))
            return tok.encode_batch_fast(pieces, **how)

    tok, enc.tok = enc.tok, Counted()
    texts = [" ".join(f"a{i}-{k}" for k in range(100)) for i in range(90)]
    ((_, _, ids, at),) = enc.blocks(pa.array(texts))
    assert sum(calls) == 9000 and max(calls) <= 2000
    assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_cutting_stock_of_all_classes_ends():
    demand = {c: (c * 7919) % 97 + 3 * (257 - c) for c in range(1, 257)}
    plan = cutting_stock(demand)
    assert all(sum(c * k for c, k in p.items()) <= 256 for p, _ in plan)
    made = Counter()
    for p, times in plan:
        for c, k in p.items():
            made[c] += k * times
    assert all(made[c] == pytest.approx(n, abs=1e-3) for c, n in demand.items())
    bound = sum(c * n for c, n in demand.items()) / 256
    assert bound <= sum(t for _, t in plan) <= 1.01 * bound + 1


def test_inverse():
    rng = np.random.default_rng(1)
    m = rng.integers(0, 3, (40, 40)).astype(float) + np.diag(rng.permutation(40)[::-1] + 1.0)[::-1]
    assert np.allclose(inverted(m) @ m, np.eye(40))


def test_cutting_stock_is_near_its_bound():
    demand = {c: (c * 37) % 101 + 5 for c in range(3, 90, 7)}
    used = Counter()
    total = 0.0
    for pattern, times in cutting_stock(demand):
        assert sum(c * k for c, k in pattern.items()) <= 256
        total += times
        for c, k in pattern.items():
            used[c] += k * times
    assert all(abs(used[c] - n) < 1e-6 * n + 1e-6 for c, n in demand.items())
    assert total < 1.03 * sum(c * n for c, n in demand.items()) / 256 + 1
    assert cutting_stock({}) == []


def test_best_fit_places_all():
    pieces = [(1, i, 1 + i * 7 % 60) for i in range(200)]
    out = best_fit(pieces, 64)
    load = Counter()
    for (c, r, s, _) in out:
        load[s] += dict(((a, b), n) for a, b, n in pieces)[c, r]
    assert len(out) == 200 and max(load.values()) <= 64
