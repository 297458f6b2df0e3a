from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.fixtures import awkward, empty, pairs, rows_of
from vigil.llm import fingerprint, prefix_trie, spelling

EDITED = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"]


def hashed(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]


@pytest.mark.parametrize("unique", [True, False])
def test_fingerprints_against_brute_force(spark, unique):
    docs = awkward(spark, unique).cache()
    got = fingerprint.fingerprint_documents(docs).cache()
    assert rows_of(got, *EDITED) == sorted(brute.fingerprints(hashed(docs)), key=repr)
    prints = {}
    for doc, text in pairs(docs):
        prints.setdefault(doc, set()).add(text or "")
    by_text = {}
    for r in got.collect():
        if len(prints[r.doc_id]) == 1:
            by_text.setdefault(min(prints[r.doc_id]), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len(by_text) > 30


def test_fingerprints_of_few_rows(spark):
    assert fingerprint.fingerprint_documents(empty(spark)).count() == 0
    one = spark.createDataFrame([(7, "é" * 5 + " b")], "doc_id long, text string")
    assert rows_of(fingerprint.fingerprint_documents(one), *EDITED) == brute.fingerprints(hashed(one))
    same = spark.createDataFrame([(7, "a b c")] * 40 + [(-(2**63), None), (2**63 - 1, "x")], "doc_id long, text string").repartition(3)
    assert rows_of(fingerprint.fingerprint_documents(same), *EDITED) == sorted(brute.fingerprints(hashed(same)), key=repr)


def test_differences_grow_until_they_fit(spark):
    rng = random.Random(3)
    sets = [([rng.getrandbits(60) for _ in range(n)], [rng.getrandbits(60) for _ in range(m)], [rng.getrandbits(60) for _ in range(k)]) for n, m, k in [(0, 3, 5), (1, 0, 0), (4, 4, 0), (2000, 1, 0), (10, 700, 900), (0, 30, 0)]]
    table = spark.createDataFrame([(i, "x", a + c, b + c) for i, (a, b, c) in enumerate(sets)], "row long, cmp string, old array<long>, new array<long>")
    got = {r.row: (r.n, r.gone, r.come) for r in fingerprint.differences(table, True).collect()}
    assert got == {i: (len(a) + len(b), sorted(a), sorted(b)) for i, (a, b, _) in enumerate(sets) if a or b}


def test_one_very_long_text(spark):
    long = "\n".join(f"line {i} of a text that is very long" for i in range(30_000))
    docs = spark.createDataFrame([(1, long), (2, long[: len(long) // 2] + "end")], "doc_id long, text string")
    assert rows_of(fingerprint.fingerprint_documents(docs), *EDITED) == sorted(brute.fingerprints(hashed(docs)), key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, id long, kind string, n int, key string"


def turns(seed: int, convs: int):
    rng, rows = random.Random(seed), []
    for c in [*range(-12, convs), None, 2**63 - 1, -(2**63)]:
        shared = rng.random() < 0.4
        for t in range(rng.choice([0, 1, 2, 3, 5, 12])):
            text = rng.choice(["a", "b", "é", "", None]) if not shared else "same"
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "user", None]) if not shared else "user", text, 1, "x", 2, None))
    return rows + rows[:5]


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_trie_against_brute_force(spark, partitions):
    rows = turns(partitions, 150)
    table = spark.createDataFrame(rows, TURNS).repartition(4)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = rows_of(prefix_trie.conversation_trie(table), *TRIE)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == sorted(brute.prefix_trie([r[:4] for r in rows]), key=repr)


def test_trie_of_nothing_and_of_copies(spark, monkeypatch):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "", 1, "")], TURNS)).count() == 0
    rows = [(c, t, "user", f"turn {t}", 1, "", 1, "") for c in range(4000) for t in range(2)]
    got = rows_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)), *TRIE)
    assert got == sorted(brute.prefix_trie([r[:4] for r in rows]), key=repr)


def test_sweep_over_any_cuts(monkeypatch):
    """Parts and corrections of however many partitions add up to the nodes of one."""
    monkeypatch.setattr(prefix_trie, "PIECE", 5)
    rng = random.Random(9)
    arrays = sorted((b"".join(bytes([rng.randrange(2)]) * prefix_trie.WIDE for _ in range(rng.randrange(5))), c) for c in range(300))

    def nodes(cuts):
        sums = {}
        edges = []
        for part, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            sweep = prefix_trie.Sweep(part)
            for key, conv in arrays[i:j]:
                sweep.take(key, conv, [k + 1 for k in range(len(key) // prefix_trie.WIDE)])
            sweep.end()
            for r in sweep.rows:
                if r[0] == prefix_trie.EDGE:
                    edges.append(r[14:17])
                elif r[0] in (prefix_trie.WHOLE, prefix_trie.PART):
                    sums.setdefault(r[1], []).append(r)
        for (_, _, before), (first, sizes, _) in zip(edges, edges[1:], strict=False):
            for r in prefix_trie.corrections(before, first, sizes):
                sums.setdefault(r[1], []).append(r)
        return {k: (v[0][4], min(r[5] for r in v if r[5] is not None), *[sum(r[i] for r in v) for i in range(6, 10)]) for k, v in sums.items()}

    whole = nodes([0, 300])
    assert len(whole) == 31
    for n in (2, 7, 60):
        assert nodes([0, *sorted(rng.sample(range(1, 300), n)), 300]) == whole


@pytest.mark.parametrize("unique", [True, False])
def test_spelling_against_brute_force(spark, unique):
    rng = random.Random(4)
    letters = "abéÿ×"
    words = ["".join(rng.choices(letters, k=rng.randint(4, 7))) for _ in range(150)] + ["x" * 3000, "x" * 2999, "y" + "x" * 2999]
    weights = [rng.random() ** 6 for _ in words]
    texts = [" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=120)) for _ in range(60)]
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)] + [(None, " ".join(words[-3:] * 3 + ["abcde"] * 3 + ["abcdef"] * 8 + ["abcdefg"] * 20))], "doc_id long, text string")
    docs = awkward(spark, unique).select("doc_id", "text", "k1", "k2", "score").unionByName(more, allowMissingColumns=True)
    got = spelling.spelling_groups(docs)
    want = brute.spelling(pairs(docs))
    assert rows_of(got, "word", "form", "root", "n", "n_near", "form_n") == sorted(want, key=repr)
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(empty(spark)).count() == 0
    assert spelling.spelling_groups(spark.createDataFrame([(1, None), (2, "1 2 ab")], "doc_id long, text string")).count() == 0
