from __future__ import annotations

import math
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.fixtures import awkward, empty, pairs, rows_of
from vigil.llm.bpe import Encoder
from vigil.llm.decontaminate import digest, find_leaks, remove_leaks
from vigil.llm.token_counts import MARK, PrefixTrie, load_ranks, token_counts
from vigil.llm.token_files import encode, read, shard_bounds, token_files, write

DIGEST2 = ["doc_id", "start", "n_tokens", "ids_crc32"]
DIGEST3 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("unique", [True, False])
def test_token_files_against_whole_encoding(spark, tmp_path, unique):
    docs, path = awkward(spark, unique), P.path("byte_bpe_50k.json")
    got = token_files(docs, path, 2, f"file://{tmp_path}/t")
    want = brute.token_files(pairs(docs), path)
    if unique:
        assert rows_of(got, *DIGEST2) == sorted(want, key=repr)
    else:
        assert rows_of(got, "doc_id", "n_tokens", "ids_crc32") == sorted([(a, c, d) for a, _, c, d in want], key=repr)
        spans = sorted((r.start, r.n_tokens) for r in got.collect())
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert got.drop("ids").count() == docs.count()
    assert sum(f.stat().st_size for f in (tmp_path / "t").glob("shard-*.ids")) == 2 * sum(x[2] for x in want)


def test_token_files_of_the_table(spark, sf):
    docs, path = spark.read.parquet(f"{sf}/documents.parquet"), P.path("byte_bpe_50k.json")
    assert rows_of(token_files(docs, path, 2), *DIGEST2) == sorted(brute.token_files(pairs(docs), path), key=repr)


def test_token_files_of_one_hot_id(spark, tmp_path):
    """An id with most of the rows, many of them equal, is parted; rows stay whole and in order."""
    rows = [(7, f"text {i % 3} " * (40 if i % 3 else 1)) for i in range(600)] + [(i, "x " * 30) for i in range(200)] + [(None, "n")] * 5 + [(9, "long " * 9000)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), P.path("byte_bpe_50k.json")
    upper, _ = shard_bounds(docs, 4000)
    assert upper.count(7) > 3 and upper == sorted(upper)
    bounds = shard_bounds(docs, 4000)
    manifest = write(encode(docs, path, 2, bounds), len(bounds[0]) + 1, 2, f"file://{tmp_path}/t")
    got = sorted(read(spark, f"file://{tmp_path}/t", 2, manifest).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in got if r.doc_id != 7] == [(d, n) for d, _, n, _ in brute.token_files(pairs(docs), path) if d != 7]
    assert sum(r.doc_id == 7 for r in got) == 601 and sum(s > 3 for s, _, _ in manifest) > 3
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


def test_shard_bounds_over_several_ranges(spark, monkeypatch):
    """Ranges end shards too; no shard has more than its worth and a row, whether ids are many or one has half of the rows."""
    from vigil.llm import token_files as module

    rows = [(i if i % 2 else 5, "word " * (i % 17)) for i in range(3000)] + [(-3, None), (5, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for most in (10**9, 400):
        monkeypatch.setattr(module, "_TASK_ROWS", most)
        upper, ties = shard_bounds(docs, 1500)
        place = module._shard_of(np.array([d for d, _ in rows]), np.zeros(len(rows), np.int64), np.array(upper), np.array(ties))
        assert list(zip(upper, ties, strict=True)) == sorted(set(zip(upper, ties, strict=True))) and upper.count(5) > 5
        sizes = np.bincount([p for p, (d, _) in zip(place, rows, strict=True) if d != 5], [len((t or "").encode()) + 1 for d, t in rows if d != 5], len(upper) + 1)
        worth = sum(len((t or "").encode()) + 1 for _, t in rows) / max(spark.sparkContext.defaultParallelism, -(-2 * sum(len((t or "").encode()) + 1 for _, t in rows) // 4500))
        assert sizes.max() <= 2 * worth


def test_encoder_on_awkward_texts():
    """Columns of texts against the library, text by text."""
    rng = random.Random(3)
    bits = ["a", "B", "é", "  ", " ", "\n", "\n\n", "\t", ".", ",", "'s", "1", "23", " ", "\u0301", "ß", "İ", "ς", "日", "\x01", "<|endoftext|>", "<|", "x\ty", "\r\n", "!!", "***", "ɐ", "\x85"]
    texts = [None, "", " ", "\n", *("".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(3000))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = Encoder(P.path(name))
        for i, _, ids, at in enc.blocks(pa.array(texts), 500):
            for k, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                assert ids[x:y].tolist() == enc.tok.encode(texts[i + k] or "", add_special_tokens=False).ids


def test_token_files_empty(spark):
    assert token_files(empty(spark), P.path("byte_bpe_50k.json"), 2).count() == 0


def plain_unigram(ranks, word):
    """Each prefix from all shorter ones, without a trie."""
    text, best = MARK + word, [(0.0, 0)]
    for end in range(1, len(text) + 1):
        c = len(text[end - 1].encode())
        ways = [(best[end - 1][0] - 25.0 * c, best[end - 1][1] + c)]
        ways += [(best[a][0] - math.log(ranks[text[a:end]] + 2), best[a][1] + 1) for a in range(end) if text[a:end] in ranks]
        best.append(max(ways, key=lambda w: (w[0], -w[1])))
    return best[-1][1], best[-1][0]


@pytest.mark.parametrize("limit", [600_000, 40])
def test_trie_against_plain_dynamic_programming(limit):
    ranks = load_ranks(P.path("piece_bpe_32k.model"))
    trie = PrefixTrie(ranks, limit)
    words = ["the", "then", "thence", "therefore", "there", "Été", "日本語", "x" * 60, "internationalisation" * 9, "internationalisation" * 9 + "s", "a\x85b", "😀", "international", "internally", "the"]
    for w in words * 2:
        n, s = trie.tokens(w)
        want = plain_unigram(ranks, w)
        assert n == want[0] and s == pytest.approx(want[1])


@pytest.mark.parametrize("unique", [True, False])
def test_token_counts(spark, unique):
    docs, ranks = awkward(spark, unique), load_ranks(P.path("piece_bpe_32k.model"))
    got = token_counts(docs, P.path("piece_bpe_32k.model"))
    want = []
    for doc, text in pairs(docs):
        words = brute.WORD.findall(text or "")
        want.append((doc, len(words), sum(plain_unigram(ranks, w)[0] for w in words if len(w) < 1000) if all(len(w) < 1000 for w in words) else None))
    assert [(a, b, c) for (a, b, c), (_, _, w) in zip(rows_of(got, "doc_id", "n_pretokens", "n_tokens"), sorted(want, key=repr), strict=True) if w is not None] == sorted([w for w in want if w[2] is not None], key=repr)
    assert token_counts(empty(spark), P.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("few", [1, 100, 10**9])
def test_many_pretokens_at_once(monkeypatch, few):
    """A block's trie, level by level, gives what single pre-tokens get, wherever its levels end."""
    from vigil.llm import token_counts as module

    monkeypatch.setattr(module, "FEW", few)
    rng, trie = random.Random(4), PrefixTrie(load_ranks(P.path("piece_bpe_32k.model")))
    pieces = sorted({p for p in trie.ends})
    words = ["", "the", "then", "the", "internationalisation" * 40, "internationalisation" * 40 + "s", "日本" * 70, "x" * 90, "😀", "a\x85b"]
    words += ["".join(rng.choices("abcdeéßñ日😀▁,.&#", k=rng.randrange(25))) for _ in range(800)] + ["".join(rng.choices(pieces, k=rng.randrange(1, 6))) for _ in range(800)]
    tokens, scores = trie.tokens_of(pa.array(words))
    assert list(zip(tokens.tolist(), scores.tolist(), strict=True)) == [trie.tokens(w) for w in words]
    assert [len(x) for x in trie.tokens_of(pa.array([], pa.string()))] == [0, 0]


def test_pretokens_are_segmented_once_a_block(monkeypatch):
    """Texts of a block share their pre-tokens; results don't depend on how texts fall into blocks."""
    from vigil.llm import token_counts as module

    texts = pa.array(["a b  a\n", "", " ", "b\x0bc\td", "x\x1cy \x85z\u2003w", "b a " * 50, "longer words here"] * 20)
    asked, trie = [], PrefixTrie(load_ranks(P.path("piece_bpe_32k.model")))
    many = trie.tokens_of
    trie.tokens_of = lambda words: (asked.append(len(words)), many(words))[1]
    out = {}
    for size in (1, 300, 1 << 20):
        monkeypatch.setattr(module, "BLOCK_BYTES", size)
        asked.clear()
        out[size] = [np.concatenate(c).tolist() for c in zip(*(module._count_block(trie, t) for t in module._blocks(texts)), strict=True)]
    assert len(asked) == 1 and asked[0] == 10
    assert out[1] == out[300] == out[1 << 20]
    assert out[1][0] == [len(t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("") for t in texts.to_pylist()]


@pytest.mark.parametrize("block_words", [4_000_000, 20])
def test_leaks_against_brute_force(spark, sf, block_words):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if block_words < 100:
        bench = bench.where("item_id < 6")
        items = [x for x in items if x[0] < 6]
    got = digest(find_leaks(docs, bench, block_words=block_words))
    assert rows_of(got, *DIGEST3) == sorted(brute.leaks(pairs(docs), items), key=repr)


def test_leaks_awkward(spark):
    docs = awkward(spark, False)
    texts = [t for _, t in pairs(docs) if t]
    items = [(1, texts[0]), (1, "two words"), (2, " ".join(texts[5].split()[:9])), (3, None), (4, "..."), (None, "line one"), (5, texts[7].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(digest(find_leaks(docs, bench)), *DIGEST3) == sorted(brute.leaks(pairs(docs), items), key=repr)
    assert rows_of(digest(find_leaks(docs, bench.limit(0))), *DIGEST3) == sorted(brute.leaks(pairs(docs), []), key=repr)
    assert find_leaks(empty(spark), bench).count() == 0


def test_remove_leaks(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    filler = " ".join(f"f{i}" for i in range(700))
    docs = spark.createDataFrame([(1, f"{filler}, {passage}. {filler}", 7), (2, f"a {passage} b", 3), (3, filler, 1), (4, None, 0)], "doc_id long, text string, n_chars int")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = remove_leaks(docs, bench)
    assert out.schema["n_chars"].dataType.simpleString() == "int" and out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: f"{filler}, {filler}", 3: filler, 4: None}


@pytest.mark.parametrize("block_words", [4_000_000, 5])
def test_remove_leaks_in_one_worker_a_task(spark, monkeypatch, block_words):
    """A task's last pass and its cut are one call of Python, a few rows at a time; blocks of items before it change nothing."""
    monkeypatch.setattr("vigil.llm.decontaminate.ROWS", 3)
    filler = [f"f{i}" for i in range(400)]
    items = [(k, " ".join(f"p{k}x{i}" for i in range(15))) for k in range(3)]
    rows = [(i, " ".join([*filler, *([items[i % 4][1]] if i % 4 < 3 else []), f"end{i}"]), f"s{i}") for i in range(20)] + [(20, items[0][1], "s20"), (21, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    out = remove_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = [(i, " ".join([*filler, f"end{i}"]), f"s{i}") for i in range(20)] + [(21, None, None)]
    assert sorted(map(tuple, out.collect())) == want
