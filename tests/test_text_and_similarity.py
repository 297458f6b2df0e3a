from __future__ import annotations

import random
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.functions import similarity as sim
from vigil.functions import text
from vigil.functions.clock import ANCHOR_EPOCH, step_to_datetime, step_to_time
from vigil.operators import matching
from vigil.plans.catalogue import QUERIES


@pytest.mark.parametrize(("raw", "want"), [("  John   Smith  ", "JOHN SMITH"), ("O'Brien, Patrick", "O BRIEN PATRICK"), ("José Núñez", "JOSE NUNEZ"), ("", ""), (None, ""), ("-0-", "0"), ("a_b", "A_B")])
def test_names(raw, want):
    assert text.normalize_name(raw) == want


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def plain_name(raw: str | None) -> str:
    out = []
    for c in unicodedata.normalize("NFKD", raw or ""):
        if not unicodedata.combining(c):
            out.append(c if c.isalnum() or c == "_" else " ")
    return " ".join("".join(out).split()).upper()


def test_whole_texts_of_all_rows(spark, tmp_path):
    texts = ["Straße ÆØ þórr \"No. 7\"", "José " * 30 + "€ 12-34", "日本 x²", "a_b 'c'", "x" * 100, "", None, "plain words only"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.name for r in QUERIES["text_normalize_name"](spark, str(tmp_path)).collect()}
    assert got == {i: plain_name(x) for i, x in enumerate(texts)}


def test_column_forms(spark):
    assert column(spark, text.normalized_name, ["José  Núñez", None, "-0-"]) == ["JOSE NUNEZ", "", "0"]
    assert column(spark, text.strip_legal_suffixes, ["ACME TRADING LLC", "GLOBEX CORP", "BANCO NACIONAL DE CUBA", "A CO. LTD"]) == ["ACME TRADING", "GLOBEX", "BANCO NACIONAL DE CUBA", "A"]
    assert column(spark, text.normalize_country, ["USA", "United States of America", "Russian  Federation", "uk", "Freedonia", None, ""]) == ["US", "US", "RU", "GB", "FREEDONIA", None, None]
    dobs = ["01 Jan 1970", "1970", "1970-01", "1970-1-5", "12/31/1999", "-0-", "", None, "circa 1970s", "31 Feb 1970", "1970-13", "13/01/1999"]
    assert column(spark, text.normalize_dob, dobs) == ["1970-01-01", "1970", "1970-01", "1970-01-05", "1999-12-31", None, None, None, None, None, None, None]
    assert column(spark, text.split_list, ["a; b;;", " ", None]) == [["a", "b"], None, None]
    assert column(spark, text.clean_sentinel, ["-0- ", "x "]) == [None, "x"]
    assert column(spark, text.ascii_name, ["Al-Qaida  (x)!"]) == ["AL QAIDA X"]


def test_clock(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1, 5, 24, 1000, 99999)], "s int")
    for r in df.select("s", F.unix_timestamp(step_to_time(F.col("s"))).alias("t")).collect():
        assert r.t == ANCHOR_EPOCH + 3600 * r.s == int(step_to_datetime(r.s).timestamp())


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("AEROCARIBBEAN SUPPORT SERVICES", "AERO CARIBBEAN", 86.67),
        ("AEROCARIBBEAN SUPPORT SERVICES", "AEROCARIBBEAN AIRLINES", 70.57),
        ("AEROCARRIBEAN AIRLINES", "AEROCARIBBEAN AIRLINES", 95.45),
        ("NATIONAL BANK OF CUBA", "BANCO NACIONAL DE CUBA", 70.70),
        ("SAME", "SAME", 100.0),
        ("", "X", 0.0),
    ],
)
def test_known_scores(a, b, want):
    assert sim.score(a, b) == pytest.approx(want, abs=0.006)


def plain_levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("n", [1, 5])
def test_top_matches_against_all_pairs(spark, n):
    rng = random.Random(n)
    left = ["".join(rng.choices("AB C", k=rng.randint(1, 9))).strip() for _ in range(60)] + ["CUSTOMER 000000%03d" % k for k in range(80)] + ["", "QQQQQQQQQQQQ"]
    right = left[20:110] + ["AXB", "CUSTOMER", "ABABABABABABAB"]
    want = []
    for a in {x for x in left if x}:
        scores = sorted((-round(100 - 100 * plain_levenshtein(a, b) / max(len(a), len(b)), 4), b) for b in {x for x in right if x})
        want += [(a, b, -s, k) for k, (s, b) in enumerate(scores[:n], 1) if -s >= 50]
    one, two = (spark.createDataFrame([(x,) for x in side] + [(None,)], "text string") for side in (left, right))
    got, compared = matching.top_similar(one, two, n, 50.0)
    assert sorted(tuple(r) for r in got.select("a", "b", "score", "match_rank").collect()) == sorted(want)
    assert 0 < compared
    assert matching.top_similar(one.limit(0), two)[0].count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_top_matches_with_and_without_the_index(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW", few)
    test_top_matches_against_all_pairs(spark, 5)


def test_comparisons_grow_as_the_list_does(spark):
    """Four times the names have some more neighbours each (one more digit counts), not four times as many."""
    compared = []
    for k in (2_000, 8_000):
        names = spark.range(k).select(F.concat(F.lit("CUSTOMER "), F.lpad(F.col("id").cast("string"), 9, "0")).alias("text"))
        best, n = matching.top_similar(names, names, 5, 50.0)
        assert best.count() == 5 * k
        compared.append(n)
    assert compared[1] < 6 * compared[0]


def test_the_index_compares_few_pairs(spark):
    row = QUERIES["match_top_n_cost"](spark, "/root/testdata/sf0.01").first()
    assert row.names == 1664 and row.pairs == row.names**2 and row.scored < 0.1 * row.pairs


def random_pairs(n: int):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("ABCDEFGHIJKLMNO", k=rng.randint(1, 9))) for _ in range(300)] + ["É日", "x" * 70]
    names = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 2, 3, 3, 4, 4, 5, 12, 25]))) for _ in range(600)] + ["", "X", "A A A", "A A"]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(n)]
    return [(a, b if k % 5 else a.replace("A", "Z", 1)) for k, (a, b) in enumerate(pairs)]


@pytest.mark.parametrize("floor", [0.0, 78.0])
def test_scores_of_many_pairs_at_once(floor):
    pairs = random_pairs(20_000)
    got = sim.scores([a for a, _ in pairs], [b for _, b in pairs], floor)
    assert got == pytest.approx([sim.score(a, b, floor) for a, b in pairs], abs=1e-9)
    assert len(sim.scores([], [], floor)) == 0


def test_cells_share_out_a_block_that_holds_half_of_all_names(spark):
    names = [f"A{k}" for k in range(3000)] + [f"{chr(66 + k % 20)}{k}" for k in range(3000)]
    table = spark.createDataFrame([(x,) for x in names], "text string")
    one, two = matching.dealt(table, table, pairs=1 << 14)
    a, b = (Counter(r.cell for r in x.collect()) for x in (one, two))
    tasks = Counter()
    for cell in a.keys() | b.keys():
        tasks[cell % 16] += a[cell] * b[cell]
    assert sum(tasks.values()) == 3000**2 + 20 * 150**2
    assert max(tasks.values()) <= 2 * sorted(tasks.values())[8]
    small = spark.createDataFrame([(x,) for x in ["ANNA LEE", "ANNA LEA", "ANNE LEE", "BOB", "ROBERT"]], "text string")
    for pairs in (1, 9, 1 << 18):
        got = {(r.a, r.b): round(r.score, 6) for r in matching.similar_names(small, small, 78.0, pairs).collect()}
        assert got == {(x.text, y.text): round(sim.score(x.text, y.text), 6) for x in small.collect() for y in small.collect() if x.text[0] == y.text[0] and sim.score(x.text, y.text) >= 78}


def plain_lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ABC ", max_size=14), st.text("ABC ", max_size=30))
def test_score_properties(a, b):
    assert sim.lcs(a, b) == plain_lcs(a, b)
    assert 0 <= sim.score(a, b) <= 100
    full = sim.score(a, b)
    assert sim.score(a, b, 78.0) == (full if full >= 78.0 else 0.0)
    if len(a) <= len(b) and a:
        assert sim.partial_ratio(a, b) >= max(sim.ratio(a, b[i : i + len(a)]) for i in range(max(1, len(b) - len(a) + 1))) - 1e-9


def test_floor_never_changes_what_passes():
    rng = random.Random(1)
    words = ["JOHN", "JON", "SMITH", "SMYTH", "BANK", "OF", "CUBA", "AL", "TRADING"]
    for _ in range(500):
        a, b = (" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(2))
        full = sim.score(a, b)
        assert sim.score(a, b, 78.0) == (full if full >= 78.0 else 0.0)
