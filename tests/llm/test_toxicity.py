from __future__ import annotations

import zlib

import pytest

from tests.llm.fixtures import SCHEMA, awkward, empty
from vigil.llm.toxicity import Lexicon, Matcher, choose_terms, fit


def edits(a: str, b: str) -> int:
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_edit_distance():
    terms = [("stupid", False, 2.0), ("idiot", False, 3.0), ("lowei", True, 4.0), ("scum", False, 1.0)]
    lexicon = Lexicon(terms)
    words = {"stupid", "stupd", "stuupid", "stupdi", "tsupid", "sutpid", "stup", "idoit", "idiots", "idi0t", "loweix", "lowex", "lowiechen", "lweichen", "scum", "scam", "plain", "st", ""}
    for w in words:
        best = [(min(edits(w[:k], t) for k in range(len(w) + 1)) if stem else edits(w, t), -weight, i) for i, (t, stem, weight) in enumerate(terms)]
        want = min(((d, x, i) for d, x, i in best if d <= lexicon.edits(terms[i][0])), default=None)
        got = lexicon.match(w)
        assert got == (want and (want[2], want[0])), w


def test_quotation_and_lookalikes():
    m = Matcher(Lexicon([("stupid", False, 2.0), ("idiot", False, 3.0)]))
    exact, misspelled, quoted, _, _ = m.features("you stupid man")
    assert exact > 0 and not misspelled and not quoted
    assert m.features("you st0pid and 1d1ot man")[1] > 0
    assert m.features('he said "stupid" once')[2] > 0 and not m.features('he said "stupid" once')[0]
    assert m.features(None) == m.features("") == m.features("all is well") == [0.0] * 5


def test_longest_beginnings():
    got = choose_terms([("vequist", 9, 3.0), ("trash", 9, 3.0)], [("vequ", 100, 4.0), ("vequi", 40, 4.0), ("lost", 50, 3.0), ("lostr", 50, 4.0)])
    assert got == [("lostr", True, 4.0), ("trash", False, 3.0), ("vequ", True, 4.0)]


@pytest.fixture(scope="module")
def model_and_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return fit(docs, labels), docs, labels


def test_accuracy_on_held_out_rows(model_and_tables):
    model, docs, labels = model_and_tables
    got = model.score(docs).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    toxic, fine = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    area = sum((a > b) + 0.5 * (a == b) for a in toxic for b in fine) / (len(toxic) * len(fine))
    assert area > 0.8 and sum(x >= 0.5 for x in fine) <= 0.06 * len(fine)


def test_awkward_rows(spark, model_and_tables):
    model = model_and_tables[0]
    docs = awkward(spark, False)
    got = model.score(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in got)
    assert model.score(empty(spark)).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, 3, None, 1, 1, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in fit(docs, none).score(docs).collect()] == [0]
