"""A small table with the awkward cases: nulls, blanks, long words, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, k2 int, score int, words string, `a.b c` string"


def awkward_rows(ids_unique: bool = True) -> list[tuple]:
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "naïve,", "STRASSE", "日本", "x" * 200, "12", "a-b", "don't"]
    words = lambda n: " ".join(rng.choices(vocab, k=n))
    base, passage = words(120), words(60)
    near = base.split(" ")
    near[7] = "changed"
    texts = [None, "", " ", "\n\t ", "one", "two words", base, base, base.upper(), " ".join(near), " ".join(near[:-2]), passage, words(40) + " " + passage, passage + "\n" + words(50), "same " * 80, words(3000), "<|endoftext|> a  b", "x" * 5000, words(34), words(35), "a\x00b \x85c d　e", "line one\nline one\nline two here\n\n", "été " * 9]
    texts += [words(rng.randint(1, 90)) for _ in range(30)]
    rows = [(i * 3, t, None if i % 4 == 0 else "en", "src0" if i % 3 == 0 else None, len(t or ""), "k", i, None, "z", "q") for i, t in enumerate(texts)]
    rows.append((-(1 << 62), base, "en", None, 1, None, None, None, None, None))
    rng.shuffle(rows)
    if not ids_unique:
        rows += [rows[0], rows[3], (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


def awkward(spark, ids_unique: bool = True, parts: int = 5):
    return spark.createDataFrame(awkward_rows(ids_unique), SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df) -> list[tuple]:
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows_of(df, *cols) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
