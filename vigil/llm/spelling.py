"""Grouping spelling variants: words one edit apart, found by a rare-first prefix filter over positional bigrams.

All bigrams of the vocabulary are put in one order, the rarest first (ties by the bigram, within a word by position).
One edit destroys at most two bigrams of a word, so two words one edit apart share one of their three rarest, at the
same place or, where the longer word has its letter more before it, one further on. Only these three are joined. An edit
also leaves one half of the shorter word as it is, so the half is part of the join's key: no pair is lost by it, and a
common bigram doesn't bring all its words together. What meets is verified by the edit distance in code points.

Words are counted before they are compared, so a frequent word is one row. There are at most 90 code points, hence 8,100
bigrams: their frequencies are broadcast. A word's near words are bounded by its length, since one edit can only make so
many, so no group grows with the corpus.

Null text has no words; a null doc_id is the empty string in the hash that damages words. Repeated rows count each time.
Runs of any length are words; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from vigil.llm.common import discard, settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rarest bigrams to join by: one more than one edit can destroy.
PREFIX = 3


def runs_of(text: Column) -> Column:
    """Maximal runs of letters (A-Z in lower case, U+00C0 to U+00FF as they are)."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("([a-zÀ-ÿ]+)"), 1)


def damaged(doc_id: Column, run: Column, rate: int) -> Column:
    """The run, without one code point where rate divides the hash of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % rate == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, rate: int = 97) -> DataFrame:
    """word, n: the words of whole texts that are long and frequent enough."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(runs_of(F.col("text").cast("string"))).alias("run"))
    words = runs.where(F.length("run") >= shortest).select(damaged(F.col("doc_id"), F.col("run"), rate).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """word, n, gram, place for each word's three rarest bigrams; words need four code points or more."""
    letters = F.split("word", "")
    grams = F.transform(F.slice(letters, 1, F.size(letters) - 1), lambda c, i: F.concat(c, F.get(letters, i + 1)))
    placed = words.select("word", "n", F.posexplode(grams).alias("place", "gram"))
    known = placed.groupBy("gram").agg(F.count("*").alias("known"))  # 8,100 rows at most
    order = Window.partitionBy("word").orderBy("known", "gram", "place")
    ranked = placed.join(F.broadcast(known), "gram").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= PREFIX).select("word", "n", "gram", "place")


def _posted(rare: DataFrame, name: str, longer: int = 0, shifts: tuple[int, ...] = (0,)) -> DataFrame:
    """key, name, name_n: rare under the keys of words of its own length, or as the longer word (longer: 1) of words one shorter.

    key: the shorter word's length, a bigram, its place (and those beside it in shifts), and the first or the second half.
    """
    length = F.length("word") - longer
    half = F.floor(length / 2).cast("int")
    parts = (F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), half + 1 + longer, F.length("word")))
    keys = [F.xxhash64(length, F.col("gram"), F.col("place") + by, F.lit(side), part) for by in shifts for side, part in enumerate(parts)]
    return rare.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.explode(F.array(*keys)).alias("key"))


def near_words(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: each pair of words (word, n) that differ by one inserted, deleted or replaced code point, once."""
    rare = rarest_bigrams(words)
    alike = _posted(rare, "a").join(_posted(rare, "b"), "key").where(F.col("a") < F.col("b"))
    grown = _posted(rare, "a", shifts=(0, 1)).join(_posted(rare, "b", longer=1), "key")
    columns = ["a", "b", "a_n", "b_n"]
    met = alike.select(columns).union(grown.select(columns))
    return met.where(F.levenshtein("a", "b", 1) == 1).distinct()


def _roots(forms: DataFrame, most_rounds: int = 30) -> DataFrame:
    """word, root: forms (word, form) followed to the last. A form is at least twice as frequent, so there are no circles
    and few steps; each round doubles the steps taken."""
    roots = settle(forms.select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        seen, further = Observation(), roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = settle(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).observe(seen, F.count_if("moved").alias("moved")))
        discard(roots)
        if not seen.get["moved"]:
            return new.drop("moved")
        roots, folder = new.drop("moved"), new.__dict__.pop("_folder")
        roots.__dict__["_folder"] = folder
    raise RuntimeError(f"roots not found in {most_rounds} rounds")


def group_words(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of counted words (word, n).

    A word's form is its most frequent near word, the first in code-point order of several, if that is at least `times`
    as frequent (times: 2 or more).
    """
    words = settle(words)
    pairs = settle(near_words(words))
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("n"))).alias("form"))
    found = settle(found.select("word", "form.form", "n", "n_near", F.col("form.n").alias("form_n")))
    discard(words, pairs)
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """The groups of all words of the documents' whole texts."""
    return group_words(word_counts(docs))
