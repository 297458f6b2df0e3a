"""Line-first quality rules in DataFrame functions only.

A line fails if it looks like navigation (separators between short entries), like boilerplate (a phrase of the list
below), or by its punctuation (none at its end and hardly a word, shouting in capitals, or many of the symbols
# * $ % & | < >), or if it repeats an earlier line. Failing lines are taken out; a document that loses more than
`most_lost` of its characters that way is rejected. Before that, the base rules reject documents of fewer than ten
words and those where more than a fifth of the words lie in a five-word window that occurs twice.

Repeated windows are found within the row: five-word windows are hashed to 64 bits and, only if some hash repeats,
sorted with their positions, so a text of n words takes n log n steps and never leaves its task.

Null text has no words and fails. A blank text likewise. Rows are independent, so repeated rows repeat their result;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import let

#: Phrases of page furniture in English, German, French and Spanish, looked for in the lower-cased line.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "copyright", "enable javascript", "follow us", "log in", "lorem ipsum",
    "newsletter", "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe", "terms of service", "terms of use",
    "alle rechte vorbehalten", "datenschutz", "hier klicken", "impressum", "nutzungsbedingungen",
    "tous droits réservés", "mentions légales", "cliquez ici", "politique de confidentialité", "conditions d'utilisation",
    "todos los derechos reservados", "aviso legal", "haga clic", "política de privacidad", "condiciones de uso",
)
SPACE = "\\x20\\x09-\\x0D"
_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many words lie in a window (of so many words) that occurs at least twice, its first occurrence included."""

    def covered(places: Column) -> Column:
        gaps = F.transform(F.slice(places, 2, F.size(places)), lambda p, i: F.least(F.lit(window), p - F.get(places, i)))
        return F.when(F.size(places) == 0, 0).otherwise(F.aggregate(gaps, F.lit(window), lambda a, x: a + x))

    def repeated(ordered: Column) -> Column:
        same = lambda a, i: F.coalesce(a["h"] == F.get(ordered, i)["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(ordered, repeated))

    def grams(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - window)
        return let(F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)])), count)

    return F.when(F.size(words) < window, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), grams))


def line_fails(line: Column) -> Column:
    """Whether a line with a word is page furniture or noise by itself; the cheaper rules come first."""

    def rules(of: Column) -> Column:
        line, low, n, words = of["line"], of["low"], of["n"], of["words"]
        symbols = (n - _without(line, SYMBOLS)) * 12 > n
        navigation = (n - _without(line, "|»•·›") >= 2) | (F.contains(line, F.lit(" > ")) | F.contains(line, F.lit(" / "))) & (F.regexp_count(line, F.lit(" [>/] ")) >= 2)
        unended = (words <= 3) & ~F.rlike(line, F.lit(f"[.!?…:;,。！？\"'”’»)\\]][{SPACE}]*$"))
        shouts = F.regexp_count(line, F.lit("!!"))
        shouted = F.contains(line, F.lit("!!")) & (shouts >= 2) & (shouts * 3 >= words)
        capitals = (words >= 5) & (low != line) & (F.upper(line) == line)
        phrase = F.lit(False)
        for p in BOILERPLATE:
            phrase = phrase | F.contains(low, F.lit(p))
        return symbols | navigation | unended | shouted | capitals | (words <= 30) & phrase

    words = F.size(F.split(F.trim(line), f"[{SPACE}]+"))
    return let(F.struct(line.alias("line"), F.lower(line).alias("low"), F.length(line).alias("n"), words.alias("words")), rules)


def _lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))


def _fine(distinct: Column) -> Column:
    return F.filter(distinct, lambda x: ~line_fails(x))


def _characters(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda a, x: a + _without(x, _SPACES))


def _base_failed(n: Column, repeated: Column) -> Column:
    return (n < 10) | (100 * repeated > 20 * n)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def quality_rules(docs: DataFrame, most_lost: float = 0.5) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept."""
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def of_lines(lines: Column) -> Column:
        return let(F.array_distinct(lines), lambda distinct: F.struct((F.size(lines) - F.size(distinct)).alias("repeats"), _characters(_fine(distinct)).alias("fine")))

    out = text.select(
        "doc_id",
        let(_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated"))).alias("of_words"),
        _without(F.col("text"), _SPACES).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        let(_lines(F.col("text")), of_lines).alias("of_lines"),
    )
    n, repeated = F.col("of_words.n"), F.col("of_words.repeated")
    lost = F.col("word_chars") - F.col("of_lines.fine")
    return out.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("of_lines.repeats").cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        _base_failed(n, repeated).alias("base_failed"),
        lost.cast("long").alias("lost_chars"),
        (~_base_failed(n, repeated) & (lost <= most_lost * F.col("word_chars"))).alias("kept"),
    )


def clean_documents(docs: DataFrame, most_lost: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns; the text has only the lines that stand, in order, repeats left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def judged(cleaned: Column) -> Column:
        chars = _without(text, _SPACES)
        return F.when(chars - _characters(cleaned) <= most_lost * chars, F.array_join(cleaned, "\n"))

    base = let(_words(text), lambda w: _base_failed(F.size(w), repeated_words(w)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, F.when(~base, let(_fine(F.array_distinct(_lines(text))), judged)).alias("clean")).where("clean IS NOT NULL")
    return out.select(*[(F.col("clean") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
