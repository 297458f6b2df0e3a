"""Screening of names against a watchlist: blocked similarity join, best name per entity, bonuses and confidence bands.

Both sides are reduced to distinct normalized names first, so the costly comparison runs once for each pair of
spellings. Blocks (the first character by default) are few and uneven, so their sizes are counted first: a block is a
grid of cells of about `PAIRS` pairs, and a name goes to the cells of its row or column only, some root of what all
pairs would take. Cells are numbered in order and dealt to tasks in turn, so tasks get equal numbers of pairs although
one block may hold half of all names. A task prepares each name of a cell once and compares all its pairs in arrays.

The n best of a whole list (`top_similar`) are sought among names one edit away first, which become equal when either
loses a letter or none, so that the work follows the number of such pairs and not the square of the list. A name is done as soon
as its n-th best beats what any pair with more edits could reach. Of the others, if they are many, those of two, then
three edits come from an inverted index of positional bigrams: two names within k edits share one of their 2k + 1 rarest
bigrams, at most k places apart, and all but 2k in all. The few that are left are compared with the whole list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.similarity import Names
from vigil.functions.text import normalize_dob, normalized_name
from vigil.session import written

# The least similarity, the bonuses, and the band's edge.
FLOOR, COUNTRY_BONUS, DOB_BONUS, STRONG = 78.0, 3.0, 5.0, 90.0
#: Pairs in a cell, and edits up to which the index of bigrams is asked.
PAIRS, EDITS = 1 << 18, 3
#: Names that are compared with the whole list at once, which costs less than an index of it.
FEW = 1_000


def names_of(watchlist: DataFrame) -> DataFrame:
    """entity_id, field, ordinal, text (normalized, non-empty) for the primary name and all aliases."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    out = watchlist.select("entity_id", F.posexplode(names).alias("ordinal", "raw"))
    out = out.withColumns({"text": normalized_name(F.col("raw")), "field": F.when(F.col("ordinal") == 0, "primary_name").otherwise("alias")})
    return out.where("text <> ''")


def block_key(text: Column) -> Column:
    return F.substring(text, 1, 1)


def whole_list(text: Column) -> Column:
    """One block for all names: every name meets the entire list."""
    return F.lit("")


def may_reach(a: Column, b: Column, floor: float) -> Column:
    """Whether lengths alone allow a pair the floor (exact: only hopeless pairs fail)."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (long <= 8 * short) | (F.lit(60.0) >= floor) | (200 * short / (short + long) >= floor)


def dealt(left: DataFrame, right: DataFrame, key=block_key, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of either side (a, cell and b, cell) so that each pair of one block is in exactly one cell.

    Cells are numbered from 0, blocks one after the other; a block's cells have about equal numbers of pairs, at most
    about `pairs`. Blocks are as many as there are keys: for first characters a bounded number, so they are broadcast.
    """
    side = math.isqrt(pairs)
    one, two = (x.select(F.col("text").alias(c)).distinct().withColumn("block", key(F.col(c))) for x, c in ((left, "a"), (right, "b")))
    many = lambda x, name: x.groupBy("block").agg(F.ceil(F.count("*") / side).alias(name))
    blocks = many(one, "rows").join(many(two, "columns"), "block")
    cells = F.col("rows") * F.col("columns")
    blocks = F.broadcast(blocks.withColumn("first", F.sum(cells).over(Window.orderBy("block")) - cells))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    across = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = one.join(blocks, "block").select("a", "first", "columns", own("a", "rows").alias("i"), across("columns").alias("j"))
    columns = two.join(blocks, "block").select("b", "first", "columns", own("b", "columns").alias("j"), across("rows").alias("i"))
    cell = (F.col("first") + F.col("i") * F.col("columns") + F.col("j")).alias("cell")
    return rows.select("a", cell), columns.select("b", cell)


def _compared(a: list[str], b: list[str], floor: float, step: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """All pairs of two lists that reach floor, a bounded number at a time."""
    names = list(dict.fromkeys([*a, *b]))
    place, ready = {x: i for i, x in enumerate(names)}, Names(names)
    one, two = (np.fromiter((place[x] for x in side), np.int64, len(side)) for side in (a, b))
    rows = max(1, step // max(1, len(two)))
    for i in range(0, len(one), rows):
        p, q = np.repeat(one[i : i + rows], len(two)), np.tile(two, len(one[i : i + rows]))
        score = ready.scores(p, q, floor)
        hit = np.flatnonzero(score >= floor)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in p[hit]]), pa.array([names[k] for k in q[hit]]), pa.array(score[hit])], ["a", "b", "score"])


def _tasks(spark: SparkSession, cells: int) -> int:
    """At most a cell for each task, and at most some hundred cells."""
    return max(1, min(cells, max(int(spark.conf.get("spark.sql.shuffle.partitions")), cells // 128)))


def similar_names(left: DataFrame, right: DataFrame, floor: float = FLOOR, pairs: int = PAIRS, key=block_key, scorer=None) -> DataFrame:
    """a, b, score of all pairs of texts (columns text) in one block that score at least floor.

    scorer: a function of two columns in place of the weighted similarity.
    """
    one, two = dealt(left, right, key, pairs)
    if scorer:
        met = one.join(two, "cell").where(may_reach(F.col("a"), F.col("b"), floor))
        return met.withColumn("score", scorer(F.col("a"), F.col("b"))).where(F.col("score") >= floor).select("a", "b", "score")
    both = written(one.select("cell", F.lit(0).alias("side"), F.col("a").alias("text")).union(two.select("cell", F.lit(1), "b")))
    cells = both.agg(F.max("cell")).first()[0]
    tasks = _tasks(left.sparkSession, 0 if cells is None else cells + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        for batch in batches:
            for cell, side, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != now:
                    if sides[0] and sides[1]:
                        yield from _compared(*sides, floor)
                    now, sides = cell, ([], [])
                sides[side].append(text)
        if sides[0] and sides[1]:
            yield from _compared(*sides, floor)

    turn = both.repartitionById(tasks, F.pmod(F.col("cell"), F.lit(tasks)).cast("int"))
    return turn.sortWithinPartitions("cell", "side").mapInArrow(run, "a string, b string, score double")


def _edit_score(a: Column, b: Column, edits: Column) -> Column:
    return F.round(100 - 100 * edits / F.greatest(F.length(a), F.length(b)), 4)


def _bigrams(text: Column) -> Column:
    """The bigrams of a text with a mark before and after it."""
    letters = F.split(F.concat(F.lit("\x02"), text, F.lit("\x03")), "")
    return F.transform(F.slice(letters, 1, F.size(letters) - 1), lambda c, i: F.concat(c, F.get(letters, i + 1)))


def _ranked(texts: DataFrame) -> DataFrame:
    """texts (text, grams, ...) with size, gram, place, rank (the rarest bigram first), and grams numbered by occurrence."""
    placed = texts.select("text", F.posexplode("grams").alias("place", "gram"))
    known = placed.groupBy("gram").agg(F.count("*").alias("known"))
    order = Window.partitionBy("text").orderBy("known", "gram", "place")
    rare = placed.join(known, "gram").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * EDITS + 1)
    numbered = F.transform("grams", lambda g, i: F.concat(g, F.size(F.filter(F.slice("grams", F.lit(1), i), lambda x: x == g)).cast("string")))
    return rare.select("text", "gram", "place", "rank").join(texts.withColumns({"size": F.length("text"), "grams": numbered}), "text")


def _within(ranked: DataFrame, asking: DataFrame, edits: int) -> DataFrame:
    """a, b, edits of all pairs at most so many edits apart, a of asking (text) and at least three letters long for each edit."""
    rare = ranked.where(F.col("rank") <= 2 * edits + 1)
    near = F.explode(F.sequence(F.col("place") - edits, F.col("place") + edits)).alias("place")
    one = rare.where("is_a").join(asking, "text", "left_semi").select(F.col("text").alias("a"), F.col("size").alias("a_size"), F.col("grams").alias("a_grams"), "gram", near)
    two = rare.where("is_b").select(F.col("text").alias("b"), F.col("size").alias("b_size"), F.col("grams").alias("b_grams"), "gram", "place")
    shared = F.size(F.array_intersect("a_grams", "b_grams"))  # an edit destroys two at most
    met = one.join(two, ["gram", "place"]).where((F.abs(F.col("a_size") - F.col("b_size")) <= edits) & (shared >= F.greatest("a_size", "b_size") + 1 - 2 * edits)).select("a", "b").distinct()
    return met.withColumn("edits", F.levenshtein("a", "b", edits))


def _shortened(text: Column) -> Column:
    """Hashes of the text and of all that are left when it loses one letter."""
    n = F.length(text)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(text)), less))


def _one_edit(texts: DataFrame, n: int, floor: float) -> tuple[DataFrame, int]:
    """(a, b, score, match_rank of the n best at most one edit apart, how many comparisons that took).

    Two texts one edit apart are equal once either has lost one letter at most; a text that meets many is one of those
    with many neighbours, so its candidates are as many as its letters and the alphabet allow.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the texts are few bytes for the work they make
    short = texts.repartition(parts, "text").select("text", "is_a", "is_b", F.explode(_shortened(F.col("text"))).alias("short"))
    one, two = short.where("is_a").select("short", F.col("text").alias("a")), short.where("is_b").select("short", F.col("text").alias("b"))
    seen = Observation()
    met = one.join(two.hint("merge"), "short").where("a <> b").observe(seen, F.count("*").alias("compared"))
    apart = met.select("a", "b", F.levenshtein("a", "b", 1).alias("edits")).where("edits >= 0")
    same = texts.where("is_a AND is_b").select(F.col("text").alias("a"), F.col("text").alias("b"), F.lit(0).alias("edits"))
    found = apart.union(same).select("a", "b", _edit_score(F.col("a"), F.col("b"), F.col("edits")).alias("score")).where(F.col("score") >= floor)
    sets = found.groupBy("a").agg(F.collect_set(F.struct((-F.col("score")).alias("less"), "b")).alias("near"))  # a pair may have met twice
    best = sets.select("a", F.posexplode(F.slice(F.array_sort("near"), 1, n)).alias("at", "x"))
    out = written(best.select("a", "x.b", (-F.col("x.less")).alias("score"), (F.col("at") + 1).alias("match_rank")))
    return out, 0 if texts.where("is_a").isEmpty() or texts.where("is_b").isEmpty() else seen.get["compared"]  # Spark drops what it sees to be empty


def top_similar(left: DataFrame, right: DataFrame, n: int = 5, floor: float = 50.0) -> tuple[DataFrame, int]:
    """(a, b, score, match_rank of the n best texts of right for each of left, how many comparisons were made).

    The score is 100 - 100 * edits / the longer length, rounded to 4 digits; at least floor, which is above 0; ties by b.
    Null and empty texts match nothing.
    """
    marked = left.select("text", F.lit(True).alias("is_a"), F.lit(False).alias("is_b")).union(right.select("text", F.lit(False), F.lit(True)))
    texts = written(marked.where("text <> ''").groupBy("text").agg(F.bool_or("is_a").alias("is_a"), F.bool_or("is_b").alias("is_b")))
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")

    def settled(asking: DataFrame, best: DataFrame, edits: int) -> DataFrame:
        """The texts of asking whose n best can't be beaten by texts of more edits than so many."""
        length = F.length("text")
        reach = F.round(100 * length / (length + edits + 1), 4)  # of any text with more edits
        last = best.where(F.col("match_rank") == n).select(F.col("a").alias("text"), F.col("score").alias("last"))
        return asking.join(last, "text", "left").where((F.coalesce("last", F.lit(-1.0)) > reach) | (reach < floor)).select("text")

    asking = texts.where("is_a").select("text")
    best, compared = _one_edit(texts, n, floor)
    over = settled(asking, best, 1)
    done = [best.join(over.withColumnRenamed("text", "a"), "a", "left_semi")]
    open_ = written(asking.join(over, "text", "left_anti"))
    many = open_.count() > FEW
    ranked = written(_ranked(texts.withColumn("grams", _bigrams(F.col("text"))))) if many else None
    for edits in range(2, EDITS + 1) if many else ():
        asking = written(open_.where(F.length("text") >= 3 * edits))  # then texts within reach have 2 * edits + 1 bigrams at least
        met = written(_within(ranked, asking, edits))
        compared += met.count()
        found = met.where("edits >= 0").select("a", "b", _edit_score(F.col("a"), F.col("b"), F.col("edits")).alias("score")).where(F.col("score") >= floor)
        best = written(found.withColumn("match_rank", F.row_number().over(order)).where(F.col("match_rank") <= n))
        over = settled(asking, best, edits)
        done.append(best.join(over.withColumnRenamed("text", "a"), "a", "left_semi"))
        open_ = written(open_.join(over, "text", "left_anti"))
    one, two = dealt(open_, texts.where("is_b").select("text"), whole_list)
    long = F.greatest(F.length("a"), F.length("b"))
    met = one.join(two, "cell").where(100 * F.least(F.length("a"), F.length("b")) >= floor * long)
    seen = Observation()
    scored = met.select("a", "b", _edit_score(F.col("a"), F.col("b"), F.levenshtein("a", "b")).alias("score")).observe(seen, F.count("*").alias("compared"))
    out = written(scored.where(F.col("score") >= floor).withColumn("match_rank", F.row_number().over(order)).where(F.col("match_rank") <= n))
    compared += seen.get["compared"]
    for x in done:
        out = out.union(x)
    return out, compared


def screen(candidates: DataFrame, watchlist: DataFrame, floor: float = FLOOR, pairs: int = PAIRS, scorer=None, key=block_key) -> DataFrame:
    """All entities at or above the floor for each candidate (candidate_id, name, country, dob).

    watchlist: entity_id, name, aliases, country, dob. The best name of an entity counts; of equals, the earliest.
    """
    people = candidates.select("candidate_id", F.col("country").alias("c_country"), F.col("dob").alias("c_dob"), normalized_name(F.col("name")).alias("a"))
    people = written(people.where("a <> ''"))  # names are made and normalized once
    names = names_of(watchlist)
    scored = similar_names(people.withColumnRenamed("a", "text"), names, floor, pairs, key, scorer)
    hits = people.join(scored, "a").join(names.select("entity_id", "ordinal", "field", "raw", F.col("text").alias("b")), "b")
    best = hits.groupBy("candidate_id", "entity_id").agg(F.max_by(F.struct("a", "b", "raw", "field", "score", "c_country", "c_dob"), F.struct("score", -F.col("ordinal"))).alias("h")).select("candidate_id", "entity_id", "h.*")
    about = watchlist.select("entity_id", F.col("country").alias("e_country"), F.col("dob").alias("e_dob"))
    out = best.join(about, "entity_id")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    country = same(F.upper(F.trim("c_country")), F.upper(F.trim("e_country")))
    dob = same(normalize_dob(F.col("c_dob")), normalize_dob(F.col("e_dob")))
    bonus = F.when(country, COUNTRY_BONUS).otherwise(0.0) + F.when(dob, DOB_BONUS).otherwise(0.0)
    total = F.round(F.least(F.lit(100.0), F.col("score") + bonus), 2)
    out = out.withColumns({"country_match": country, "dob_match": dob, "bonus": bonus, "match_score": total})
    return out.select(
        "candidate_id", "entity_id", "match_score",
        F.when(F.col("a") == F.col("b"), "exact").when(F.col("match_score") >= STRONG, "strong").otherwise("weak").alias("match_confidence_band"),
        F.col("field").alias("matched_on_field"), F.col("b").alias("matched_on_text"), F.col("raw").alias("matched_on_spelling"), F.round("score", 2).alias("raw_score"), "bonus", "country_match", "dob_match",
    )


def explain(spark: SparkSession, candidate: tuple, entity: tuple, floor: float = FLOOR) -> Row | None:
    """The match of one candidate (name, country, dob) with one entity (entity_id, name, aliases, country, dob) and its reasons, or None."""
    one = spark.createDataFrame([("", *candidate)], "candidate_id string, name string, country string, dob string")
    two = spark.createDataFrame([entity], "entity_id string, name string, aliases array<string>, country string, dob string")
    return screen(one, two, floor, key=whole_list).first()


def top_matches(matches: DataFrame, n: int = 5) -> DataFrame:
    """The n best matches of each candidate, ties by entity."""
    order = Window.partitionBy("candidate_id").orderBy(F.desc("match_score"), "entity_id")
    return matches.withColumn("match_rank", F.row_number().over(order)).where(F.col("match_rank") <= n)


def recall(seeded: DataFrame, matches: DataFrame) -> DataFrame:
    """seeded (candidate_id, entity_id): how many are matched to the entity that they came from, and the share."""
    found = seeded.join(matches.select("candidate_id", "entity_id", F.lit(1).alias("hit")), ["candidate_id", "entity_id"], "left")
    return found.agg(F.count("*").alias("seeded"), F.count("hit").alias("recovered"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
