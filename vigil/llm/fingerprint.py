"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text is cut into paragraphs: lines, and these into runs of at most `RUN` words from the line's start, so that a text
of one line has several. The sketch of a text holds each distinct paragraph's digest (60 bits) in one cell of each of
three tables; a cell has a count, the xor of its digests and the xor of their checks. The fingerprint is the sketch of
three times `WIDTH` cells as text, its size before it: "paragraphs|cell.count.digests.checks;..." (empty cells left out).

Two versions are compared by subtracting cells and peeling: a cell that holds one digest (count 1 or -1, and the check
fits) gives it up, which is taken out of its other cells, until nothing is left. Tables take turns, so that no digest is
found twice in a turn. Where something is left, both versions are sketched anew in sixteen times the cells. The likeness of
two texts is the share of their distinct paragraphs that both have; two texts without any have likeness 1.

Cells are rows, dealt by text, so all turns of a comparison run in one stage without a further shuffle, and a very long
text is many rows but never an array of cells. A retry reads only what failed, from a written table.

The next document is that of the next lower doc_id (null last; of one doc_id, the next higher hash of its text), the
first one after the last. Documents are put in order by range, without their texts; only the part of a text that its
neighbour takes over is moved for it. Rows alike in doc_id and text are moved once: they are next to each other, so all
but one have themselves as the next. Null text is empty; a null doc_id is like others. An empty table gives no rows.
Other columns are ignored. Texts that differ in more than two million paragraphs raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import settle

RUN, WIDTH, LARGER, TURNS = 12, 12, 16, 9
#: Bits of a digest that place it within each table.
_PLACE_BITS = 20
_KEY = ["o1", "o2", "o3"]


def paragraphs(text: Column) -> Column:
    """Digests of the distinct paragraphs: the first 60 bits of their MD5."""
    pieces = F.regexp_extract_all(text, F.lit(rf"((?:[^\n ]+ *){{1,{RUN}}})"), 1)
    return F.transform(F.array_distinct(F.transform(pieces, lambda p: F.rtrim(p))), lambda p: _bits(F.md5(p), 15))


def _bits(hexadecimal: Column, digits: int) -> Column:
    return F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("long")


def check_of(digest: Column) -> Column:
    return _bits(F.md5(digest.cast("string")), 8)


def _cell(digest: Column, table: int, width: int) -> Column:
    return (F.shiftright(digest, _PLACE_BITS * table).bitwiseAND((1 << _PLACE_BITS) - 1) % width + table * width).cast("int")


def _cells(digest: Column, width: int) -> Column:
    return F.array(*[_cell(digest, t, width) for t in range(3)])


def sketches(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, side, cell, n, x, c: the cells in use of each array of digests (row, side, digests); dealt by row."""
    digests = texts.repartition("row").select("row", "side", F.explode("digests").alias("x")).withColumn("c", check_of(F.col("x")))
    placed = digests.select("row", "side", "x", "c", F.explode(_cells(F.col("x"), width)).alias("cell"))
    return placed.groupBy("row", "side", "cell").agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"))


def fingerprints(texts: DataFrame) -> DataFrame:
    """row, side, print of each array of digests (row, side, digests) that isn't empty."""
    cells = sketches(texts).groupBy("row", "side").agg(F.sort_array(F.collect_list(F.struct("cell", "n", "x", "c"))).alias("cells"))
    total = F.aggregate(F.filter("cells", lambda x: x["cell"] < WIDTH), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    text = F.array_join(F.transform("cells", lambda x: F.concat_ws(".", x["cell"], x["n"], F.lower(F.hex(x["x"])), F.lower(F.hex(x["c"])))), ";")
    return cells.select("row", "side", F.concat(total.cast("string"), F.lit("|"), text).alias("print"))


def _turn(cells: DataFrame, table: int, width: int, digests: bool) -> DataFrame:
    """Peel one table's pure cells. A digest that has been found is a row of cell -1, with the digest as its mark, or one more in the count of a single such row."""
    row = lambda cell, n, x, c, mark=None: F.struct(cell.cast("int").alias("cell"), n.alias("n"), x.alias("x"), c.alias("c"), (F.lit(0).cast("long") if mark is None else mark).alias("mark"))
    n, x, c, zero = F.col("n"), F.col("x"), F.col("c"), F.lit(0).cast("long")
    pure = F.col("cell").between(table * width, table * width + width - 1) & (F.abs("n") == 1) & (F.when(F.abs("n") == 1, check_of(x)) == c)
    out = F.when(pure, F.array(row(F.lit(-1), n, x, c, x) if digests else row(F.lit(-1), F.lit(1).cast("long"), zero, zero), *[row(_cell(x, t, width), -n, x, c) for t in range(3) if t != table]))
    dealt = cells.select("row", "cmp", F.inline(F.coalesce(out, F.array(row(F.col("cell"), n, x, c, F.col("mark"))))))
    left = dealt.groupBy("row", "cmp", "cell", "mark").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"))
    return left.where((F.col("n") != 0) | (F.col("x") != 0))


def subtract(pairs: DataFrame, width: int, digests: bool = False) -> DataFrame:
    """row, cmp, left, n (and gone, come) of pairs (row, cmp, old, new) of digest arrays that differ.

    left: cells that could not be peeled (0: all is found); n: digests found; gone, come: those of one version only.
    """
    one = lambda name, sign: F.transform(name, lambda x: F.struct(x.alias("x"), F.lit(sign).cast("long").alias("sign")))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a count of its own isn't coalesced: rows become many
    entries = pairs.repartition(tasks, "row").select("row", "cmp", F.inline(F.concat(one("old", 1), one("new", -1)))).withColumn("c", check_of(F.col("x")))
    placed = entries.select("row", "cmp", "x", "c", "sign", F.explode(_cells(F.col("x"), width)).alias("cell"))
    side = lambda sign, value: F.bit_xor(F.when(F.col("sign") == sign, F.col(value)).otherwise(0))
    both = placed.groupBy("row", "cmp", "cell").agg(*[f.alias(f"{k}{'_new' if s < 0 else ''}") for s in (1, -1) for k, f in (("n", F.count_if(F.col("sign") == s)), ("x", side(s, "x")), ("c", side(s, "c")))])
    cells = both.select("row", "cmp", "cell", (F.col("n") - F.col("n_new")).alias("n"), F.col("x").bitwiseXOR(F.col("x_new")).alias("x"), F.col("c").bitwiseXOR(F.col("c_new")).alias("c"), F.lit(0).cast("long").alias("mark"))
    cells = cells.where((F.col("n") != 0) | (F.col("x") != 0))
    for turn in range(TURNS):
        cells = _turn(cells, turn % 3, width, digests)
    found = lambda n: F.collect_list(F.when((F.col("cell") < 0) & (F.col("n") == n), F.col("x")))
    more = [F.sort_array(found(1)).alias("gone"), F.sort_array(found(-1)).alias("come")] if digests else []
    return cells.groupBy("row", "cmp").agg(F.count_if(F.col("cell") >= 0).alias("left"), F.coalesce(F.sum(F.when(F.col("cell") < 0, F.abs("n"))), F.lit(0)).alias("n"), *more)


def differences(pairs: DataFrame, digests: bool = False) -> DataFrame:
    """row, cmp, n (and gone, come) of all pairs (row, cmp, old, new) of digest arrays that differ, in sketches as large as it takes.

    pairs are read again for each retry, so they should be a table.
    """
    done, failed, width = [], None, WIDTH
    while True:
        todo = pairs if failed is None else pairs.join(failed, ["row", "cmp"], "left_semi")
        got = settle(subtract(todo, width, digests))
        done.append(got.where("left = 0").drop("left"))
        failed = got.where("left > 0").select("row", "cmp")
        if failed.isEmpty():
            break
        if width > 1 << _PLACE_BITS:
            raise RuntimeError("texts differ in too many paragraphs")
        width *= LARGER
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def _nexts(rows: DataFrame) -> DataFrame:
    """Key, n (code points), copies and the next one's key (next) of each distinct document."""
    order = rows.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.first("n").alias("n"))
    order = settle(order.repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id()))
    key = F.struct(*_KEY)
    heads = order.groupBy("part").agg(F.min(key).alias("head"))  # a row a partition
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.min("head").over(Window.partitionBy())).alias("after"))
    within = Window.partitionBy("part").orderBy(*_KEY)
    return order.withColumn("lead", F.lead(key).over(within)).join(heads, "part").select(*_KEY, "n", "copies", F.coalesce("lead", "after").alias("next"))


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_chars, edited_sha256, times, and the digests own, edited, next of each distinct document, written out.

    times: so many rows alike have this result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.isNull().alias("o1"), F.bitwise_not(F.coalesce(doc, F.lit(0))).alias("o2"), F.xxhash64(text).alias("o3"), text.alias("text"))
    nexts = _nexts(rows.select(*_KEY, F.length("text").alias("n")))
    whole = rows.groupBy(*_KEY).agg(F.first("text").alias("text"))
    lent = whole.join(nexts.select(*[F.col("next")[k].alias(k) for k in _KEY], F.struct(*_KEY).alias("of"), "n", "copies"), _KEY)
    lent = lent.select(*[F.col("of")[k].alias(k) for k in _KEY], "copies", F.substring(F.col("text"), F.lit(1), _half(F.col("n"))).alias("lent"), paragraphs(F.col("text")).alias("next"))
    both = whole.join(lent, _KEY).withColumns({"n": F.length("text"), "own": paragraphs(F.col("text"))})
    head, tail = F.substring(F.col("text"), F.lit(1), F.col("n") - _half(F.col("n"))), F.substring(F.col("text"), F.lit(1), _half(F.col("n")))
    case = lambda times, end, after: F.struct(times.cast("long").alias("times"), F.concat(head, end).alias("edited"), after.alias("next"))
    last, copy = case(F.lit(1), F.col("lent"), F.col("next")), case(F.col("copies") - 1, tail, F.col("own"))
    cases = both.select(*_KEY, "n", "own", F.inline(F.when(F.col("copies") > 1, F.array(last, copy)).otherwise(F.array(last))))
    out = cases.select(
        F.monotonically_increasing_id().alias("row"),
        F.when(~F.col("o1"), F.bitwise_not("o2")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "times", "own", paragraphs(F.col("edited")).alias("edited"), "next",
    )
    return settle(out)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    rows = with_neighbours(docs)
    pair = lambda cmp: F.struct(F.lit(cmp).alias("cmp"), F.col("own").alias("old"), F.col(cmp).alias("new"))
    found = differences(rows.select("row", F.inline(F.array(pair("edited"), pair("next")))))
    found = found.groupBy("row").agg(*[F.max(F.when(F.col("cmp") == c, F.col("n"))).alias(f"{c}_n") for c in ("edited", "next")])
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("digests"))
    prints = fingerprints(rows.select("row", F.inline(F.array(side("own"), side("edited")))))
    prints = prints.groupBy("row").agg(*[F.max(F.when(F.col("side") == s, F.col("print"))).alias(f"{s}_print") for s in ("own", "edited")])
    sizes = rows.select("row", "doc_id", "n_chars", "edited_sha256", "times", *[F.size(c).cast("long").alias(c) for c in ("own", "edited", "next")])
    joined = sizes.join(prints, "row", "left").join(found, "row", "left")

    def likeness(other: str) -> Column:
        both, differ = F.col("own") + F.col(other), F.coalesce(f"{other}_n", F.lit(0))
        return F.when(both == 0, 1.0).otherwise((both - differ) / (both + differ))

    printed = lambda s: F.coalesce(f"{s}_print", F.lit("0|"))
    out = joined.select("doc_id", "n_chars", "edited_sha256", printed("own").alias("fingerprint"), printed("edited").alias("edited_fingerprint"), likeness("edited").alias("near_edited"), likeness("next").alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.drop("col")
