"""Near-duplicate groups by MinHash signatures whose coordinates are posted in an inverted index.

1. Each text becomes the set of its word shingles, hashed to 64 bits, and a signature of K minima. Texts with equal sets
   are one class (they are exact links); all further work is on class representatives.
2. A pair at or above the similarity agrees in at least T of the K coordinates, but for odds of 1e-6 (T is the binomial
   tail's point). So it agrees in one of the first K - T + 1 coordinates (the prefix), and only those are posted: a
   class under each of its prefix (coordinate, value) pairs. Lists of one member are skipped, and so are classes in
   fewer lists than a pair at the threshold would share but for the same odds.
3. Every class is paired with CENTRES centres, the members that lead most of its lists (each list has a leader in each of
   so many random orders). Pairs of T collisions or more are compared by exact similarity on the full sets, which
   makes links; components of links merge classes. This settles most members of big groups.
4. Only lists whose members are still of several components go on. Those of many loose members (outside the largest
   component) are replaced: their members are posted anew, under each of their rarest shingles, as many as two sets
   must have to share one if they are similar enough (prefix filtering, exact). That parts members that have just a
   common line. Loose members then meet all members of a list in tasks of bounded size: collisions of whole signatures
   are counted at once, pairs of one component or whose first common coordinate or shingle is another list's are
   skipped, and members that have a pair of at least T collisions left are kept. Those members' sets are fetched, every
   such pair is compared exactly, and a task returns only links that join components. No pairs are listed, and no link
   is lost.
5. Components of all links give each class, and so each document, the least doc_id that can be reached.

A text of fewer words than a shingle is one shingle; null and blank texts have an empty set and are linked with
nothing, not even each other. Rows that repeat an id or a text are members like others; null doc_id is a group's least
only if all are null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import KeyFilter, blocks, discard, mix, row_key, settle, signed, trim, without_id
from vigil.llm.graph import components

K = 32
#: Members of a block of a posting list.
BLOCK = 512
#: Centres that a class is compared with at first.
CENTRES = 2
#: Sets whose shingles are counted to tell common ones (about; any order of shingles gives the same links), and the most of these.
SAMPLE, COMMON = 4_000, 200_000
_ODDS = np.random.default_rng(77).integers(1, 1 << 62, (K, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SET_SEEDS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))
SIGNATURES = "k1 long, k2 long, n_shingles long, set_key binary, signature binary"


def collisions_needed(percent: int, of: int = K, odds: float = 1e-6) -> int:
    """The most T such that a pair of just that similarity agrees in fewer than T of so many coordinates with at most those odds."""
    p, tail = percent / 100, 0.0
    for t in range(of + 1):
        tail += comb(of, t) * p**t * (1 - p) ** (of - t)
        if tail > odds:
            return max(1, t)
    return of


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of rows: all rows' sorted distinct 64-bit shingle hashes, and where each row's begin (and the end)."""
    for _, _, w in blocks(column, "space", True):
        h, n = w.hashes(), w.counts
        with np.errstate(over="ignore"):
            x = np.zeros(len(h), np.uint64)
            for i in range(words):  # a hash for each run of words; those that cross documents are left out below
                part = mix(h + np.uint64(i + 1))
                x[: len(h) - i] += part[i:] * np.uint64(2 * i + 3)
        x = mix(x)
        doc = w.doc_of_word()
        inside = np.arange(len(h)) - w.docs[:-1][doc] if len(h) else np.zeros(0, np.int64)
        short = n < words
        for d in np.flatnonzero(short & (n > 0)):
            a, b = int(w.docs[d]), int(w.docs[d + 1])
            with np.errstate(over="ignore"):
                s = np.uint64(0x1234567 + b - a)
                for v in h[a:b]:
                    s = mix(np.array([s * np.uint64(31) + v]))[0]
            x[a] = s
        keep = np.where(short[doc], inside == 0, inside <= n[doc] - words) if len(h) else np.zeros(0, bool)
        x, doc = x[keep], doc[keep]
        order = np.lexsort((x, doc))
        x, doc = x[order], doc[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
        x, doc = x[new], doc[new]
        yield x, np.searchsorted(doc, np.arange(len(n) + 1))


def _sums(x: np.ndarray, at: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1, np.uint64)
    if len(x):
        out[full] = np.add.reduceat(x, at[:-1][full])
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """k1, k2 (row keys), n_shingles, set_key (128 bits that stand for the set), signature (K minima of 64 bits, each hashed to 32).

    Equal minima stay equal; others become so with odds of 2^-32, which at most has a pair compared in vain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = 0
            for x, at in shingle_sets(b.column(2), words):
                n = np.diff(at)
                full = np.flatnonzero(n)
                minima = np.zeros((len(n), K), np.uint32)
                with np.errstate(over="ignore"):
                    if len(full):
                        for i, (a, c) in enumerate(_ODDS):
                            v = x * a + c
                            v ^= v >> np.uint64(32)
                            minima[full, i] = mix(np.minimum.reduceat(v * c, at[:-1][full])).astype(np.uint32)
                    keys = np.column_stack([_sums(mix(x ^ s), at, full) + mix(n.astype(np.uint64) * s) for s in _SET_SEEDS])
                part = b.slice(row, len(n))
                row += len(n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), _binary(keys), _binary(minima)], ["k1", "k2", "n_shingles", "set_key", "signature"])
        trim()

    return docs.select(*row_key(), F.col("text").cast("string")).mapInArrow(run, SIGNATURES)


def _list_keys(coordinate: np.ndarray, values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(values.astype(np.uint64) + (coordinate + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _unpack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)


def _postings(classes: DataFrame, prefix: int) -> DataFrame:
    """set_key, list, coordinates (the bit of the list's) of the lists that a class is posted under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4000):
                part = b.slice(i, 4000)
                values = _unpack(part.column(1))[:, :prefix]
                row, c = np.divmod(np.arange(values.size), prefix)
                lists = _list_keys(c, values.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(signed(lists)), pa.array(np.int64(1) << c)], ["set_key", "list", "coordinates"])
        trim()

    return classes.select("set_key", "signature").mapInArrow(run, "set_key binary, list long, coordinates long")


def _collisions(a: str, b: str):
    """In how many coordinates two signatures agree."""
    at = lambda side, i: F.substring(side, 4 * i + 1, 4)
    return sum(((at(a, i) == at(b, i)).cast("int") for i in range(1, K)), (at(a, 0) == at(b, 0)).cast("int"))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """set_key, shingles (array of hashes) of the wanted classes; wanted has k1, k2, set_key of one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = 0
            for x, at in shingle_sets(b.column(1), words):
                part = b.slice(row, len(at) - 1)
                row += len(at) - 1
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(x)))], ["set_key", "shingles"])
        trim()

    texts = KeyFilter(wanted).apply(docs.select(*row_key(), F.col("text").cast("string"))).join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return settle(texts.select("set_key", "text").mapInArrow(run, "set_key binary, shingles array<long>"))


def _needed(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """sets of the keys in wanted (set_key), and few others, so that a join doesn't shuffle all sets for the sake of some.

    A bitmap of hashed keys, of 2^26 bits at most, goes to all tasks: a row for each word of it that isn't empty.
    """
    h = F.xxhash64("set_key")
    word, bit = F.shiftrightunsigned(h, 44), h.bitwiseAND(63).cast("int")
    bitmap = wanted.select(word.alias("_word"), F.expr("shiftleft(1L, cast(xxhash64(set_key) & 63 as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = sets.join(F.broadcast(bitmap), word == F.col("_word"))
    return marked.where(F.getbit("_bits", bit) == 1).select(*sets.columns)


def _similar(a: str, b: str, percent: int):
    inter, union = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return (100 + percent) * inter >= percent * union


def _blocks(members: DataFrame) -> DataFrame:
    """members of lists (with n, loose of the list, and whether they are loose) as rows of tasks of bounded size.

    A list of at most BLOCK members is one task. Of a longer one, every block of loose members meets every block of
    members; as few are loose, or the list is a rare shingle's, that is about as many rows as the list has members.
    """
    own = lambda n: F.pmod(F.xxhash64("set_key"), n).cast("int")
    rows = members.withColumns({"by": F.ceil(F.col("loose") / BLOCK).cast("int"), "of": F.ceil(F.col("n") / BLOCK).cast("int"), "small": F.col("n") <= BLOCK})
    task = lambda by, of: F.concat_ws(":", "list", by, of).alias("task")
    cols = ["list", "coordinates", "earlier", "set_key", "root", "is_loose", "small"]
    small = rows.where("small").select(task(F.lit(0), F.lit(0)), *cols, F.col("is_loose").alias("asks"))
    others = rows.where("NOT small").select("*", F.explode(F.sequence(F.lit(0), F.col("by") - 1)).alias("k")).select(task(F.col("k"), own(F.col("of"))), *cols, F.lit(False).alias("asks"))
    asking = rows.where("NOT small AND is_loose").select("*", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("k")).select(task(own(F.col("by")), F.col("k")), *cols, F.lit(True).alias("asks"))
    return small.union(others).union(asking)


def _candidates(sig: np.ndarray, part: np.ndarray, loose: np.ndarray, asks: np.ndarray, small: bool, coordinates: int, need: int, order: np.ndarray) -> np.ndarray:
    """Which pairs (an asking member, another) of a task are compared: a boolean matrix of asking by all members.

    Left out are pairs of one component, of too few collisions, whose first common coordinate is another list's, and
    one of the two ways to look at a pair of loose members.
    """
    a = np.flatnonzero(asks)
    hits, same = np.zeros((len(a), len(sig)), np.uint8), np.zeros((len(a), len(sig)), np.uint64)
    last = int(coordinates).bit_length()
    for c in range(K):  # coordinates is 0 for a shingle's list
        eq = sig[a, c][:, None] == sig[:, c][None, :]
        hits += eq
        if c < last:
            same |= eq.astype(np.uint64) << np.uint64(c)
    once = ~loose[None, :] | (order[a][:, None] < order[None, :])
    other = np.ones(len(sig), bool) if small else ~asks
    return (hits >= need) & (same == np.uint64(coordinates)) & (part[a][:, None] != part[None, :]) & once & other[None, :]


def _met(earlier: list[bytes], asks: np.ndarray) -> np.ndarray:
    """Which pairs (an asking member, another) share an earlier list, where they are compared."""
    n = np.array([len(e) // 8 for e in earlier])
    value, times = np.unique(np.frombuffer(b"".join(earlier), np.int64), return_inverse=True, return_counts=True)[1:]
    row, often = np.repeat(np.arange(len(n)), n), times[value] > 1
    value = np.unique(value[often], return_inverse=True)[1]
    row, met = row[often], np.zeros((int(asks.sum()), len(n)), bool)
    for v in range(0, int(value.max(initial=-1)) + 1, 2_000):
        some = (value >= v) & (value < v + 2_000)
        has = np.zeros((len(n), 2_000), np.float32)
        has[row[some], value[some] - v] = 1
        met |= has[asks] @ has.T > 0
    return met


def _matrix(table: pa.Table, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs to be compared, the indices of the asking members, and numbers of all members' components."""
    roots = {r: i for i, r in enumerate(dict.fromkeys(table.column("root").to_pylist()))}
    part = np.array([roots[r] for r in table.column("root").to_pylist()])
    keys = table.column("set_key").to_pylist()
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    order = np.array([place[k] for k in keys])
    asks = np.asarray(table.column("asks"))
    pairs = _candidates(_unpack(table.column("signature")), part, np.asarray(table.column("is_loose")), asks, table.column("small")[0].as_py(), table.column("coordinates")[0].as_py(), need, order)
    if pairs.any() and table.column("earlier").null_count < len(keys):
        pairs &= ~_met(table.column("earlier").to_pylist(), asks)
    return pairs, np.flatnonzero(asks), part


def _links(pairs: np.ndarray, asking: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the pairs that join components, compared exactly; one of a component pair is enough."""
    parent = list(range(int(part.max()) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    sizes = np.array([len(s) for s in sets])
    for row in np.flatnonzero(pairs.any(axis=1)):
        i = int(asking[row])
        others = np.array([j for j in np.flatnonzero(pairs[row]) if find(int(part[j])) != find(int(part[i]))], dtype=np.int64)
        if not len(others):
            continue
        small, big = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[100 * small >= percent * big]
        if not len(others):
            continue
        joined = np.concatenate([sets[j] for j in others])
        at = np.searchsorted(sets[i], joined)
        found = sets[i][np.minimum(at, sizes[i] - 1)] == joined
        ends = np.cumsum(sizes[others])
        total = np.concatenate([[0], np.cumsum(found)])
        inter = total[ends] - total[ends - sizes[others]]
        for j, x in zip(others, inter, strict=True):
            if (100 + percent) * x >= percent * (sizes[i] + sizes[j]) and find(int(part[i])) != find(int(part[j])):
                parent[find(int(part[i]))] = find(int(part[j]))
                out.append((int(i), int(j)))
    return out


def _placed(posted: DataFrame) -> DataFrame:
    """posted (with root) of the lists that hold several components: with n, loose (all but the largest component's), is_loose."""
    sizes = posted.groupBy("list", "root").agg(F.count("*").alias("k"))
    lists = sizes.groupBy("list").agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("most")).where("n > most.k")
    lists = lists.select("list", "n", F.col("most.root").alias("bulk"), (F.col("n") - F.col("most.k")).alias("loose"))
    return settle(posted.join(lists, "list").withColumn("is_loose", F.col("root") != F.col("bulk")).drop("bulk"))


def _centred(members: DataFrame, signed_classes: DataFrame, sets: DataFrame, need: int, percent: int) -> DataFrame:
    """Links between members and, CENTRES times, the centre that leads most of their lists in an order of its own."""
    lead = lambda k: F.min(F.struct(F.xxhash64(F.lit(k), "set_key").alias("h"), "set_key"))["set_key"].alias(f"c{k}")
    leads = members.groupBy("list").agg(*[lead(k) for k in range(CENTRES)])
    star = members.select("set_key", "list").join(leads, "list")
    best = star.groupBy("set_key").agg(*[F.mode(F.when(F.col("set_key") != F.col(f"c{k}"), F.col(f"c{k}")), True).alias(f"c{k}") for k in range(CENTRES)])
    pairs = best.select(F.col("set_key").alias("a"), F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(CENTRES)]))).alias("b")).where("b IS NOT NULL")
    signed_as = lambda side: signed_classes.select(F.col("set_key").alias(side), F.col("signature").alias(f"sig_{side}"))
    near = settle(pairs.join(signed_as("a"), "a").join(signed_as("b"), "b").where(_collisions("sig_a", "sig_b") >= need).select("a", "b"))
    of = lambda side: _needed(sets, near.select(F.col(side).alias("set_key"))).select(F.col("set_key").alias(side), F.col("shingles").alias(f"of_{side}"))
    out = settle(near.join(of("b"), "b").join(of("a"), "a").where(_similar("of_a", "of_b", percent)).select("a", "b"))
    discard(near)
    return out


def _common(sets: DataFrame) -> np.ndarray:
    """Shingles that several sets of a sample have, rarer ones first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.asarray(b.column(0).flatten()) for b in batches)]), return_counts=True)
        x, n = x[n > 1], n[n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([x[np.argsort(n, kind="stable")][-COMMON:].tobytes()], pa.binary())], ["common"])
        trim()

    some = sets.where(F.pmod(F.xxhash64("set_key"), F.lit(1 + sets.count() // SAMPLE)) == 0)
    return np.frombuffer(some.select("shingles").repartition(1).mapInArrow(count, "common binary").first()[0], np.int64)


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """set_key, root, and a list for each of the set's rarest shingles, so many that sets to be linked have one in common.

    earlier has the lists of its shingles that come before in the order.

    Linked sets share at least percent of either, so among the others and one more of each, in any order that is the
    same for all sets, there is a common one. The order is by how common a shingle is in a sample, then by hash.
    """
    common = _common(sets)
    by = np.argsort(common)
    shared = sets.sparkSession.sparkContext.broadcast((common[by], by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                x, n = np.asarray(part.column(2).flatten()), np.asarray(pc.list_value_length(part.column(2))).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
                place = np.where(known[at] == x, rank[at], -1) if len(known) else np.full(len(x), -1)
                order = np.lexsort((x, place, row))
                behind = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                first = behind < (n + percent * n // -100 + 1)[row]
                keep, behind = order[first], behind[first]
                lists, of = signed(mix(x[keep].view(np.uint64))), pa.array(row[keep])
                earlier = [lists[j - k : j].tobytes() for j, k in enumerate(behind.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(lists), pa.array(earlier, pa.binary())], ["set_key", "root", "list", "earlier"])
        trim()

    return sets.select("set_key", "root", "shingles").mapInArrow(run, "set_key binary, root binary, list long, earlier binary")


def _refined(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members of the lists to be compared: for long lists of many loose members stand lists of their rarest shingles.

    These part members that have just a common line, or parts of one text, from those that may be linked. Members that
    are still together, and still of several components, may be; such lists are compared however long.
    """
    fine, long = members.where(F.col("loose") <= BLOCK), members.where(F.col("loose") > BLOCK)
    if long.isEmpty():
        return fine.withColumn("earlier", F.lit(None).cast("binary"))
    wanted = long.groupBy("set_key").agg(F.first("root").alias("root"))
    own = settle(_needed(sets, long.select("set_key")).join(wanted, "set_key"))
    posted = settle(_rarest(own, percent).withColumn("coordinates", F.lit(0).cast("long")))
    discard(own)
    parts = _placed(posted)
    discard(posted)
    return fine.withColumn("earlier", F.lit(None).cast("binary")).unionByName(parts)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """k1, k2, root (null without shingles), doc_id, n_shingles, component_id of each row; percent: the least similarity of linked sets."""
    need = collisions_needed(percent)
    prefix = K - need + 1
    rows = settle(signatures(docs, words))
    doc_id = F.when(~without_id(F.col("k2")), F.col("k1"))
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("k1", "k2")).alias("of"), F.first("signature").alias("signature"), F.min(doc_id).alias("least"))
    classes = settle(classes.select("set_key", "of.k1", "of.k2", "signature", "least"))
    slim = settle(rows.drop("signature"))
    discard(rows)
    all_posted = _postings(classes, prefix)
    lists = all_posted.groupBy("list").agg(F.count("*").alias("k")).where("k > 1").select("list")
    own_lists = all_posted.join(lists, "list").groupBy("set_key").agg(F.collect_list(F.struct("list", "coordinates")).alias("own")).where(F.size("own") >= collisions_needed(percent, prefix))
    signed_classes = settle(classes.join(own_lists, "set_key").select("set_key", "k1", "k2", "signature", "own"))

    sets = _sets(docs, signed_classes.select("k1", "k2", "set_key"), words)
    candidates = signed_classes.select("set_key", F.explode("own").alias("p")).select("set_key", "p.*")
    linked = _centred(candidates, signed_classes, sets, need, percent)
    roots = components(linked)
    placed = signed_classes.select("set_key", "own").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
    placed = settle(placed.select("set_key", F.coalesce("root", "set_key").alias("root"), F.explode("own").alias("p")).select("set_key", "root", "p.*"))
    members = _placed(placed)
    discard(placed)

    tasks = settle(_blocks(_refined(members, sets, percent)))
    schema = "task string, list long, coordinates long, earlier binary, set_key binary, root binary, is_loose boolean, small boolean, asks boolean, signature binary"

    def flag(table: pa.Table) -> pa.Table:
        pairs, asking, _ = _matrix(table, need)
        wanted = pairs.any(axis=0)
        wanted[asking[pairs.any(axis=1)]] = True
        return table.filter(pa.array(wanted))

    with_signature = tasks.join(signed_classes.select("set_key", "signature"), "set_key").select(*[f.split()[0] for f in schema.split(", ")])
    flagged = settle(with_signature.groupBy("task").applyInArrow(flag, schema))
    discard(tasks, members, signed_classes)

    def link(table: pa.Table) -> pa.Table:
        pairs, asking, part = _matrix(table, need)
        sets = [np.sort(np.asarray(s.values).view(np.uint64)) for s in table.column("shingles")]
        keys = table.column("set_key").to_pylist()
        got = _links(pairs, asking, part, sets, percent)
        return pa.table({"a": pa.array([keys[i] for i, _ in got], pa.binary()), "b": pa.array([keys[j] for _, j in got], pa.binary())})

    more = settle(flagged.join(_needed(sets, flagged.select("set_key")), "set_key").groupBy("task").applyInArrow(link, "a binary, b binary"))
    discard(flagged, sets)
    if not more.isEmpty():
        discard(roots)
        roots = components(linked.unionByName(more))

    of_class = settle(classes.select("set_key", "least").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "least", F.coalesce("root", "set_key").alias("root")))
    discard(classes, roots, linked, more)
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = settle(of_class.join(least, "root").select("set_key", "root", "component_id"))
    out = slim.where("n_shingles > 0").join(of_class, "set_key").select("k1", "k2", "root", doc_id.alias("doc_id"), "n_shingles", "component_id")
    alone = slim.where("n_shingles = 0").select("k1", "k2", F.lit(None).cast("binary").alias("root"), doc_id.alias("doc_id"), "n_shingles", doc_id.alias("component_id"))
    return out.unionByName(alone)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: that of the least doc_id (of rows that share it, the one of the least key, and of rows
    alike in doc_id and text, the one of the least hash of all columns).

    Rows without a word all stay.
    """
    found = near_duplicates(docs, words, percent)
    group = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(without_id(F.col("k2")).alias("no_id"), "k1", "k2")).alias("of"))
    k1, k2 = row_key()
    rows = docs.select(k1, k2, F.rlike(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]")).alias("full"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    full = rows.where("full").join(settle(group.select("of.k1", "of.k2")), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    kept = full.select("row").unionByName(rows.where("NOT full").select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
