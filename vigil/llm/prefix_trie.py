"""The trie of conversations' prefixes, from a global sort: each node is a distinct sequence of first turns.

Turns become 128-bit digests of role and text, a conversation the array of its turns' digests. All arrays are sorted by
range, ties by conv_id. Within a partition, the longest common prefix (LCP) of an array with the one before it says
which open nodes end there; a stack of open nodes is swept along, and a node that closes has its counts and is written.
Nodes on the path of a partition's first or last array may go on in its neighbours, so they are written as parts. The
partitions' edges (their first and last arrays) are put in order, and the LCP across each boundary gives what its two
sides have counted twice; parts and corrections are then summed up by node. Only the paths at the boundaries are stitched.

All measures are sums (or least ids) over disjoint runs of the order, so a node that spans very many partitions, like a
first turn that a third of all conversations share, is a part in each and no group. The ids of conversations that end at
one node are hashed as they pass; where a run is long or may cross a boundary, it is written in pieces of bounded size,
which one task then streams through the hash in order. A conversation's array (24 bytes a turn) must fit in a task.

Turns are ordered by turn, null first, ties by digest; null role or text is empty. Rows without conv_id belong to no
conversation and are left out. Repeated rows are turns of their own. Without conversations there is no node, not even
the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import settle, trim

#: Bytes of a turn's digest and of a node's id; the root's id.
WIDE = 16
ROOT = bytes(WIDE)
#: Characters of a run of ids that are kept before they are written as a piece; rows that are written at once.
PIECE, ROWS = 1 << 16, 4096
WHOLE, PART, RUN, EDGE = range(4)
_NODE = "kind int, id binary, parent binary, parent_conv long, depth long, conv long, n long, children long, leaves long, saved long, ends string"
_SWEPT = f"{_NODE}, part int, seq long, piece string, first binary, sizes array<long>, last binary"
_SUMS = ("n", "children", "leaves", "saved")


def conversation_arrays(conversations: DataFrame, block: int = 1) -> DataFrame:
    """group, convs: arrays of (conv, turns (digest, bytes) in order), of the conversations that share conv_id - conv_id % block."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDE)
    rows = conversations.select(conv.alias("conv"), (conv - conv % block).alias("group"), F.struct(turn.isNotNull().alias("known"), turn.alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    turns = rows.where("conv IS NOT NULL").repartition("group").groupBy("group", "conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return turns.groupBy("group").agg(F.collect_list(F.struct("conv", F.transform("turns", lambda t: F.struct(t["digest"], t["bytes"])).alias("turns"))).alias("convs"))


def _as_key(conv: Column, turns: Column) -> Column:
    return F.struct(conv.alias("conv"), F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), "")).alias("key"), F.transform(turns, lambda t: t["bytes"]).alias("sizes"))


def plain(conversations: DataFrame) -> DataFrame:
    """conv, key, sizes of each conversation as it is."""
    return conversation_arrays(conversations).select(F.inline(F.transform("convs", lambda c: _as_key(c["conv"], c["turns"]))))


def rebuilt(conversations: DataFrame, block: int = 5, most: int = 9) -> DataFrame:
    """conv, key, sizes of each conversation c that takes its first h turns from conversation c - c % block (% cuts toward
    zero), h the crc32 of c in decimal modulo most, and the rest from itself. A group has less than two blocks of conversations."""
    given = F.get(F.filter("convs", lambda c: c["conv"] == F.col("group")), F.lit(0))["turns"]

    def one(c: Column) -> Column:
        h = (F.crc32(c["conv"].cast("string")) % most).cast("int")
        first = F.coalesce(F.slice(F.col("given"), F.lit(1), h), F.slice(c["turns"], 1, 0))
        return _as_key(c["conv"], F.concat(first, F.slice(c["turns"], h + 1, F.size(c["turns"]))))

    return conversation_arrays(conversations, block).withColumn("given", given).select(F.inline(F.transform("convs", one)))


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their starts."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i : i + WIDE] == b[i : i + WIDE]:
        i += WIDE
    return i // WIDE


def child_id(parent: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(parent + digest, digest_size=WIDE).digest()


def _sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


class _Open:
    """A node whose last member hasn't passed yet."""

    __slots__ = ("id", "bytes", "edge", "conv", "n", "children", "leaves", "saved", "ids", "length", "pieces", "sha")

    def __init__(self, node: bytes, size: int, edge: bool):
        self.id, self.bytes, self.edge = node, size, edge
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ids, self.length, self.pieces, self.sha = [], 0, 0, None

    def least(self, conv: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)


class Sweep:
    """The stack of open nodes over one partition; rows holds what is to be written."""

    def __init__(self, part: int):
        self.part, self.rows, self.stack, self.first, self.last, self.sizes = part, [], [], None, b"", None

    def take(self, key: bytes, conv: int, sizes: list[int]) -> None:
        depth = len(key) // WIDE
        if self.first is None:
            self.first, self.sizes = key, sizes
            self.stack.append(_Open(ROOT, 0, True))
            shared = 0
        else:
            shared = lcp(self.last, key)
            if key != self.last:
                self._run_over(self.stack[-1])
            self._close(shared)
        for d in range(shared, depth):
            self.stack.append(_Open(child_id(self.stack[-1].id, key[WIDE * d : WIDE * (d + 1)]), sizes[d], key is self.first))
        node = self.stack[-1]
        node.n += 1
        node.least(conv)
        node.ids.append(str(conv))
        node.length += len(node.ids[-1]) + 1
        if node.length > PIECE:
            self._piece(node)
        self.last = key

    def _piece(self, node: _Open) -> None:
        self.rows.append((RUN, node.id, None, None, None, None, None, None, None, None, None, self.part, node.pieces, ",".join(node.ids), None, None, None))
        node.ids, node.length, node.pieces = [], 0, node.pieces + 1

    def _run_over(self, node: _Open) -> None:
        """No more conversations end at node in this partition. A run that others may have begun is written in pieces."""
        if not node.ids:
            return
        if node.pieces or (node.edge and self.last == self.first):
            self._piece(node)
        else:
            node.sha, node.ids = _sha(node.ids), []

    def _close(self, shared: int, over: bool = False) -> None:
        """Close the nodes deeper than shared. over: the partition ends, and all that is open is a part."""
        below = None
        while len(self.stack) - 1 > shared:
            node, depth = self.stack.pop(), len(self.stack)
            part = over or node.edge
            if below:
                self.rows.append(below[:3] + (None if part else node.conv,) + below[4:])
            self._settle(node)
            up = self.stack[-1] if self.stack else None
            sha = node.sha if node.sha or node.pieces or part else _sha([])
            below = (PART if part else WHOLE, node.id, up.id if up else None, None, depth, node.conv, node.n, node.children, node.leaves, node.saved, sha, self.part, None, None, None, None, None)
            if up:
                up.n += node.n
                up.least(node.conv)
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved
        if below:
            self.rows.append(below)

    @staticmethod
    def _settle(node: _Open) -> None:
        node.leaves = node.leaves if node.children else 1
        node.saved += (node.n - 1) * node.bytes

    def end(self) -> None:
        if self.first is None:
            return
        node = self.stack[-1]
        if node.ids:
            self._piece(node)
        self._close(-1, over=True)
        self.rows.append((EDGE, *[None] * 10, self.part, None, None, self.first, self.sizes, self.last))


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(kinds: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, types[kind]) for name, kind in (x.split() for x in kinds.split(", "))])


def _swept(arrays: DataFrame) -> DataFrame:
    """Nodes, parts of nodes, runs of ids and edges of the sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, schema = Sweep(TaskContext.get().partitionId()), _arrow(_SWEPT)
        for b in batches:
            for key, conv, sizes in zip(*(b.column(c).to_pylist() for c in ("key", "conv", "sizes")), strict=True):
                sweep.take(key, conv, sizes)
                if len(sweep.rows) >= ROWS:
                    yield _batches(sweep.rows, schema)
                    sweep.rows = []
        sweep.end()
        if sweep.rows:
            yield _batches(sweep.rows, schema)
        trim()

    return arrays.select("key", "conv", "sizes").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(run, _SWEPT)


def corrections(before: bytes, first: bytes, sizes: list[int]) -> list[tuple]:
    """What the partitions on either side of a boundary have both counted, as rows of nodes: before ends one, first begins the other."""
    shared = lcp(before, first)
    leaf = -1 if WIDE * shared == len(before) else 0
    rows, node, up = [], ROOT, None
    saved = sum(sizes[:shared])
    for d in range(shared + 1):
        rows.append((PART, node, up, None, d, None, 0, -1 if d < shared else 0, leaf, saved, None))
        if d < shared:
            node, up = child_id(node, first[WIDE * d : WIDE * (d + 1)]), node
            saved -= sizes[d - 1] if d else 0
    return rows


def _stitched(swept: DataFrame) -> DataFrame:
    """The nodes on paths at boundaries, whole."""
    before = F.lag("last").over(Window.orderBy("part"))  # a row a partition
    edges = swept.where(F.col("kind") == EDGE).select("part", "first", "sizes", before.alias("before")).where("before IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_NODE)
        for b in batches:
            for before, first, sizes in zip(*(b.column(c).to_pylist() for c in ("before", "first", "sizes")), strict=True):
                yield _batches(corrections(before, first, sizes), schema)

    parts = swept.where(F.col("kind") == PART).select(*_arrow(_NODE).names)
    both = parts.union(edges.select("before", "first", "sizes").mapInArrow(run, _NODE))
    return both.groupBy("id").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in _SUMS], F.max("ends").alias("ends"))


def _hashed_runs(swept: DataFrame) -> DataFrame:
    """id, sha of nodes whose ids were written in pieces, streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, schema = None, None, pa.schema([("id", pa.binary()), ("sha", pa.string())])
        for b in batches:
            for node, piece in zip(b.column("id").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if node == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], schema=schema)
                    now, sha = node, hashlib.sha256()
                sha.update(piece.encode())
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], schema=schema)

    pieces = swept.where(F.col("kind") == RUN).select("id", "part", "seq", "piece")
    return pieces.repartition("id").sortWithinPartitions("id", "part", "seq").mapInArrow(run, "id binary, sha string")


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """Per node of arrays (conv, key, sizes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    swept = settle(_swept(arrays))
    columns = ["id", "parent", "parent_conv", "depth", "conv", *_SUMS, "ends"]
    stitched = settle(_stitched(swept).withColumn("parent_conv", F.lit(None).cast("long")).select(columns))
    whole = swept.where(F.col("kind") == WHOLE).select(columns)
    done = F.col("parent_conv").isNotNull() & F.col("ends").isNotNull()
    # a node whose parent stayed open when it closed: the parent has another child, or is stitched
    parents = whole.where("children > 1").union(stitched).select(F.col("id").alias("parent"), F.col("conv").alias("found"))
    rest = whole.where(~done).union(stitched).join(_hashed_runs(swept), "id", "left").join(parents, "parent", "left")
    rest = rest.withColumns({"parent_conv": F.coalesce("parent_conv", "found"), "ends": F.coalesce("sha", "ends", F.sha2(F.lit(""), 256))}).select(columns)
    names = {"conv": "conv_id", "depth": "depth", "parent_conv": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "ends": "ends_sha256"}
    return whole.where(done).union(rest).select(*[F.col(c).alias(n) for c, n in names.items()])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt with the first turns of others."""
    return prefix_trie(rebuilt(conversations))
