"""A table store on Parquet folders: snapshots with a pointer, history, idempotent appends, compaction and vacuum.

Layout: <root>/<table>/v=<n>/ are snapshots (sets of files that never change once written) and <root>/<table>/_log/<n>
names the folders that make up version n, with the rows' schema and notes by the writers. A version exists once its log entry does, and the entry is made by one atomic
rename, so readers see the old version or the new one. All file work goes through Spark's file system of the root path.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def interleaved(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """A Morton key: the bits of the columns' places between their least and greatest values, taken in turn; nulls are least."""
    bits = 60 // len(columns) if len(columns) > 3 else 20
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))]).first()
    key = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        low, high = ends[f"low{i}"], ends[f"high{i}"]
        scale = ((1 << bits) - 1) / (high - low) if low is not None and high > low else 0.0
        place = F.coalesce(((F.col(c).cast("double") - (low or 0.0)) * scale).cast("long"), F.lit(0).cast("long"))
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(place, b).bitwiseAND(1), b * len(columns) + i))
    return key


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def versions(self, table: str) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.root}/{table}/_log") if n.isdigit())

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def _entry(self, table: str, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{table}/_log/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, table: str, version: int, folders: list[str], token: str | None, schema: T.StructType, notes: dict) -> None:
        log = f"{self.root}/{table}/_log"
        part = self._path(f"{log}/.{uuid.uuid4().hex}")
        done = self._last(table)["done"]
        if token is not None:
            writer, number = self._token(token)
            done[writer] = max(number, done.get(writer, -1))
        out = self._fs.create(part)
        out.write(json.dumps({"folders": folders, "at": time.time(), "done": done, "schema": schema.jsonValue(), "notes": notes}).encode())
        out.close()
        target = self._path(f"{log}/{version}")
        if self._fs.exists(target) or not self._fs.rename(part, target):
            raise RuntimeError(f"version {version} of {table} was written by another writer")

    def _last(self, table: str) -> dict:
        have = self.versions(table)
        return self._entry(table, have[-1]) if have else {"folders": [], "done": {}}

    def note(self, table: str, name: str):
        """What a writer last noted under a name, which costs no scan; None if nobody did."""
        return self._last(table).get("notes", {}).get(name)

    def _schema(self, entry: dict) -> T.StructType | None:
        """The schema of an entry's rows; where it names none (an older entry), the files' own are merged."""
        if "schema" in entry:
            return T.StructType.fromJson(entry["schema"])
        return self.spark.read.option("mergeSchema", True).parquet(*entry["folders"]).schema if entry["folders"] else None

    @staticmethod
    def _with_new_columns(old: T.StructType | None, new: T.StructType) -> T.StructType:
        known = {f.name: f.dataType.simpleString() for f in old or []}
        changed = [f.name for f in new if known.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString()]
        if changed:
            raise ValueError(f"columns of another type than before: {', '.join(changed)}")
        return T.StructType([*(old or []), *[f for f in new if f.name not in known]])

    @staticmethod
    def _token(token: str) -> tuple[str, int]:
        """A writer and its batch's number, from writer-number; a writer's numbers rise."""
        writer, _, number = token.rpartition("-")
        return (writer, int(number)) if writer and number.isdigit() else (token, 0)

    def _written(self, table: str, have: list[int], token: str | None) -> bool:
        if token is None or not have:
            return False
        writer, number = self._token(token)
        return self._entry(table, have[-1])["done"].get(writer, -1) >= number

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The current version, or an earlier one; added columns are null in older files."""
        have = self.versions(table)
        v = have[-1] if version is None else version
        if v not in have:
            raise ValueError(f"{table} has no version {v}")
        entry = self._entry(table, v)
        return self.spark.read.schema(self._schema(entry)).parquet(*entry["folders"])

    def _write(self, df: DataFrame, table: str, partition_by: tuple[str, ...], rows_per_file: int) -> str:
        folder = f"{self.root}/{table}/v={uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", rows_per_file)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
        return folder

    def overwrite(self, df: DataFrame, table: str, cluster_by: tuple[str, ...] = (), partition_by: tuple[str, ...] = (), check: Callable[[DataFrame], None] | None = None, token: str | None = None, rows_per_file: int = 5_000_000, together: bool = False, files: int | None = None, notes: dict | None = None) -> int:
        """A new version with df's rows alone; `check` sees the written rows before anyone else, and may raise.

        cluster_by: columns to sort by, the first before the second, or, together, numbers that count alike: then a file
        holds a narrow range of each of them. files: how many to make.
        """
        if cluster_by:
            by = [F.col(c) for c in cluster_by]
            if together:
                by = [interleaved(df, cluster_by)]
            df = df.repartitionByRange(*([files] if files else []), *by).sortWithinPartitions(*by)
        folder = self._write(df, table, partition_by, rows_per_file)
        if check:
            check(self.spark.read.parquet(folder))
        return self._next(table, [folder], token, df.schema, notes or {})

    def _next(self, table: str, folders: list[str], token: str | None, schema: T.StructType, notes: dict) -> int:
        version = (self.versions(table) or [0])[-1] + 1
        self._commit(table, version, folders, token, schema, notes)
        return version

    def append(self, df: DataFrame, table: str, token: str | None = None, partition_by: tuple[str, ...] = (), notes: dict | None = None) -> int:
        """The rows of df added; with a token that has been written, nothing. The last entry knows each writer's last number.

        Columns may be added, but a column's type can't change. notes: small facts for `note`, added to the earlier ones.
        """
        have = self.versions(table)
        if self._written(table, have, token):
            return have[-1]
        last = self._last(table)
        schema = self._with_new_columns(self._schema(last), df.schema)
        return self._next(table, [*last["folders"], self._write(df, table, partition_by, 5_000_000)], token, schema, last.get("notes", {}) | (notes or {}))

    def append_if_any(self, df: DataFrame, table: str) -> int | None:
        return None if df.isEmpty() else self.append(df, table)

    def merge_new(self, df: DataFrame, table: str, keys: list[str], token: str | None = None, prune: str | None = None, notes: dict | None = None) -> int:
        """Rows whose keys aren't there yet (one of each key) added, and how many: feeding a batch twice changes nothing.

        Null keys are equal. prune: a key whose range in df limits what is read of the table (by the files' statistics).
        """
        have = self.versions(table)
        if self._written(table, have, token):
            return 0
        new = df.dropDuplicates(keys)
        if have:
            there = self.read(table).select(*keys)
            if prune:
                low, high = df.agg(F.min(prune), F.max(prune)).first()
                there = there.where(F.lit(False) if low is None else F.col(prune).between(low, high))
            marked = there.select(*[there[k].alias(f"_{k}") for k in keys])
            cond = None
            for k in keys:
                same = new[k].eqNullSafe(marked[f"_{k}"])
                cond = same if cond is None else cond & same
            new = new.join(marked, cond, "left_anti")
        seen = Observation()
        self.append(new.observe(seen, F.count(F.lit(1)).alias("n")), table, token, notes=notes)
        return seen.get["n"]

    def seed(self, df: DataFrame, table: str) -> bool:
        """df's rows if the table is missing or empty; history is never wiped."""
        if self.exists(table) and not self.read(table).isEmpty():
            return False
        self.append(df, table)
        return True

    def compact(self, table: str, file_bytes: int = 128 << 20, cluster_by: tuple[str, ...] = ()) -> int:
        """The same rows in files of about file_bytes."""
        rows = self.read(table)
        last = self._last(table)
        size = sum(self._fs.getContentSummary(self._path(f)).getLength() for f in last["folders"])
        return self.overwrite(rows if cluster_by else rows.repartition(max(1, -(-size // file_bytes))), table, cluster_by, notes=last.get("notes"))

    def vacuum(self, table: str, keep_hours: float = 168.0) -> int:
        """Drop versions older than keep_hours (never the current one) and folders that no kept version needs."""
        have = self.versions(table)
        old = [v for v in have[:-1] if self._entry(table, v)["at"] < time.time() - 3600 * keep_hours]
        kept = {f for v in have if v not in old for f in self._entry(table, v)["folders"]}
        for v in old:
            self._fs.delete(self._path(f"{self.root}/{table}/_log/{v}"), False)
        gone = [n for n in self._names(f"{self.root}/{table}") if n.startswith("v=") and f"{self.root}/{table}/{n}" not in kept]
        for n in gone if old else ():
            self._fs.delete(self._path(f"{self.root}/{table}/{n}"), True)
        return len(gone) if old else 0

    def maintain(self, tables: list[str]) -> dict[str, list[str]]:
        """Compact and vacuum the tables that exist."""
        done = [t for t in tables if self.exists(t)]
        for t in done:
            self.compact(t)
            self.vacuum(t)
        return {"maintained": done, "skipped": [t for t in tables if t not in done]}
