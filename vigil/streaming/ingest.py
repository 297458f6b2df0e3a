"""Streaming ingestion of transactions: validity before the watermark, bounded dedup, idempotent multi-sink batches.

Invalid rows never touch the watermark (they have no event time that could move it). The sink merges by natural key, so
rows older than what the target has seen go in and are counted as late. On request, the stream itself tells valid rows that
are new from repeats and from those later than a watermark, which go to a table of their own; its state is dropped as time
passes. Dead letters (once each, however often they are
delivered) and the control row are written before the breaker stops a batch, so a failing batch leaves a trace. Every write carries the
batch's token, so a batch that runs again after a restart changes nothing.
"""

from __future__ import annotations

import contextlib
import datetime
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.clock import step_to_time
from vigil.operators import ops
from vigil.operators.quality import DataContractError, transaction_error, valid_transaction
from vigil.sources.readers import new_batch_id, stamp, transaction_stream
from vigil.sources.store import TableStore
from vigil.streaming.outcomes import FIRST, LATE, REPEATED, rocksdb, with_outcome

KEYS = ["sourceNodeId", "targetNodeId", "value", "time"]
WATERMARK = "10 minutes"
MOST_INVALID = 0.10
PIPELINE = "txn_stream_ingest"


def with_validity(rows: DataFrame) -> DataFrame:
    valid = valid_transaction()
    return rows.withColumns({"_is_valid": valid, "event_time": F.when(valid, step_to_time(F.expr("try_cast(time AS INT)")))})


def typed(valid: DataFrame) -> DataFrame:
    return valid.select(F.expr("CAST(sourceNodeId AS INT)").alias("sourceNodeId"), F.expr("CAST(targetNodeId AS INT)").alias("targetNodeId"), F.expr("CAST(value AS DOUBLE)").alias("value"), F.expr("CAST(time AS INT)").alias("time"), "event_time")


def deduplicated(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """The stream's valid rows once each within the watermark, and its invalid rows as they are (they have no event time)."""
    checked = with_validity(stream)
    valid = checked.where("_is_valid").withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(KEYS)
    return valid.select(*KEYS).union(checked.where("NOT _is_valid").select(*KEYS))


def told_apart(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """All of the stream's rows: the valid ones as first, repeated or late, the invalid ones without an outcome."""
    checked = with_validity(stream)
    valid = with_outcome(checked.where("_is_valid").select(*KEYS, "event_time"), KEYS, "event_time", watermark)
    return valid.select(*KEYS, "outcome").union(checked.where("NOT _is_valid").select(*KEYS, F.lit(None).cast("string")))


def _last_time(store: TableStore) -> int | None:
    """The latest event time of the target, in microseconds: from its log; from its rows only if no writer noted it."""
    if not store.exists("txn_events"):
        return None
    noted = store.note("txn_events", "last_event_time")
    return store.read("txn_events").agg(F.max(F.unix_micros("event_time"))).first()[0] if noted is None else noted


def _latest(*times: int | None) -> dict[str, int]:
    known = [x for x in times if x is not None]
    return {"last_event_time": max(known)} if known else {}


class BatchSink:
    """What happens to each micro-batch; `most_invalid` opens the breaker.

    A batch that tells outcomes apart sends first rows to the target, late rows, each as often as it came, to a table of
    their own, and repeats to neither; the control row counts all three.
    """

    def __init__(self, store: TableStore, query: str, most_invalid: float = MOST_INVALID, source: str = "stream"):
        self.store, self.query, self.most_invalid, self.source = store, query, most_invalid, source
        self.batch_id, self.started = new_batch_id(), datetime.datetime.now(datetime.timezone.utc)

    def __call__(self, batch: DataFrame, number: int) -> None:
        token, began = f"{self.query}-{number}", time.time()
        told = "outcome" in batch.columns
        rows = with_validity(batch if told else batch.withColumn("outcome", F.lit(FIRST))).persist()
        try:
            good, of = F.col("_is_valid"), lambda outcome: F.count_if(F.col("_is_valid") & (F.col("outcome") == outcome))
            n = rows.agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), of(FIRST).alias("first"), of(REPEATED).alias("repeated"), of(LATE).alias("late"), F.max(F.when(good, F.col("event_time"))).alias("last"), F.max(F.when(good & (F.col("outcome") == FIRST), F.unix_micros("event_time"))).alias("micros")).first()
            if not n.good + n.bad:
                return  # a batch that only moves the watermark
            if n.bad:
                dead = rows.where("NOT _is_valid").select(*KEYS, transaction_error().alias("_error_reason"))
                self.store.merge_new(self._stamped(dead), "txn_events_dead_letter", [*KEYS, "_error_reason"], token)
            share = n.bad / (n.good + n.bad)
            blocked = share > self.most_invalid
            late = n.late
            if n.late and not blocked:
                self.store.append(self._stamped(typed(rows.where(good & (F.col("outcome") == LATE)))), "txn_events_late", token)
            if n.first and not blocked:
                late += self._merge(typed(rows.where(good & (F.col("outcome") == FIRST))), token, n.micros, count_late=not told)
            lag = (self.started.replace(tzinfo=None) - n.last).total_seconds() if n.last else float("inf")
            row = ops.control_row(PIPELINE, "transaction_monitoring", "txn_events", token, n.good + n.bad, 0 if blocked else n.first, n.bad, lag, time.time() - began, "stream", {}, datetime.datetime.now(), last_good=None)
            control = batch.sparkSession.createDataFrame([row], ops.CONTROL_SCHEMA).withColumns({"late_rows": F.lit(late), "repeated_rows": F.lit(n.repeated)})
            self.store.append(control, "ops_control", token)
            if blocked:
                raise DataContractError(f"batch {number}: {share:.1%} of the rows are invalid")
        finally:
            rows.unpersist()

    def _stamped(self, rows: DataFrame) -> DataFrame:
        return stamp(rows, self.batch_id, self.started, self.source)

    def _merge(self, good: DataFrame, token: str, last: int, count_late: bool) -> int:
        """Rows into the target; how many of them are older than what it has seen, less the delay."""
        seen, late = _last_time(self.store), 0
        if count_late and seen is not None:
            late = good.where(F.col("event_time") < F.timestamp_micros(F.lit(seen)) - F.expr(f"INTERVAL {WATERMARK.upper()}")).count()
        self.store.merge_new(self._stamped(good), "txn_events", KEYS, token, prune="time", notes=_latest(seen, last))
        return late


def run(spark: SparkSession, source_dir: str, store: TableStore, checkpoint: str, files_per_batch: int | None = None, most_invalid: float = MOST_INVALID, timeout: int | None = None, within: str | None = None, keep_late: bool = True):
    """Take in everything that is there now, then stop; a second run goes on where the first one ended.

    within: a watermark. With one, the stream itself keeps the keys of that long a time and tells repeats and valid rows
    that come later than it from the rest, so that none is lost: first, repeated, late and dead rows are all rows.
    Without keep_late, Spark's own operator drops repeats and late rows, which costs no Python and leaves no trace of
    them. Without a watermark, the sink's merge alone drops repeats, and late rows go in and are counted. A checkpoint
    belongs to one of these ways.
    """
    stream = transaction_stream(spark, source_dir, files_per_batch)
    if within:
        stream = told_apart(stream, within) if keep_late else deduplicated(stream, within)
    with rocksdb(spark) if within and keep_late else contextlib.nullcontext():
        query = stream.writeStream.foreachBatch(BatchSink(store, "txn", most_invalid)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
    return query


def replay(store: TableStore, limit: int | None = None) -> int:
    """Dead letters that have become valid, by the same rule, into the target; replaying twice changes nothing."""
    dead = store.read("txn_events_dead_letter").select(*KEYS)
    good = with_validity(dead).where("_is_valid")
    good = typed(good.orderBy(*KEYS).limit(limit) if limit else good)
    now = datetime.datetime.now(datetime.timezone.utc)
    last = good.agg(F.max(F.unix_micros("event_time"))).first()[0]
    return store.merge_new(stamp(good, new_batch_id(), now, "replay"), "txn_events", KEYS, prune="time", notes=_latest(_last_time(store), last))


def inject_faults(rows: DataFrame, key: Column, per_mille: int = 10) -> DataFrame:
    """About per_mille of the rows get a bad value, no target, or a negative time, by hash of key."""
    h = F.xxhash64(key)
    hit, kind = F.pmod(h, F.lit(1000)) < per_mille, F.pmod(F.shiftright(h, 20), F.lit(3))
    return rows.withColumns({
        "value": F.when(hit & (kind == 0), "not_a_number").otherwise(F.col("value")),
        "targetNodeId": F.when(hit & (kind == 1), None).otherwise(F.col("targetNodeId")),
        "time": F.when(hit & (kind == 2), "-1").otherwise(F.col("time")),
    })


def feed(rows: DataFrame, folder: str, rows_per_file: int = 500, delay: float = 0.0) -> int:
    """Write raw transactions as CSV files in order of time (as a number), so that later files hold later rows.

    With a delay, files are written aside and moved in one by one, so many seconds apart; a reader never sees half a file.
    """
    n = rows.count()
    files = max(1, -(-n // rows_per_file))
    ordered = rows.repartitionByRange(files, F.expr("try_cast(time AS INT)").asc_nulls_first(), *KEYS[:2]).sortWithinPartitions(F.expr("try_cast(time AS INT)"))
    if not delay:
        ordered.write.mode("append").option("header", True).csv(folder)
        return n
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    aside = f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    ordered.write.option("header", True).csv(aside)
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for name in sorted(s.getPath().getName() for s in fs.listStatus(path(aside))):
        if name.startswith("part-"):
            fs.rename(path(f"{aside}/{name}"), path(f"{folder.rstrip('/')}/{name}"))
            time.sleep(delay)
    fs.delete(path(aside), True)
    return n


def windowed_counts(stream: DataFrame, length: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """Extension: counts and sums of valid rows by event-time window and source; any output mode."""
    rows = typed(with_validity(stream).where("_is_valid")).withWatermark("event_time", watermark)
    return rows.groupBy(F.window("event_time", length).alias("w"), "sourceNodeId").agg(F.count("*").alias("n"), F.sum("value").alias("amount"))
