"""What becomes of each row of a stream: taken in (first), seen before (repeated) or later than the watermark (late).

The state is kept in cells: a cell holds the keys, of one bucket by hash, whose event times lie in one span of time. A
cell is one list in the state store, whose elements are the new keys of a batch in one string (JSON has no line breaks, so
these part them); a batch costs a few calls and elements a cell and none a row, and one event-time timer drops a cell whole, once the watermark has passed its end: from then on all its rows are
late, and nothing need be remembered of them. Equal keys must have equal event times, as they do where the event time is
one of the key's fields.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

FIRST, REPEATED, LATE = "first", "repeated", "late"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Outcomes(StatefulProcessor):
    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", T.StructType([T.StructField("key", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 (the interface's name)
        mark, end = timerValues.getCurrentWatermarkInMs() * 1000, key[1]
        known = None
        for part in rows:
            late = part["at"] < mark
            if known is None and not late.all():
                known = {k for (keys,) in self.seen.get() for k in keys.split("\n")}
                if not known:
                    self.handle.registerTimer(end)
            on_time = part.loc[~late, "key"]
            new = ~on_time.duplicated() & ~on_time.isin(known or ())
            outcome = pd.Series(LATE, index=part.index, dtype=object)
            outcome[on_time.index] = new.map({True: FIRST, False: REPEATED})
            fresh = on_time[new].tolist()
            if fresh:
                self.seen.appendList([("\n".join(fresh),)])
                known.update(fresh)
            yield part[self.columns].assign(outcome=outcome)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_outcome(stream: DataFrame, keys: list[str], event_time: str, watermark: str, buckets: int = 16, span_seconds: int = 86_400) -> DataFrame:
    """All rows of the stream, each with its outcome; event_time must not be null, and follows from the keys.

    A row is late if its event time lies before the watermark, which is the latest event time of earlier batches less
    `watermark`; else it is the first of its key or repeats it (of equal rows in a batch any one is the first). Null keys
    are equal. buckets and span_seconds set the size of a cell, whose keys a worker holds at once; with very many rows
    take more buckets. Both belong to the checkpoint and must stay as they are when the stream starts anew.
    """
    columns = stream.columns
    span = span_seconds * 1_000_000
    # The time goes on as a plain number: Spark itself drops late rows where the watermark's column reaches the state.
    marked = stream.withWatermark(event_time, watermark).withColumn("at", F.unix_micros(event_time))
    plain = marked.withColumn(event_time, F.timestamp_micros("at"))
    plain = plain.withColumns({
        "key": F.to_json(F.array(*[F.col(k).cast("string") for k in keys])),
        "bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)),
        "until": F.floor(F.col("at") / F.lit(span)).cast("long") * (span // 1000) + span // 1000,
    })
    schema = T.StructType([*plain.select(*columns).schema.fields, T.StructField("outcome", T.StringType())])
    return plain.groupBy("bucket", "until").transformWithStateInPandas(Outcomes(columns), schema, "append", "EventTime")


class rocksdb:
    """While it is open, streams that start keep their state in RocksDB, which timers and lists need."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.before)
