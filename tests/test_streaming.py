from __future__ import annotations

from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException

from vigil.sources import schemas
from vigil.sources.store import TableStore
from vigil.streaming import ingest, outcomes
from vigil.streaming.outcomes import FIRST, REPEATED, Outcomes


def rows(spark, values):
    return spark.createDataFrame([(str(a), str(b), str(v), str(t)) for a, b, v, t in values], schemas.TRANSACTIONS)


@pytest.fixture
def place(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/s"), f"file://{tmp_path}/in", f"file://{tmp_path}/check"


def drop(df, folder):
    df.coalesce(1).write.mode("append").option("header", True).csv(folder)


def test_duplicates_restart_and_late_rows(spark, place):
    store, source, check = place
    drop(rows(spark, [(1, 2, 1.5, t) for t in range(1, 21)] * 2), source)
    ingest.run(spark, source, store, check)
    assert store.read("txn_events").count() == 20
    drop(rows(spark, [(1, 2, 1.5, t) for t in range(1, 21)] + [(3, 4, 1.0, 30), (3, 4, 1.0, 2)]), source)
    ingest.run(spark, source, store, check)
    assert store.read("txn_events").count() == 22, "the late row is kept and repeats are not"
    assert store.read("ops_control").agg({"late_rows": "max"}).first()[0] > 0
    ingest.run(spark, source, store, check)
    assert store.read("txn_events").count() == 22


def test_state_drops_repeats_within_the_watermark(spark, place):
    store, source, check = place
    seen = []

    class Spy(ingest.BatchSink):
        def __call__(self, batch, number):
            seen.append(batch.count())
            super().__call__(batch, number)

    real, ingest.BatchSink = ingest.BatchSink, Spy
    try:
        drop(rows(spark, [(1, 2, 1.5, t) for t in range(1, 21)] * 2 + [(1, 2, 1.0, -1)]), source)
        ingest.run(spark, source, store, check, within="40 days", keep_late=False)
        drop(rows(spark, [(1, 2, 1.5, t) for t in range(1, 21)] + [(3, 4, 1.0, 30)]), source)
        ingest.run(spark, source, store, check, within="40 days", keep_late=False)
    finally:
        ingest.BatchSink = real
    assert sum(seen) == 22, "twenty rows once, a dead letter, and the new row"
    assert store.read("txn_events").count() == 21 and store.read("txn_events_dead_letter").count() == 1


def test_bad_time_does_not_move_the_clock(spark, place):
    store, source, check = place
    good = [(1, 2, 1.0, t) for t in range(1, 31)]
    drop(rows(spark, [*good, (9, 9, 1.0, "x")]), source)
    ingest.run(spark, source, store, check, files_per_batch=1)
    drop(rows(spark, [(5, 6, 1.0, 31)]), source)
    ingest.run(spark, source, store, check, files_per_batch=1)
    assert store.read("txn_events").where("sourceNodeId = 5").count() == 1
    assert [r._error_reason for r in store.read("txn_events_dead_letter").collect()] == ["bad_time"]


def test_breaker_leaves_a_trace(spark, place):
    store, source, check = place
    drop(rows(spark, [(1, 2, 1.0, 1), ("x", 2, 1.0, 1), (1, "", 1.0, 1)]), source)
    with pytest.raises(StreamingQueryException):
        ingest.run(spark, source, store, check)
    assert not store.exists("txn_events") and store.read("txn_events_dead_letter").count() == 2
    control = store.read("ops_control").collect()
    assert [(r.dead_letter_count, r.processed_row_count) for r in control] == [(2, 0)]


def test_replay_is_idempotent_and_keeps_the_rule(spark, place):
    store, source, check = place
    drop(rows(spark, [(1, 2, 1.0, t) for t in range(1, 41)] + [(1, 2, 1.0, -1)]), source)
    ingest.run(spark, source, store, check)
    assert ingest.replay(store) == 0
    store.append(rows(spark, [(7, 8, 2.0, 5)]), "txn_events_dead_letter")
    assert ingest.replay(store) == 1 and ingest.replay(store) == 0


def test_faults_and_feed(spark, tmp_path):
    from pyspark.sql import functions as F

    many = spark.range(20_000).selectExpr("cast(id as string) sourceNodeId", "cast(id % 100 as string) targetNodeId", "'1.0' value", "cast(id as string) time")
    broken = ingest.inject_faults(many, F.col("sourceNodeId"))
    bad = ingest.with_validity(broken).where("NOT _is_valid AND time <> '0'").count()
    assert 120 <= bad <= 280
    assert ingest.feed(many.limit(1200), f"file://{tmp_path}/feed", 500) == 1200
    assert len(list((tmp_path / "feed").glob("*.csv"))) == 3
    assert ingest.feed(many.limit(1200), f"file://{tmp_path}/paced", 500, 0.01) == 1200
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/paced").count() == 1200
    assert not list(tmp_path.glob("paced-*"))


def test_windows_extension(spark, tmp_path):
    drop(rows(spark, [(1, 2, 1.0, t) for t in range(1, 50)]), f"file://{tmp_path}/in")
    from vigil.sources.readers import transaction_stream

    q = ingest.windowed_counts(transaction_stream(spark, f"file://{tmp_path}/in")).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("w").collect()) == 49


def test_late_rows_have_a_table_of_their_own(spark, place):
    store, source, check = place
    early = [(1, 2, 1.5, t) for t in range(1, 101)]
    drop(rows(spark, [*early, *early, ("x", 2, 1.0, 5)]), source)
    ingest.run(spark, source, store, check, within="1 day")
    assert not store.exists("txn_events_late"), "nothing is late in the first batch"
    drop(rows(spark, [*early, (5, 6, 1.0, 99), (5, 6, 1.0, 76), (5, 6, 1.0, 75), (5, 6, 1.0, 75), (5, 6, 1.0, 300)]), source)
    ingest.run(spark, source, store, check, within="1 day")
    late = store.read("txn_events_late")
    assert late.where("sourceNodeId = 1").count() == 75 and late.where("sourceNodeId = 5").count() == 2, "as often as they came"
    assert {r.time for r in store.read("txn_events").where("sourceNodeId = 5").collect()} == {76, 99, 300}
    assert store.read("txn_events").count() == 103
    drop(rows(spark, [(5, 6, 1.0, 99), (5, 6, 1.0, 275), (5, 6, 1.0, 275), (5, 6, 1.0, 300)]), source)
    ingest.run(spark, source, store, check, within="1 day")
    control = [(r.expected_row_count, r.processed_row_count, r.repeated_rows, r.late_rows, r.dead_letter_count) for r in store.read("ops_control").orderBy("recorded_at").collect()]
    assert control == [(201, 100, 100, 0, 1), (105, 3, 25, 77, 0), (4, 0, 1, 3, 0)]
    assert all(r[0] == sum(r[1:]) for r in control)
    ingest.run(spark, source, store, check, within="1 day")
    assert store.read("ops_control").count() == 3 and spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != outcomes.ROCKSDB


def test_a_cell_is_dropped_as_time_passes(spark, place):
    """Keys stay in the state while they can repeat, and no longer: the state's rows go down when the watermark moves."""
    store, source, check = place
    drop(rows(spark, [(i, 2, 1.0, t) for i in range(5) for t in range(1, 25)]), source)
    first = ingest.run(spark, source, store, check, within="1 hour")
    kept = first.recentProgress[0].stateOperators[0].numRowsTotal
    drop(rows(spark, [(1, 2, 1.0, 2000)]), source)
    last = ingest.run(spark, source, store, check, within="1 hour")
    assert last.recentProgress[-1].stateOperators[0].numRowsTotal < kept


def test_sink_reads_the_last_time_from_the_log(spark, place):
    store, source, check = place
    drop(rows(spark, [(1, 2, 1.5, t) for t in range(1, 51)]), source)
    ingest.run(spark, source, store, check)
    last = ingest._last_time(store)
    assert last == store.read("txn_events").selectExpr("max(unix_micros(event_time))").first()[0] == store.note("txn_events", "last_event_time")
    store.compact("txn_events")
    assert store.note("txn_events", "last_event_time") == last
    drop(rows(spark, [(1, 2, 1.5, 7), (3, 4, 1.0, 8)]), source)
    ingest.run(spark, source, store, check)
    assert store.note("txn_events", "last_event_time") == last, "an older batch doesn't turn the clock back"
    assert store.read("ops_control").agg({"late_rows": "max"}).first()[0] == 2
    store.overwrite(store.read("txn_events"), "txn_events")
    assert store.note("txn_events", "last_event_time") is None and ingest._last_time(store) == last


def test_store_keeps_the_schema(spark, place):
    store = place[0]
    store.append(spark.range(3), "x")
    store.append(spark.range(3).selectExpr("id", "'a' AS more"), "x")
    assert store.read("x").columns == ["id", "more"] and store.read("x").where("more IS NULL").count() == 3
    assert store.read("x", 1).columns == ["id"]
    with pytest.raises(ValueError, match="id"):
        store.append(spark.range(3).selectExpr("CAST(id AS STRING) AS id"), "x")
    assert store.read("x").count() == 6


def test_state_takes_an_element_a_batch_and_not_a_key():
    kept, timers = [], []
    state = SimpleNamespace(get=lambda: iter(kept), appendList=kept.extend)
    cell = Outcomes(["key"])
    cell.init(SimpleNamespace(getListState=lambda *_: state, registerTimer=timers.append))
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    part = lambda keys: pd.DataFrame({"key": [f'["{k}"]' for k in keys], "at": 1})
    told = lambda *parts: [x for p in cell.handleInputRows((0, 9), iter(parts), clock) for x in p["outcome"]]
    assert told(part(range(1000)), part([999, 1000, 1000])) == [FIRST] * 1000 + [REPEATED, FIRST, REPEATED]
    assert told(part([0, 500, 1000, 1001])) == [REPEATED] * 3 + [FIRST]
    assert len(kept) == 3 and timers == [9]
