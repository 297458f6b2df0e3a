"""Paths that matter at size: files read in ranges, joins and look-backs split by time, sketches, clustering, views."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import features, governance, ops, scd2
from vigil.plans import tables
from vigil.plans.catalogue import QUERIES
from vigil.session import shared_folder
from vigil.sources import readers

SF = "/root/testdata/sf0.01"
TEXTS = "doc_id string, text string, lang string"


@pytest.fixture
def small_ranges(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_one_quoted_file_is_read_in_ranges(spark, small_ranges, line_end):
    rng = random.Random(2)
    texts = ['a "quoted" one\n\n"",\n"', "", '"', "\n", "plain", "x, y", None, "é\n" * 50]
    rows = [(str(i), rng.choice(texts) if i % 3 else "".join(rng.choices('ab,"\n ', k=400)).strip() or "x", "e,n" if i % 2 else None) for i in range(3000)]
    path = shared_folder(spark)
    quoted = lambda x: "" if x is None else '""' if x == "" else '"' + x.replace('"', '""') + '"'
    data = line_end.join(",".join(map(quoted, r)) for r in rows) + line_end
    place = path.removeprefix("file://")
    import os

    os.makedirs(place)
    with open(f"{place}/list.csv", "w", encoding="utf-8", newline="") as f:
        f.write(data)
    got = readers.quoted_records(spark, path, TEXTS)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 3
    want = [(a, b or None, c) for a, b, c in rows]
    assert sorted(((r.doc_id, r.text or None, r.lang) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_quoted_records_of_nothing(spark):
    path = shared_folder(spark)
    spark.createDataFrame([], "value string").write.text(path)
    assert readers.quoted_records(spark, path, TEXTS).count() == 0


@pytest.mark.parametrize("days", [1, 30, 100_000])
def test_as_of_join_against_brute_force(spark, days):
    rng = random.Random(days)
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(400))
    key = lambda: rng.choice(["hot", "hot", "a", "b", None])
    facts = [(i, key(), day() if rng.random() < 0.95 else None) for i in range(500)] + [(7, "a", datetime.date(2024, 5, 1))] * 2
    versions = list({(k, d): (k, d, rng.choice([None, "x", "y", "z"])) for k, d in ((key(), day()) for _ in range(60))}.values())
    want = []
    for i, k, at in facts:
        known = [v for v in versions if k is not None and at is not None and v[0] == k and v[1] <= at]
        last = max(known, key=lambda v: v[1], default=(None, None, None))
        want.append((i, k, at, last[1], last[2]))
    f = spark.createDataFrame(facts, "id long, k string, at date")
    v = spark.createDataFrame(versions, "k string, valid_from date, rule string")
    got = scd2.as_of_join(f, v, ["k"], "at", days=days)
    assert sorted((tuple(r) for r in got.select("id", "k", "at", "valid_from", "rule").collect()), key=repr) == sorted(want, key=repr)
    assert scd2.as_of_join(f, v.limit(0), ["k"], "at").where("rule IS NULL").count() == len(facts) and scd2.as_of_join(f.limit(0), v, ["k"], "at").count() == 0


def test_sketched_diversity_is_close(spark):
    errors = sorted(r.error for r in QUERIES["feat_diversity_sketched"](spark, SF).collect())
    assert len(errors) > 100 and errors[int(0.95 * len(errors))] < 0.03


def test_sketches_of_days_merge(spark):
    rows = [("h", str(i), 1.0, datetime.date(2024, 1, 1 + i % 28)) for i in range(20_000)] + [("q", None, 1.0, datetime.date(2024, 1, 5))]
    txns = spark.createDataFrame(rows, "source_account_id string, target_account_id string, amount double, event_date date")
    got = {r.account_id: r.counterparty_estimate_30d for r in features.diversity_of(features.diversity_sketches(txns), datetime.date(2024, 1, 28)).where("account_id = 'h'").collect()}
    assert got["h"] == pytest.approx(20_000, rel=0.05)


def test_clustering_by_both_columns_touches_few_files(spark):
    got = {(r.layout, r.filtered): r.touched for r in QUERIES["snk_clustered_layout"](spark, SF).collect()}
    assert sum(v for k, v in got.items() if k[0] == "clustered") < 0.5 * sum(v for k, v in got.items() if k[0] == "sorted")


def test_views_follow_the_role(spark):
    accounts = spark.createDataFrame([("a", "Ann", "1970-01-01")], "account_id string, synthetic_holder_name string, synthetic_dob string")
    alerts = spark.createDataFrame([("a", "open"), ("b", "suppressed")], "account_id string, status string")
    addresses = spark.createDataFrame([("a", "Road 1")], "account_id string, address_line string")
    governance.publish(spark, "analyst", accounts, addresses, alerts)
    see = lambda: (spark.table("account_view").first(), spark.table("address_view").first().address_line, spark.table("alert_view").count())
    masked, address, n = see()
    assert masked == governance.mask_accounts(accounts, "analyst").first() and address == "*** REDACTED ***" and n == 1
    governance.become(spark, "analytics_engineers")
    assert see()[0].synthetic_dob is None and see()[2] == 2
    governance.become(spark, "data_engineers")
    assert see() == (accounts.first(), "Road 1", 2)


def test_serving_view_finds_the_latest_publish(spark):
    profiles = spark.createDataFrame([("a",)], "account_id string")
    control = spark.createDataFrame([("p", "b1", datetime.datetime(2020, 1, 1)), ("p", "b2", datetime.datetime(2020, 1, 2)), ("q", "b3", datetime.datetime(2021, 1, 1))], "pipeline_name string, batch_id string, recorded_at timestamp")
    ops.publish_serving_view(profiles, control, "p", "serving_test")
    row = spark.table("serving_test").first()
    assert (row.account_id, row.as_of_batch_id, row.is_stale) == ("a", "b2", True)
    ops.publish_serving_view(profiles, control.limit(0), "p", "serving_test")
    assert spark.table("serving_test").first().is_stale is True


def test_tasks_of_a_join_are_as_many_as_the_rows_need(spark):
    rows, few = spark.range(10_000).select((F.col("id") % 700).alias("k")), spark.range(50).withColumnRenamed("id", "k")
    one, two = tables.spread(rows, few, "k", each=500)
    sizes = one.groupBy(F.spark_partition_id()).count().collect()
    assert one.rdd.getNumPartitions() == two.rdd.getNumPartitions() == 20 and max(r["count"] for r in sizes) < 1_500 and one.count() == 10_000
    assert tables.spread(rows, few, "k", each=5_000) == (rows, few) and tables.spread(rows.limit(0), few, "k")[0].count() == 0


def test_edges_deal_lines_by_their_number(spark, monkeypatch):
    real, plain = tables.spread, sorted(tables.edges(spark, SF).collect())
    monkeypatch.setattr(tables, "spread", lambda *args: real(*args, each=7_000))
    got = tables.edges(spark, SF)
    assert sorted(got.collect()) == plain and "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_whole_chain_does_each_step_once(spark, sf, monkeypatch):
    """alert_queue_screened: events are read once for both parties, edges meet classes before any summing, and people are made in as many tasks as shuffles have."""
    from vigil.operators import features, graph, identity, matching
    from vigil.plans import catalogue
    from vigil.plans import tables as t

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(features.account_txns(t.transactions(spark, sf))).count("FileScan parquet") == 1
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string")
    classes = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "unknown")], "node string, class string")
    counts = graph.neighbour_counts(edges, classes)
    assert plan(counts).count("HashAggregate") == 2
    assert {tuple(r) for r in counts.collect()} == {("a", 0, 2), ("b", 2, 2), ("c", 0, 1)}
    people = identity.assign(t.accounts(spark, sf), catalogue._watchlist(spark, sf), 0.10)
    assert "REPARTITION_BY_NUM" in plan(people)
    kept, real = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df: kept.append(df.columns) or real(df))
    catalogue.QUERIES["match_wratio_blocked"](spark, sf)
    assert kept == [["candidate_id", "c_country", "c_dob", "a"], ["cell", "side", "text"]]
