from __future__ import annotations

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.functions.text import normalize_name
from vigil.operators import entities, governance, graph, identity, matching, ops, quality, scd2, scoring
from vigil.plans import runner
from vigil.sources import readers, schemas
from vigil.sources.store import TableStore

WATCH = "entity_id string, name string, aliases array<string>, country string, dob string"
CANDIDATES = "candidate_id string, name string, country string, dob string"


def screen(spark, candidates, watch, **k):
    out = matching.screen(spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(watch, WATCH), **k)
    return {(r.candidate_id, r.entity_id): r for r in out.collect()}


def test_bands_and_bonuses(spark):
    watch = [("36", "AEROCARIBBEAN AIRLINES", ["AERO-CARIBBEAN"], "CU", "01 Jan 1970"), ("306", "BANCO NACIONAL DE CUBA", ["NATIONAL BANK OF CUBA"], "CU", None)]
    people = [
        ("exact", "AeroCaribbean Airlines", None, None),
        ("alias", "Aero Caribbean", None, None),
        ("typo", "Aerocarribean Airlines", None, None),
        ("weak", "Aerocaribbean Support Services", None, None),
        ("country", "Aerocaribbean Support Services", " cu ", None),
        ("both", "Aerocaribbean Support Services", "CU", "1970-01-01"),
        ("other", "Aerocaribbean Support Services", "US", None),
        ("none", "Completely Unrelated Trading Co", None, None),
        ("bank", "National Bank of Cuba", None, None),
        ("blank", " ", None, None),
        ("null", None, None, None),
    ]
    got = screen(spark, people, watch)
    see = {c: (r.match_confidence_band, r.match_score, r.matched_on_field) for (c, _), r in got.items()}
    assert see["exact"] == ("exact", 100.0, "primary_name") and see["alias"][0] == "exact" and see["alias"][2] == "alias"
    assert see["typo"][0] == "strong" and 90 <= see["typo"][1] < 100
    assert see["weak"] == ("weak", 86.67, "alias") and see["country"] == ("weak", 89.67, "alias") and see["both"] == ("strong", 94.67, "alias") and see["other"] == see["weak"]
    assert see["bank"][0] == "exact" and not {"none", "blank", "null"} & see.keys()


def test_blocked_screen_equals_single_comparisons(spark):
    names = ["JOHN SMITH", "JON SMITH", "JOHN A SMITH", "SMITH JOHN", "JANE SMYTHE", "JOHNSON SMITHERS", "BANK OF JOHN"]
    watch = [(f"e{i}", n, None, None, None) for i, n in enumerate(names)]
    got = screen(spark, [(f"c{i}", n.title(), None, None) for i, n in enumerate(names)], watch, pairs=9)
    from vigil.functions.similarity import score

    want = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if a[0] == b[0] and score(a, b) >= matching.FLOOR:
                want[f"c{i}", f"e{j}"] = round(score(a, b), 2)
    assert {k: r.match_score for k, r in got.items()} == want


def test_identities(spark):
    accounts = spark.range(3000).select(F.concat(F.lit("ACC"), F.col("id").cast("string")).alias("account_id"))
    watch = spark.createDataFrame([("e1", "MARIA GARCIA LOPEZ"), ("e2", "BANCO NACIONAL DE CUBA")], "entity_id string, name string")
    one = identity.assign(accounts, watch).collect()
    two = identity.assign(accounts.repartition(7), watch).collect()
    assert sorted(one) == sorted(two)
    seeded = [r for r in one if r.is_seeded_collision]
    assert 30 <= len(seeded) <= 95 and {r.seeded_from_entity_id for r in seeded} == {"e1", "e2"}
    from vigil.functions.similarity import score

    real = {"e1": "MARIA GARCIA LOPEZ", "e2": "BANCO NACIONAL DE CUBA"}
    assert min(score(normalize_name(r.synthetic_holder_name), real[r.seeded_from_entity_id]) for r in seeded) >= 70
    assert len({r.synthetic_holder_name for r in seeded}) > 6
    assert not any(r.is_seeded_collision for r in identity.assign(accounts, watch.limit(0)).collect())


def test_every_entity_can_be_drawn(spark):
    accounts = spark.range(30_000).select(F.col("id").cast("string").alias("account_id"))
    watch = spark.range(6000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity_id"), F.lit("SOME NAME").alias("name"))
    assert sorted(r.number for r in identity.numbered(watch, "entity_id", 64).collect()) == list(range(6000))
    drawn = identity.assign(accounts, watch, 1.0).select("seeded_from_entity_id").distinct().count()
    assert drawn > 5900


def test_one_match_is_explained(spark):
    entity = ("e1", "Ivan Petrov", ["Vanya  PETROV", "I. Petrov"], "ru", "01 Jan 1970")
    got = matching.explain(spark, ("vanya petrov", " RU", "1970-01-01"), entity)
    assert (got.matched_on_field, got.matched_on_spelling, got.raw_score, got.bonus, got.match_score) == ("alias", "Vanya  PETROV", 100.0, 8.0, 100.0)
    assert got.match_confidence_band == "exact" and got.country_match and got.dob_match
    weak = matching.explain(spark, ("Ivan Petrow", None, None), entity)
    assert weak.matched_on_field == "primary_name" and weak.bonus == 0 and not weak.country_match and weak.raw_score == weak.match_score < 100
    assert matching.explain(spark, ("Zoe Smith", None, None), entity) is None


def test_schema_history(spark, tmp_path):
    import datetime

    store, at = TableStore(spark, f"file://{tmp_path}/s"), datetime.datetime(2026, 1, 1)
    schema = lambda text: spark.createDataFrame([], text).schema
    assert not ops.observe_schema(store, "p", "t", schema("a int, b string"), at)["is_breaking"]
    with pytest.raises(quality.DataContractError):
        ops.observe_schema(store, "p", "t", schema("a string, b string"), at + datetime.timedelta(days=1))
    with pytest.raises(quality.DataContractError):  # still compared with the last one that was accepted
        ops.observe_schema(store, "p", "t", schema("a string, b string"), at + datetime.timedelta(days=2))
    ops.accept_schema(store, "p", "t", schema("a string, b string"), at + datetime.timedelta(days=3))
    assert ops.observe_schema(store, "p", "t", schema("a string, b string, c int"), at + datetime.timedelta(days=4))["added"] == ["c"]
    assert [r.is_breaking for r in store.read("ops_schema_drift").orderBy("observed_at").collect()] == [False, True, True, False, False]


def test_tokens_and_pruned_merge(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, time int")
    assert store.merge_new(rows((1, 1), (2, 2), (2, 2)), "t", ["k", "time"], "q-0", prune="time") == 2
    assert store.merge_new(rows((9, 9)), "t", ["k", "time"], "q-0", prune="time") == 0, "that batch has been written"
    assert store.merge_new(rows((2, 2), (3, 3), (None, None)), "t", ["k", "time"], "q-1", prune="time") == 2
    store.append(rows((5, 5)), "t", "other-0")
    assert store.append(rows((5, 5)), "t", "q-1") == 3 and store.read("t").count() == 5
    store.compact("t")
    assert store.append(rows((5, 5)), "t", "other-0") == 4 and store.read("t").count() == 5, "tokens outlive a compaction"


def test_queue_of_the_whole_chain(spark, sf):
    """Scores put together in Python from what screening, graph and features say."""
    from vigil.plans import catalogue, jobs
    from vigil.plans import tables as t

    rank = {"exact": 3, "strong": 2, "weak": 1}
    points = {0: 0, 1: 10, 2: 30, 3: 50}
    accounts = t.accounts(spark, sf)
    best, risky = Counter(), set()
    for r in jobs.screened(accounts, catalogue._watchlist(spark, sf), 0.10).collect():
        best[r.account_id] = max(best[r.account_id], rank[r.match_confidence_band])
        if r.match_confidence_band != "weak":
            risky.add(r.account_id)
    network = {r.account_id: r.network_risk_exposure for r in graph.network_reference(accounts, graph.node_risk(t.classes(spark, sf), t.edges(spark, sf))).collect()}
    met = set()
    for r in t.transactions(spark, sf).select("source_account_id", "target_account_id").collect():
        met |= {r[0]} if r[1] in risky else set()
        met |= {r[1]} if r[0] in risky else set()
    plain = {r.account_id: r for r in t.profiles(spark, sf).collect()}
    want = {}
    for a, r in plain.items():
        behaviour = r.pts_velocity + r.pts_diversity + r.pts_round_dollar + r.pts_burst
        total = min(100, points[best[a]] + behaviour + 20 * (a in met) + 15 * (network.get(a, 0) > t.STAND_IN_RULES["thr_network_risk"]))
        if best[a] == 3 or total >= t.STAND_IN_RULES["alert_min_score"]:
            want[a] = total
    got = catalogue.QUERIES["alert_queue_screened"](spark, sf).collect()
    assert {r.account_id: r.composite_risk_score for r in got} == want and risky and network
    scores = sorted(want.values(), reverse=True)
    assert all(r.priority_rank == scores.index(r.composite_risk_score) + 1 for r in got)


def test_jobs_run(spark, sf, tmp_path):
    from vigil.plans import jobs

    store = TableStore(spark, f"file://{tmp_path}/s")
    ended = jobs.run("month_end", spark, sf, store)
    assert ended[-3:] == ["gold", "gate", "publish"] and set(ended) == set(runner.JOBS["month_end"])
    assert store.read("profiles").count() == spark.read.parquet(f"{sf}/customer.parquet").count()
    assert store.read("ops_control").first().pipeline_name == "gold_month_end_publish"
    jobs.run("streaming", spark, sf, store)
    assert store.read("txn_events").count() > 0
    jobs.run("replay", spark, sf, store)
    jobs.run("maintenance", spark, sf, store)
    assert jobs.run("bronze", spark, sf, store) and store.read("edges").count() > 0
    for name, graph_of in runner.JOBS.items():
        assert set(graph_of) <= set(jobs.tasks(spark, sf, store, datetime.datetime(2026, 1, 1))), name


def test_staging(tmp_path):
    import tarfile

    from vigil.sources import stage

    (tmp_path / "a.csv").write_text("x,y")
    (tmp_path / "b.csv").write_text("1,2,3")
    with tarfile.open(tmp_path / "all.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "b.csv", "deep/b.csv")
    assert stage.fetch(f"file://{tmp_path}/a.csv", tmp_path / "to" / "a.csv") == 3
    got = stage.stage({"one": (f"file://{tmp_path}/a.csv",), "two": (f"{tmp_path}/all.tar.gz",)}, tmp_path / "staged")
    assert got == {"one": ["a.csv"], "two": ["b.csv"]} and (tmp_path / "staged/two/b.csv").read_text() == "1,2,3"
    with pytest.raises(ValueError):
        stage.stage({}, tmp_path, ("three",))
    with pytest.raises(OSError):
        stage.fetch(f"{tmp_path}/missing", tmp_path / "none")
    assert not (tmp_path / "none").exists() and not list(tmp_path.glob(".*"))


def test_static_scans(tmp_path):
    from pathlib import Path

    from vigil.plans import scans

    bad = "try:\n    x()\nexcept Exception:\n    y = 1\ntry:\n    x()\nexcept ValueError:\n    pass\ntry:\n    x()\nexcept Exception:\n    raise\napi_key = 'k'\nname = 'n'\n"
    assert scans.swallowed(bad) == [(3, "broad"), (7, "silent")] and scans.secrets(bad) == [(13, "api_key")]
    assert scans.personal_fields(["id", "email", "birth_date"], frozenset({"email"})) == ["birth_date"]
    for name in ("a.sql", "b.sql", "a.md"):
        (tmp_path / name).write_text("")
    assert scans.without_companion(tmp_path) == ["b.sql"]
    found = scans.scan(Path(scans.__file__).parent.parent)
    assert not found["secrets"] and not found["swallowed"]


def test_validity_and_contracts(spark):
    rows = [("1", "2", "3.5", "4"), ("99999999999", "2", "1", "1"), ("1", None, "1", "1"), ("1", "2", "x", "1"), ("1", "2", "NaN", "1"), ("1", "2", "1", "0"), ("1", "2", "1", "-1"), ("1.5", "2", "1", "1")]
    df = spark.createDataFrame(rows, schemas.TRANSACTIONS)
    good, bad = quality.split_valid(df, quality.valid_transaction(), quality.transaction_error())
    assert sorted(r.value for r in good.collect()) == ["3.5", "NaN"] and good.count() + bad.count() == len(rows)
    assert quality.split_valid(df, quality.valid_transaction(finite_only=True))[0].count() == 1
    with pytest.raises(quality.DataContractError):
        quality.require_invalid_ratio_below(80, 20)
    with pytest.raises(quality.DataContractError):
        quality.require_invalid_ratio_below(0, 0)
    assert quality.require_invalid_ratio_below(95, 5) == 0.05
    with pytest.raises(quality.DataContractError):
        quality.require_columns(df, {"value", "missing"})
    with pytest.raises(quality.DataContractError):
        quality.require_non_empty(df.limit(0))
    assert quality.is_permission_error(Exception("Access DENIED")) and not quality.is_permission_error(Exception("no"))
    old = {"a": "int", "b": "double"}
    assert not quality.schema_diff(old, old | {"c": "int"})["is_breaking"]
    assert quality.schema_diff(old, {"a": "int"})["is_breaking"] and quality.schema_diff(old, {"a": "int", "b": "string"})["type_changed"] == ["b"]
    assert quality.schema_hash(old) == quality.schema_hash(dict(reversed(old.items())))


def test_rules(spark):
    rules = scoring.rule_table(spark)
    assert rules.count() == 18 and scoring.current_rules(rules) == scoring.DEFAULT_RULES
    new = spark.createDataFrame([("score_cap", 90.0)], "rule_key string, rule_value double")
    changed = scd2.change(rules, ["rule_key"], new, datetime.date(2026, 5, 1))
    scd2.require_one_current(changed, ["rule_key"])
    assert scoring.current_rules(changed)["score_cap"] == 90.0 and changed.count() == 19
    assert scd2.as_of(changed, datetime.date(2026, 4, 30)).where("rule_key = 'score_cap'").first().rule_value == 100.0
    assert scd2.as_of(changed, datetime.date(2026, 5, 1)).count() == 18
    with pytest.raises(quality.DataContractError):
        scoring.current_rules(rules.where("rule_key <> 'score_cap'"))
    with pytest.raises(quality.DataContractError):
        scoring.current_rules(rules.union(rules))
    assert scoring.pivot_rules(rules.limit(0)).count() == 1


def test_scores_are_explained(spark):
    from vigil.plans import tables as t

    sf = "/root/testdata/sf0.01"
    rows = t.profiles(spark, sf).collect()
    assert len(rows) == 1500
    for r in rows:
        assert r.composite_risk_score == min(100, sum(f.points for f in r.top_contributing_factors))
        assert r.score_band == ("high" if r.composite_risk_score >= 70 else "medium" if r.composite_risk_score >= 40 else "low")
    alerts = scoring.alert_queue(t.profiles(spark, sf), 40).collect()
    ordered = sorted(alerts, key=lambda r: r.priority_rank)
    assert all(a.composite_risk_score >= b.composite_risk_score for a, b in zip(ordered, ordered[1:], strict=False))
    scores = Counter(r.composite_risk_score for r in alerts)
    assert all(r.priority_rank == 1 + sum(n for s, n in scores.items() if s > r.composite_risk_score) for r in alerts)


def test_freshness():
    assert [ops.freshness_status(x) for x in (0, 900, 901, 2700, 2701, float("inf"))] == ["fresh", "fresh", "stale", "stale", "degraded", "degraded"]


def test_serving_without_a_publish(spark):
    control = spark.createDataFrame([], ops.CONTROL_SCHEMA)
    got = ops.serving_view(spark.createDataFrame([("a",)], "account_id string"), control, "p", F.current_timestamp()).collect()
    assert [(r.account_id, r.is_stale) for r in got] == [("a", True)]


def test_graph_counts_parallel_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("d", "a"), ("e", "e")], "src string, dst string")
    classes = spark.createDataFrame([("a", "unknown"), ("b", "1"), ("c", "2"), ("d", "unknown"), ("e", "1"), ("f", "2")], "node string, class string")
    got = {r.node: (r.out_degree, r.in_degree, r.illicit_neighbor_ratio) for r in graph.node_risk(classes, edges).collect()}
    assert got["a"] == (3, 1, 2 / 3) and got["e"] == (1, 1, 1.0) and got["f"] == (0, 0, None) and got["b"] == (0, 2, None)


def test_masks(spark):
    accounts = spark.createDataFrame([("1", "Ann", "1970-01-01")], "account_id string, synthetic_holder_name string, synthetic_dob string")
    masked = governance.mask_accounts(accounts, "analyst").first()
    assert masked.synthetic_holder_name.startswith("MASKED#") and len(masked.synthetic_holder_name) == 15 and masked.synthetic_dob is None
    assert governance.mask_accounts(accounts, "data_engineers").first().synthetic_holder_name == "Ann"
    alerts = spark.createDataFrame([("new",), ("suppressed",)], "status string")
    assert governance.visible_alerts(alerts, "analyst").count() == 1 and governance.visible_alerts(alerts, "analytics_engineers").count() == 2


def test_csv_sources(spark, tmp_path):
    (tmp_path / "sdn.csv").write_text('1,"SMITH, ""JON""\nJR",individual,-0- ,,,,,,,,"line\n2"\n2,B,-0- ,X,,,,,,,,\n\x1a\n')
    rows = readers.headerless_list(spark, f"file://{tmp_path}/sdn.csv", schemas.SDN)
    good, bad = quality.split_valid(rows, quality.digits("ent_num"))
    assert {r.ent_num: r.sdn_name for r in good.collect()} == {"1": 'SMITH, "JON"\nJR', "2": "B"} and bad.count() == 1
    (tmp_path / "f.csv").write_text("t1,5,0.5,1.5,2\n")
    assert readers.feature_vectors(spark, f"file://{tmp_path}/f.csv", 3).first().features == [0.5, 1.5, 2.0]
    (tmp_path / "n.csv").write_text("nodeid,isFraud,init_balance,fraudStep\n7,1,10.5,\n")
    assert tuple(readers.delimited(spark, f"file://{tmp_path}/n.csv", schemas.NODES).first()) == (7, 1, 10.5, None)
    stamped = readers.stamp(rows, readers.new_batch_id(), datetime.datetime(2026, 1, 1), "sdn.csv")
    assert entities.latest_batch(stamped).count() == 3


def test_table_store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "a long")
    assert store.overwrite(rows(1, 2), "t") == 1 and store.overwrite(rows(3), "t", cluster_by=("a",)) == 2
    assert sorted(r.a for r in store.read("t", 1).collect()) == [1, 2] and [r.a for r in store.read("t").collect()] == [3]
    store.append(rows(4), "t", token="q-1")
    store.append(rows(4), "t", token="q-1")
    assert store.read("t").count() == 2
    store.merge_new(rows(4, 5, 5, None), "t", ["a"])
    store.merge_new(rows(5, 6, None), "t", ["a"])
    assert sorted(map(repr, (r.a for r in store.read("t").collect()))) == ["3", "4", "5", "6", "None"]
    store.append(rows(7).withColumn("b", F.lit("x")), "t")
    assert set(store.read("t").columns) == {"a", "b"}

    def refuse(df):
        raise quality.DataContractError("no")

    before = store.versions("t")
    with pytest.raises(quality.DataContractError):
        store.overwrite(rows(0), "t", check=refuse)
    assert store.versions("t") == before and store.read("t").count() == 6
    assert store.append_if_any(rows().limit(0), "t") is None
    assert not store.seed(rows(9), "t") and store.seed(rows(9), "u")
    assert store.maintain(["t", "missing"]) == {"maintained": ["t"], "skipped": ["missing"]}
    n = store.read("t").count()
    assert store.vacuum("t", keep_hours=-1) > 0 and store.read("t").count() == n and len(store.versions("t")) == 1
    with pytest.raises(ValueError):
        store.read("t", 1)


def test_runner(tmp_path):
    assert runner.Environment("dev").table("gold", "x") == "risk_dev.gold.x"
    with pytest.raises(ValueError):
        runner.Environment("prod")
    assert runner.statements("-- note\nSELECT 1 FROM {catalog}.a;\n\nSELECT 2 FROM {{catalog}}.b;\n", {"catalog": "c"}) == ["SELECT 1 FROM c.a", "SELECT 2 FROM c.b"]
    done = runner.run_job(runner.JOBS["month_end"], {k: (lambda: None) for k in runner.JOBS["month_end"]})
    assert all(done.index(x) < done.index(k) for k, needs in runner.JOBS["month_end"].items() for x in needs)
    assert runner.upstream(str(tmp_path / "none.json"), "p")["owner"] == "unassigned"
    assert '"event": "e"' in runner.log_event("e", n=1)


def test_fields_of_a_schema():
    from vigil.operators.drift import fields_of

    text = "OBJECT<a: VARIANT, b: OBJECT<c: DECIMAL(21,1), `d e`: ARRAY<ARRAY<BIGINT>>>, e: OBJECT<>, f: ARRAY<OBJECT<g: TIMESTAMP_NTZ, h: BOOLEAN>>, `z<,``k`: VOID>"
    assert fields_of(text) == [("a", "VARIANT"), ("b.c", "DECIMAL"), ("b.d e[][]", "BIGINT"), ("e", "OBJECT"), ("f[].g", "TIMESTAMP_NTZ"), ("f[].h", "BOOLEAN"), ("z<,`k", "VOID")]
    assert fields_of("ARRAY<BIGINT>") == [("[]", "BIGINT")] and fields_of("STRING") == [("$", "STRING")] and fields_of("OBJECT<OBJECT: OBJECT<x: INT>>") == [("OBJECT.x", "INT")]


def test_drift_inside_values(spark):
    from pyspark.sql import functions as F
    from vigil.operators import drift

    days = [
        ("x", 1, '{"a": 1, "b": {"c": "t"}, "n": null}'), ("x", 1, None), ("x", 2, '{"a": 2.5, "b": {"c": 3}, "n": 4}'), ("x", 2, '{"a": "t", "b": {"c": "t"}}'),
        ("x", 5, "{"), ("x", 5, '{"a": "t", "new": []}'), ("x", 6, '{"a": "t", "new": [1]}'), ("y", 1, '{"q": 1}'), ("y", 2, '{"q": 7}'), ("z", 1, "{"), ("z", 2, "[1]"), ("z", None, None),
    ]
    df = spark.createDataFrame(days, "source string, day int, body string")
    got = {tuple(r) for r in drift.drift_within(df, "body", F.col("day"), ("source",)).collect()}
    assert got == {
        ("x", 2, "a", "type_changed", "BIGINT", "VARIANT", True), ("x", 2, "b.c", "type_changed", "STRING", "VARIANT", True), ("x", 5, "b.c", "removed", "VARIANT", None, True),
        ("x", 5, "a", "type_changed", "VARIANT", "STRING", True), ("x", 5, "n", "removed", "BIGINT", None, True), ("x", 5, "new[]", "added", None, "VOID", False), ("x", 5, "$", "added", None, "MALFORMED", True),
        ("x", 6, "$", "removed", "MALFORMED", None, False), ("z", 2, "$", "removed", "MALFORMED", None, False), ("z", 2, "[]", "added", None, "BIGINT", False),
    }
    assert drift.drift_within(df.where("false"), "body", F.col("day")).count() == 0
