"""Every query of the engine by name, and the SQL that an independent database must agree with."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions import text
from vigil.functions.clock import step_to_time
from vigil.operators import drift, entities, features, governance, graph, identity, matching, ops, quality, scd2, scoring, serving
from vigil.plans import jobs
from vigil.plans import oracle as o
from vigil.plans import tables as t
from vigil.session import written
from vigil.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LAST_DAY = datetime.datetime(2024, 2, 1)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- sources, sinks and validity -------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def src_latest_batch(spark, d):
    e = t.table(spark, d, "events").withColumn("_batch_id", F.date_format("ts", "yyyyMMdd"))
    return entities.latest_batch(e).select("event_id", "user_id", "event_type", "value")


@query("SELECT * FROM (VALUES ('ofac', 'individual', 'person'), ('ofac', 'vessel', 'vessel'), ('ofac', 'aircraft', 'aircraft'), ('ofac', '', 'organization'), ('opensanctions', 'Person', 'person'), ('opensanctions', 'Organization', 'organization'), ('opensanctions', 'Vessel', 'vessel'), ('opensanctions', 'Airplane', 'aircraft')) v(source_system, source_value, unified_value)")
def src_values(spark, d):
    return entities.type_map(spark).select("source_system", "source_value", "unified_value")


@query("SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dims, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def src_array_features(spark, d):
    e = t.table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.size("embedding").alias("dims"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query(o.with_(o.RAW, o.VALID, select="SELECT good AS is_valid, COUNT(*) AS n FROM checked GROUP BY good"))
def flt_valid_split(spark, d):
    rows = t.raw_rows(spark, d)
    good, bad = quality.split_valid(rows, quality.valid_transaction())
    return good.select(F.lit(True).alias("is_valid")).union(bad.select(F.lit(False))).groupBy("is_valid").agg(F.count("*").alias("n"))


@query(o.with_(o.RAW, o.VALID, select="SELECT event_id, src AS \"sourceNodeId\", dst AS \"targetNodeId\", value, step AS time, CASE WHEN NOT COALESCE(regexp_matches(src, '^\\d+$'), false) THEN 'bad_source' WHEN NOT COALESCE(regexp_matches(dst, '^\\d+$'), false) THEN 'missing_target' WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN 'bad_value' ELSE 'bad_time' END AS _error_reason FROM checked WHERE NOT good"))
def flt_dead_letter(spark, d):
    return quality.split_valid(t.raw_rows(spark, d), quality.valid_transaction(), quality.transaction_error())[1]


@query(o.with_(o.RAW, o.VALID, select="SELECT CASE WHEN dst IS NULL THEN 'missing_target' WHEN value = 'not_a_number' THEN 'bad_value' ELSE 'bad_time' END AS reason, COUNT(*) AS n FROM checked WHERE NOT good GROUP BY 1"))
def flt_reason_counts(spark, d):
    return flt_dead_letter(spark, d).groupBy(F.col("_error_reason").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT 'digits' AS rule, COUNT(CASE WHEN NOT regexp_matches(json_extract_string(props, '$.k'), '^\\d+$') THEN 1 END) AS invalid FROM events UNION ALL SELECT 'blank', COUNT(CASE WHEN trim(event_type) = '' OR event_type IS NULL THEN 1 END) FROM events UNION ALL SELECT 'null', COUNT(CASE WHEN value IS NULL THEN 1 END) FROM events")
def flt_key_rules(spark, d):
    e = t.table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k"), "event_type", "value")
    bad = lambda v: F.count_if(~F.coalesce(v, F.lit(False)))
    one = e.agg(bad(quality.digits("k")).alias("digits"), bad(quality.not_blank("event_type")).alias("blank"), bad(quality.not_null("value")).alias("null"))
    return one.unpivot([], ["digits", "blank", "null"], "rule", "invalid")


@query(o.with_(o.RAW, o.VALID, select="SELECT DISTINCT CAST(src AS INTEGER) AS \"sourceNodeId\", CAST(dst AS INTEGER) AS \"targetNodeId\", CAST(value AS DOUBLE) AS value, CAST(step AS INTEGER) AS time FROM checked WHERE good"))
def snk_idempotent_merge(spark, d):
    """The same batch merged twice into a table, read back."""
    store = _store(spark)
    rows = t.raw_rows(spark, d).where(quality.valid_transaction()).select(F.expr("CAST(sourceNodeId AS INT)").alias("sourceNodeId"), F.expr("CAST(targetNodeId AS INT)").alias("targetNodeId"), F.expr("CAST(value AS DOUBLE)").alias("value"), F.expr("CAST(time AS INT)").alias("time"))
    for _ in range(2):
        store.merge_new(rows, "txn", ["sourceNodeId", "targetNodeId", "value", "time"])
    return store.read("txn")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def snk_snapshot_version_read(spark, d):
    """Version 1 of a table, read after a second version replaced it."""
    store, rows = _store(spark), t.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    store.overwrite(rows.where("o_orderstatus = 'O'"), "orders", cluster_by=("o_orderkey",))
    store.overwrite(rows.where("o_orderstatus <> 'O'"), "orders")
    return store.read("orders", 1)


@query()
def snk_clustered_layout(spark, d):
    """Files that a range filter on either of two columns touches, of a table sorted by one and one clustered by both."""
    rows = t.table(spark, d, "lineitem").select("l_partkey", F.unix_date(F.to_date("l_shipdate")).alias("l_shipday"), "l_quantity")
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("l_partkey", "l_shipday") for n, f in (("low", F.min), ("high", F.max))]).first()
    out = None
    for layout, together in (("sorted", False), ("clustered", True)):
        store = _store(spark)
        store.overwrite(rows, "lines", cluster_by=("l_partkey", "l_shipday"), together=together, files=64)
        files = store.read("lines").groupBy(F.col("_metadata.file_path").alias("file")).agg(*[f(c).alias(f"{n}_{c}") for c in ("l_partkey", "l_shipday") for n, f in (("low", F.min), ("high", F.max))])
        for c in ("l_partkey", "l_shipday"):
            low, high = ends[f"low_{c}"], ends[f"high_{c}"]
            a, b = low + (high - low) * 0.45, low + (high - low) * 0.5
            one = files.agg(F.count_if((F.col(f"low_{c}") <= b) & (F.col(f"high_{c}") >= a)).alias("touched"), F.count("*").alias("files")).select(F.lit(layout).alias("layout"), F.lit(c).alias("filtered"), "touched", "files")
            out = one if out is None else out.union(one)
    return out


@query("SELECT n_nationkey, n_name FROM nation")
def snk_seed_when_empty(spark, d):
    store, rows = _store(spark), t.table(spark, d, "nation").select("n_nationkey", "n_name")
    store.seed(rows, "nation")
    store.seed(rows, "nation")
    store.compact("nation")
    return store.read("nation")


def _store(spark):
    from vigil.session import shared_folder
    from vigil.sources.store import TableStore

    return TableStore(spark, shared_folder(spark))


def _csv(spark, rows: DataFrame, header: bool, **options) -> str:
    """rows as a CSV folder in the shared place, quotes doubled."""
    path = f"{_store(spark).root}/csv"
    rows.write.options(header=header, quote='"', escape='"', **options).csv(path)
    return path


@query("SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def src_csv_headered(spark, d):
    rows = t.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")
    return readers.delimited(spark, _csv(spark, rows, True), "o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate DATE, o_orderpriority STRING")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def src_csv_multiline_headerless(spark, d):
    """Whole texts, with their line breaks and quotes, through files without a header, which are read in byte ranges."""
    rows = t.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    return readers.headerless_list(spark, _csv(spark, rows, False), "doc_id STRING, text STRING, lang STRING")


_HOT = "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END"


@query(f"""WITH f AS (SELECT o_orderkey, {_HOT} AS k, CAST(o_orderdate AS DATE) AS d, o_orderpriority, o_orderstatus FROM orders),
v AS (SELECT k, d + 1 AS since, arg_max(o_orderpriority, o_orderkey) AS rule FROM f WHERE o_orderstatus = 'F' GROUP BY k, d)
SELECT o_orderkey, f.k AS customer, rule, since AS valid_from FROM f ASOF LEFT JOIN v ON f.k = v.k AND f.d >= v.since""")
def scd2_as_of_join(spark, d):
    """Each order with the version of its customer's rule that is valid on its day; one customer has a third of all orders.

    A finished order sets its customer's rule (its priority) from the next day on.
    """
    rows = t.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("customer"), F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_orderstatus")
    rules = rows.where("o_orderstatus = 'F'").groupBy("customer", F.date_add("day", 1).alias("valid_from")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("rule"))
    return scd2.as_of_join(rows.select("o_orderkey", "customer", "day"), rules, ["customer"], "day").drop("day")


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def src_csv_strings(spark, d):
    """Nothing is inferred: every column is read as a string."""
    rows = t.table(spark, d, "events").select("user_id", "event_id", "event_type", F.to_date("ts").alias("day"))
    return readers.delimited(spark, _csv(spark, rows, True), "user_id STRING, event_id STRING, event_type STRING, day STRING")


@query("SELECT CAST(p_partkey AS VARCHAR) AS \"txId\", CAST(p_partkey % 49 AS INTEGER) AS time_step, CAST(p_size + p_size / 2.0 + p_size / 4.0 AS DOUBLE) AS total, 3 AS n FROM part")
def src_csv_features(spark, d):
    """Wide rows without a header, read into one array."""
    rows = t.table(spark, d, "part").select("p_partkey", F.col("p_partkey") % 49, F.col("p_size").cast("double"), F.col("p_size") / 2, F.col("p_size") / 4)
    got = readers.feature_vectors(spark, _csv(spark, rows, False), 3)
    return got.select("txId", "time_step", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("features").alias("n"))


@query("SELECT * FROM (VALUES ('nation', 1, '[]', '[]', '[]', false), ('nation', 2, '[\"n_extra\"]', '[]', '[]', false), ('nation', 3, '[]', '[\"n_extra\"]', '[\"n_nationkey\"]', true)) x (table_name, n, added, removed, type_changed, is_breaking)")
def ops_drift_history(spark, d):
    """Three observations of a table whose schema grows, then breaks; the last is kept though it raises."""
    store, rows = _store(spark), t.table(spark, d, "nation").select("n_nationkey", "n_name")
    grown = rows.withColumn("n_extra", F.lit(1))
    broken = rows.withColumn("n_nationkey", F.col("n_nationkey").cast("string"))
    for k, frame in enumerate((rows, grown, broken), 1):
        try:
            ops.observe_schema(store, "pipeline", "nation", frame.schema, LAST_DAY + datetime.timedelta(hours=k))
        except quality.DataContractError:
            if k < 3:
                raise
    history = store.read("ops_schema_drift")
    part = lambda name: F.get_json_object("drift_json", f"$.{name}")
    n = F.row_number().over(Window.partitionBy("table_name").orderBy("observed_at"))
    return history.select("table_name", n.alias("n"), *[part(c).alias(c) for c in ("added", "removed", "type_changed")], "is_breaking")


# --- entities, transactions and the graph -----------------------------------------------------------------------------


def _entities(spark, d):
    return entities.unify(t.sdn(spark, d), t.targets(spark, d), entities.type_map(spark))


@query(o.with_(o.SDN, o.TARGETS, o.ENTITIES, select="SELECT * FROM ent"))
def ent_unify(spark, d):
    return _entities(spark, d).withColumn("countries", F.array_join("countries", ",")).drop("is_watchlist")


@query(o.with_(o.SDN, o.TARGETS, o.ENTITIES, select="SELECT source_system, entity_type, COUNT(*) AS n FROM ent GROUP BY 1, 2"))
def ent_type_lookup(spark, d):
    return _entities(spark, d).groupBy("source_system", "entity_type").agg(F.count("*").alias("n"))


@query("SELECT sha256((CASE WHEN s_suppkey % 2 = 0 THEN 'opensanctions_sanctions' ELSE 'opensanctions_peps' END) || ':' || CAST(s_suppkey AS VARCHAR)) AS entity_id, unnest([s_name, 'AKA-' || CAST(s_suppkey AS VARCHAR) || ' x!']) AS alias_name, unnest([trim(regexp_replace(regexp_replace(upper(s_name), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), 'AKA ' || CAST(s_suppkey AS VARCHAR) || ' X']) AS alias_normalized FROM supplier")
def ent_alias_explode(spark, d):
    x = t.targets(spark, d)
    return entities.aliases(x.select(F.sha2(F.concat("source_system", F.lit(":"), "id"), 256).alias("entity_id"), "aliases"))


@query("SELECT 'p' || CAST(p_partkey AS VARCHAR) AS entity_id, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_type END AS address_line, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS city, 'XX' AS country FROM part WHERE NOT (p_size % 2 = 0 AND p_size % 3 = 0) UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), unnest([s_name, 'Box ' || CAST(s_suppkey AS VARCHAR)]), NULL, NULL FROM supplier")
def ent_address_explode(spark, d):
    p, s = t.table(spark, d, "part"), t.table(spark, d, "supplier")
    one = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.when(F.col("p_size") % 2 == 0, "-0- ").otherwise(F.col("p_type")).alias("address_line"), F.when(F.col("p_size") % 3 == 0, "-0-").otherwise(F.col("p_brand")).alias("city"), F.lit("XX").alias("country"))
    two = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.concat("s_name", F.lit(";; Box "), F.col("s_suppkey").cast("string")).alias("addresses"))
    return entities.addresses(one, two)


@query(o.with_(o.TXN, select="SELECT DISTINCT sha256(concat_ws('|', source_account_id, target_account_id, printf('%.4f', amount), strftime(event_time, '%Y-%m-%d %H:%M:%S.%f'))) AS transaction_id, source_account_id, target_account_id, amount, 'USD' AS currency, event_time, event_date FROM txn"))
def txn_standardize(spark, d):
    return entities.standardize_transactions(t.transactions(spark, d))


@query("SELECT CAST(event_id % 1000 AS INTEGER) AS step, COUNT(*) AS n, CAST(epoch(max(TIMESTAMP '2026-01-01' + to_hours(CAST(event_id % 1000 AS INTEGER)))) AS BIGINT) AS at FROM events GROUP BY 1")
def txn_clock(spark, d):
    e = t.table(spark, d, "events").select((F.col("event_id") % 1000).cast("int").alias("step"))
    return e.groupBy("step").agg(F.count("*").alias("n"), F.unix_timestamp(F.max(step_to_time(F.col("step")))).alias("at"))


@query(o.with_(o.EDGES, o.DEGREES, select="SELECT * FROM deg"))
def graph_degree(spark, d):
    return graph.degrees(t.edges(spark, d))


@query(o.with_(o.EDGES, o.CLASSES, o.RATIO, select="SELECT node, round(r, 6) AS illicit_neighbor_ratio FROM ratio"))
def graph_illicit_ratio(spark, d):
    return graph.illicit_ratio(t.edges(spark, d), t.classes(spark, d)).withColumn("illicit_neighbor_ratio", F.round("illicit_neighbor_ratio", 6))


@query(o.with_(o.EDGES, o.CLASSES, o.RATIO, o.DEGREES, select="SELECT cl.node, class, COALESCE(out_degree, 0) AS out_degree, COALESCE(in_degree, 0) AS in_degree, round(r, 6) AS illicit_neighbor_ratio FROM cl LEFT JOIN deg ON deg.node = cl.node LEFT JOIN ratio ON ratio.node = cl.node"))
def graph_node_risk(spark, d):
    return graph.node_risk(t.classes(spark, d), t.edges(spark, d)).withColumn("illicit_neighbor_ratio", F.round("illicit_neighbor_ratio", 6))


@query()
def graph_network_bridge(spark, d):
    return graph.network_reference(t.accounts(spark, d), graph.illicit_ratio(t.edges(spark, d), t.classes(spark, d)))


# --- behaviour and scores ---------------------------------------------------------------------------------------------


@query(o.with_(*o.BEHAVIOUR, select="SELECT account_id, velocity_1d, velocity_7d, velocity_30d FROM act WHERE velocity_30d > 0"))
def feat_velocity(spark, d):
    x = t.transactions(spark, d)
    return features.activity(x, features.as_of_date(x)).select("account_id", "velocity_1d", "velocity_7d", "velocity_30d")


_DAYS = """p AS (SELECT source_account_id AS a, event_date AS d FROM txn UNION ALL SELECT target_account_id, event_date FROM txn),
n AS (SELECT a, d, COUNT(*) AS n FROM p WHERE a IS NOT NULL GROUP BY 1, 2), s AS (SELECT DISTINCT a, d + CAST(i AS INTEGER) AS day FROM n, unnest(range(31)) u(i) WHERE d + CAST(i AS INTEGER) <= (SELECT max(event_date) FROM txn))"""
_BACK = ", ".join(f"CAST(SUM(CASE WHEN n.d >= s.day - {k} THEN n ELSE 0 END) AS BIGINT) AS velocity_{k}d" for k in (1, 7, 30))


@query(o.with_(o.TXN, _DAYS, select=f"SELECT s.a AS account_id, s.day AS as_of_date, {_BACK} FROM s JOIN n ON n.a = s.a AND n.d BETWEEN s.day - 30 AND s.day GROUP BY 1, 2"))
def feat_velocity_all_days(spark, d):
    """Velocity as it was on every day, in one pass."""
    return features.velocity_by_day(t.transactions(spark, d))


@query(o.with_(*o.BEHAVIOUR, select="SELECT account_id, velocity_1d, velocity_7d, velocity_30d FROM act WHERE velocity_30d > 0"))
def feat_velocity_as_of(spark, d):
    """The as-of day's velocity as a filter of all days'."""
    x = t.transactions(spark, d)
    return features.velocity_by_day(x).where(F.col("as_of_date") == F.lit(features.as_of_date(x))).drop("as_of_date")


@query()
def feat_diversity_sketched(spark, d):
    """Distinct counterparties of 30 days from sketches kept by day, beside the exact count and the relative error."""
    x = t.transactions(spark, d)
    day = features.as_of_date(x)
    both = features.diversity_of(features.diversity_sketches(x), day).join(features.diversity(x, day), "account_id")
    exact = F.col("counterparty_diversity_30d")
    return both.withColumn("error", F.round(F.abs(F.col("counterparty_estimate_30d") - exact) / exact, 6))


@query(o.with_(*o.BEHAVIOUR, select="SELECT account_id, counterparty_diversity_30d FROM act WHERE counterparty_diversity_30d > 0"))
def feat_diversity(spark, d):
    x = t.transactions(spark, d)
    return features.diversity(x, features.as_of_date(x))


@query(o.with_(*o.BEHAVIOUR, select="SELECT account_id, round_dollar_count_30d, round(round_dollar_count_30d / velocity_30d, 6) AS round_dollar_ratio FROM act WHERE velocity_30d > 0"))
def feat_round_ratio(spark, d):
    x = t.transactions(spark, d)
    return features.activity(x, features.as_of_date(x)).select("account_id", "round_dollar_count_30d", F.round(F.col("round_dollar_count_30d") / F.col("velocity_30d"), 6).alias("round_dollar_ratio"))


@query(o.with_(*o.BEHAVIOUR, select="SELECT account_id, max_daily_count, round(avg_daily_count, 6) AS avg_daily_count, max_daily_count > 3 * avg_daily_count AS burst_flag FROM burst"))
def feat_burst(spark, d):
    x = t.transactions(spark, d)
    a = features.activity(x, features.as_of_date(x))
    return a.select("account_id", "max_daily_count", F.round("avg_daily_count", 6).alias("avg_daily_count"), (F.col("max_daily_count") > 3 * F.col("avg_daily_count")).alias("burst_flag"))


@query(o.with_(o.TXN, o.BOTH, o.MATCHES, o.EXPOSURE, select="SELECT account_id FROM expo"))
def feat_counterparty_exposure(spark, d):
    return features.exposure(t.transactions(spark, d), t.matches(spark, d))


@query("SELECT " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in scoring.DEFAULT_RULES.items()))
def score_rule_pivot(spark, d):
    return scoring.pivot_rules(scoring.rule_table(spark))


_POINTS = "pts_watchlist pts_velocity pts_diversity pts_round_dollar pts_burst pts_risky_counterparty pts_network_risk".split()


@query(o.with_(*o.SCORED, select="SELECT account_id, " + ", ".join(f"CAST({p} AS INTEGER) AS {p}" for p in _POINTS) + " FROM banded"))
def score_points(spark, d):
    return t.profiles(spark, d).select("account_id", *_POINTS)


_PROFILE = "account_id, as_of_date, velocity_1d, velocity_7d, velocity_30d, counterparty_diversity_30d, burst_flag, risky_counterparty_exposure, network_risk_exposure, CAST(best_band_rank AS INTEGER) AS best_band_rank, watchlist_match_count, composite_risk_score, score_band"


def _profile(df):
    return df.select(*[c.split(" AS ")[-1] for c in _PROFILE.replace("CAST(best_band_rank AS INTEGER) AS ", "").split(", ")], F.round("round_dollar_ratio", 6).alias("round_dollar_ratio"))


@query(o.with_(*o.SCORED, select=f"SELECT {_PROFILE}, round(round_dollar_ratio, 6) AS round_dollar_ratio FROM banded"))
def score_composite(spark, d):
    return _profile(t.profiles(spark, d))


@query(o.with_(*o.SCORED_DEFAULT, select=f"SELECT {_PROFILE}, round(round_dollar_ratio, 6) AS round_dollar_ratio FROM banded"))
def score_composite_default_rules(spark, d):
    return _profile(t.profiles(spark, d, scoring.current_rules(scoring.rule_table(spark))))


@query(o.with_(*o.SCORED, select="SELECT score_band, COUNT(*) AS cnt FROM banded GROUP BY 1"))
def score_band(spark, d):
    return t.profiles(spark, d).groupBy("score_band").agg(F.count("*").alias("cnt"))


_FACTORS = (
    ("pts_watchlist", "watchlist_match", "CASE best_band_rank WHEN 3 THEN 'exact' WHEN 2 THEN 'strong' ELSE 'weak' END"),
    ("pts_velocity", "high_velocity_7d", "CAST(velocity_7d AS VARCHAR)"),
    ("pts_diversity", "high_counterparty_diversity_30d", "CAST(counterparty_diversity_30d AS VARCHAR)"),
    ("pts_round_dollar", "high_round_dollar_ratio_30d", "printf('%.2f', round(round_dollar_ratio, 2))"),
    ("pts_burst", "burst_activity", "'flagged'"),
    ("pts_risky_counterparty", "risky_counterparty_exposure", "'flagged'"),
    ("pts_network_risk", "elliptic_network_risk_exposure", "printf('%.2f', round(network_risk_exposure, 2))"),
)


@query(o.with_(*o.SCORED, select=" UNION ALL ".join(f"SELECT account_id, '{name}' AS factor, {band} AS band, CAST({p} AS INTEGER) AS points FROM banded WHERE {p} > 0" for p, name, band in _FACTORS)))
def score_factors_flat(spark, d):
    return t.profiles(spark, d).select("account_id", F.explode("top_contributing_factors").alias("f")).select("account_id", "f.*")


def _alerts(spark, d, day=None):
    return scoring.alert_queue(t.profiles(spark, d, day=day), t.STAND_IN_RULES["alert_min_score"])


@query(o.with_(*o.SCORED, select="SELECT * FROM alerts"))
def alert_queue(spark, d):
    return _alerts(spark, d)


@query(o.with_(*o.SCORED, select="SELECT priority_rank, MIN(composite_risk_score) AS score, COUNT(*) AS n FROM alerts GROUP BY 1"))
def alert_rank(spark, d):
    return _alerts(spark, d).groupBy("priority_rank").agg(F.min("composite_risk_score").alias("score"), F.count("*").alias("n"))


@query(o.with_(*o.SCORED, select="SELECT escalation_reason, COUNT(*) AS n FROM alerts GROUP BY 1"))
def alert_reason_counts(spark, d):
    return _alerts(spark, d).groupBy("escalation_reason").agg(F.count("*").alias("n"))


@query(o.with_(*o.SCORED, select="SELECT account_id, alert_id FROM alerts"))
def alert_id_hash(spark, d):
    return _alerts(spark, d).select("account_id", "alert_id")


@query(o.with_(o.MATCHES, o.SUMMARY, select="SELECT account_id, CAST(best_band_rank AS INTEGER) AS best_band_rank, watchlist_match_count FROM ws"))
def watch_summary_by_account(spark, d):
    return scoring.watchlist_summary(t.matches(spark, d))


_SUMMARY = o.with_(o.SDN, o.TARGETS, o.ENTITIES, o.MATCHES, """wm AS (SELECT m.entity_id AS watchlist_entity_id, COUNT(DISTINCT account_id) AS matched_account_count,
  MAX(CASE match_confidence_band WHEN 'exact' THEN 3 WHEN 'strong' THEN 2 ELSE 1 END) AS k FROM mt m GROUP BY 1)""", "wsum AS (SELECT watchlist_entity_id, matched_account_count, CASE k WHEN 3 THEN 'exact' WHEN 2 THEN 'strong' ELSE 'weak' END AS highest_confidence_band, entity_type AS risk_type FROM wm JOIN ent ON ent.entity_id = watchlist_entity_id)", select="SELECT {} FROM wsum{}")  # fmt: skip


def _summary(spark, d):
    return scoring.match_summary(t.matches(spark, d), _entities(spark, d)).drop("jurisdictions")


@query(_SUMMARY.format("*", ""))
def watch_summary_by_entity(spark, d):
    return _summary(spark, d)


# --- rules with history -----------------------------------------------------------------------------------------------

_CHANGED = "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in scoring.DEFAULT_RULES.items()) + ") v(rule_key, rule_value)), h AS (SELECT rule_key, rule_value, DATE '2026-01-01' AS valid_from, CASE WHEN rule_key = 'thr_velocity_7d' THEN DATE '2026-03-01' END AS valid_to, rule_key <> 'thr_velocity_7d' AS is_current FROM r UNION ALL SELECT 'thr_velocity_7d', 25.0, DATE '2026-03-01', NULL, true) SELECT {} FROM h{}"


def _changed(spark):
    new = spark.createDataFrame([("thr_velocity_7d", 25.0)], "rule_key string, rule_value double")
    return scd2.change(scoring.rule_table(spark), ["rule_key"], new, datetime.date(2026, 3, 1))


@query(_CHANGED.format("*", ""))
def scd2_change(spark, d):
    return _changed(spark)


@query(_CHANGED.format("rule_key, rule_value", " WHERE valid_from <= DATE '2026-02-15' AND (valid_to IS NULL OR DATE '2026-02-15' < valid_to)"))
def scd2_as_of(spark, d):
    return scd2.as_of(_changed(spark), datetime.date(2026, 2, 15)).select("rule_key", "rule_value")


@query(_CHANGED.format("rule_key, COUNT(*) AS versions, COUNT(CASE WHEN is_current THEN 1 END) AS current_versions", " GROUP BY 1"))
def scd2_history(spark, d):
    return _changed(spark).groupBy("rule_key").agg(F.count("*").alias("versions"), F.count_if("is_current").alias("current_versions"))


# --- names and matching -----------------------------------------------------------------------------------------------

_NAMES = "n AS (SELECT p_name AS name, 'e' || CAST(min(p_partkey) AS VARCHAR) AS entity_id FROM part GROUP BY 1)"


def _watchlist(spark, d):
    p = t.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    return p.select(F.concat(F.lit("e"), F.col("k").cast("string")).alias("entity_id"), "name", F.lit(None).cast("array<string>").alias("aliases"), F.when(F.col("k") % 2 == 0, "CU").alias("country"), F.lit("01 Jan 1970").alias("dob"))


@query(o.with_(_NAMES, select="SELECT CAST(p_partkey AS VARCHAR) AS candidate_id, entity_id, CAST(100.0 AS DOUBLE) AS match_score FROM part JOIN n ON n.name = p_name"))
def match_exact(spark, d):
    p = t.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("candidate_id"), text.ascii_name(F.col("p_name")).alias("n"))
    w = _watchlist(spark, d).select("entity_id", text.ascii_name(F.col("name")).alias("n"))
    return p.join(w, "n").select("candidate_id", "entity_id", F.lit(100.0).alias("match_score"))


def _levenshtein(a, b):
    return F.round(100 - 100 * F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)), 4)


_LEV = o.with_(_NAMES, "u AS (SELECT DISTINCT upper(name) AS x FROM n)", "s AS (SELECT a.x AS a, b.x AS b, round(100 - 100 * levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x)), 4) AS score FROM u a JOIN u b ON substr(a.x, 1, 1) = substr(b.x, 1, 1))", select="{}")


@query(_LEV.format("SELECT a, b, score FROM s WHERE score >= 60"))
def match_levenshtein_blocked(spark, d):
    names = _watchlist(spark, d).select(text.ascii_name(F.col("name")).alias("text"))
    return matching.similar_names(names, names, 60.0, scorer=_levenshtein)


_LEV_WHOLE = o.with_("n AS (SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer)", "u AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(upper(name), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS x FROM n)", "s AS (SELECT a.x AS a, b.x AS b, round(100 - 100 * levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x)), 4) AS score FROM u a CROSS JOIN u b)", select="{}")


@query(_LEV_WHOLE.format("SELECT a AS candidate_id, b AS entity_id, score AS match_score, CAST(k AS INTEGER) AS match_rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE score >= 50) x WHERE k <= 5"))
def match_top_n(spark, d):
    """Every name of parts, suppliers and customers is ranked against the entire list, without blocks."""
    return _top_names(spark, d)[0]


def _top_names(spark, d):
    names = _all_names(spark, d)
    best, scored = matching.top_similar(names, names, 5, 50.0)
    return best.select(F.col("a").alias("candidate_id"), F.col("b").alias("entity_id"), F.col("score").alias("match_score"), "match_rank"), scored


def _all_names(spark, d):
    columns = (("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"))
    one, two, three = (t.table(spark, d, name).select(text.ascii_name(F.col(c)).alias("text")) for name, c in columns)
    return one.union(two).union(three).distinct()


@query()
def match_top_n_cost(spark, d):
    """How many pairs were compared for the five best of each name, of how many."""
    best, scored = _top_names(spark, d)
    return best.agg(F.count_distinct("candidate_id").alias("names")).crossJoin(_all_names(spark, d).agg((F.count("*") * F.count("*")).alias("pairs"))).withColumn("scored", F.lit(scored))


def _people(spark, d):
    w = _watchlist(spark, d)
    return identity.assign(t.accounts(spark, d), w, 0.10), w


@query()
def match_wratio_blocked(spark, d):
    """Account holders (some of them near misses of the list) screened by weighted similarity."""
    people, w = _people(spark, d)
    return matching.screen(people.select(F.col("account_id").alias("candidate_id"), F.col("synthetic_holder_name").alias("name"), F.col("synthetic_country").alias("country"), F.col("synthetic_dob").alias("dob")), w)


def _screened_profiles(spark, d):
    accounts = t.accounts(spark, d)
    found = written(jobs.screened(accounts, _watchlist(spark, d), 0.10))  # scores and exposure both take it
    network = graph.network_reference(accounts, graph.node_risk(t.classes(spark, d), t.edges(spark, d)))
    return scoring.profile(accounts, t.transactions(spark, d), found, network, t.STAND_IN_RULES)


@query()
def alert_queue_screened(spark, d):
    """The whole chain: identities, screening, graph risk, features, scores, queue; nothing stands in for a step."""
    return scoring.alert_queue(_screened_profiles(spark, d), t.STAND_IN_RULES["alert_min_score"])


@query()
def match_recall(spark, d):
    people, _ = _people(spark, d)
    seeded = people.where("is_seeded_collision").select(F.col("account_id").alias("candidate_id"), F.col("seeded_from_entity_id").alias("entity_id"))
    return matching.recall(seeded, match_wratio_blocked(spark, d))


@query()
def identity_assign(spark, d):
    return _people(spark, d)[0]


@query()
def identity_seed_rate(spark, d):
    return _people(spark, d)[0].groupBy("is_seeded_collision").agg(F.count("*").alias("n"))


@query("SELECT doc_id, trim(regexp_replace(upper(strip_accents(replace(text, 'ß', 'ss'))), '[^A-Z0-9_]+', ' ', 'g')) AS name FROM documents")
def text_normalize_name(spark, d):
    return t.table(spark, d, "documents").select("doc_id", text.normalized_name(F.col("text")).alias("name"))


@query("SELECT s_suppkey, upper(s_name) AS core FROM supplier")
def text_strip_suffix(spark, d):
    s = t.table(spark, d, "supplier")
    forms = F.get(F.array(*[F.lit(x) for x in (" LLC", " Ltd.", " GMBH", "")]), (F.col("s_suppkey") % 4).cast("int"))
    return s.select("s_suppkey", text.strip_legal_suffixes(F.upper(F.concat("s_name", forms))).alias("core"))


@query("SELECT n_nationkey, CASE upper(n_name) WHEN 'RUSSIA' THEN 'RU' WHEN 'CHINA' THEN 'CN' WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' WHEN 'JAPAN' THEN 'JP' WHEN 'IRAN' THEN 'IR' WHEN 'UNITED STATES' THEN 'US' WHEN 'UNITED KINGDOM' THEN 'GB' ELSE upper(n_name) END AS country FROM nation")
def text_country(spark, d):
    return t.table(spark, d, "nation").select("n_nationkey", text.normalize_country(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).alias("country"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m') END AS dob FROM orders")
def text_dob(spark, d):
    orders = t.table(spark, d, "orders")
    k, f = F.col("o_orderkey") % 5, lambda p: F.date_format("o_orderdate", p)
    raw = F.when(k == 0, f("dd MMM yyyy")).when(k == 1, f("MM/dd/yyyy")).when(k == 2, f("yyyy")).when(k == 3, f("yyyy-MM")).otherwise("circa 1970s")
    return orders.select("o_orderkey", text.normalize_dob(raw).alias("dob"))


# --- streaming, in its final state ------------------------------------------------------------------------------------


def _streamed(spark, d, twice: bool = False, within: str | None = None, keep_late: bool = True):
    from vigil.sources.store import TableStore
    from vigil.streaming import ingest

    store = _store(spark)
    raw = t.raw_rows(spark, d).select(*ingest.KEYS)
    ingest.feed(raw, f"{store.root}/in", 4000)
    for k in range(2 if twice else 1):
        if k:
            ingest.feed(raw, f"{store.root}/in", 4000)
        ingest.run(spark, f"{store.root}/in", store, f"{store.root}/checkpoint", within=within, keep_late=keep_late)
    return TableStore(spark, store.root)


_FINAL = "SELECT DISTINCT CAST(src AS INTEGER) AS \"sourceNodeId\", CAST(dst AS INTEGER) AS \"targetNodeId\", CAST(value AS DOUBLE) AS value, CAST(step AS INTEGER) AS time FROM checked WHERE good"


@query(o.with_(o.RAW, o.VALID, select=_FINAL))
def stream_dedup(spark, d):
    return _streamed(spark, d).read("txn_events").select("sourceNodeId", "targetNodeId", "value", "time")


@query(o.with_(o.RAW, o.VALID, select=_FINAL))
def stream_restart(spark, d):
    """The same rows delivered again after a restart from the checkpoint."""
    return _streamed(spark, d, True).read("txn_events").select("sourceNodeId", "targetNodeId", "value", "time")


@query(o.with_(o.RAW, o.VALID, select=_FINAL))
def stream_watermark_dedup(spark, d):
    """Repeats within the watermark are dropped by the stream's own state, before the sink sees them."""
    return _streamed(spark, d, within="10 minutes", keep_late=False).read("txn_events").select("sourceNodeId", "targetNodeId", "value", "time")


@query(o.with_(o.RAW, o.VALID, select="SELECT DISTINCT src AS \"sourceNodeId\", dst AS \"targetNodeId\", value, step AS time FROM checked WHERE NOT good"))
def stream_dead_letter(spark, d):
    """Dead letters are kept once, though all rows are delivered twice."""
    return _streamed(spark, d, True).read("txn_events_dead_letter").select("sourceNodeId", "targetNodeId", "value", "time")


@query(o.with_(o.RAW, o.VALID, select="SELECT COUNT(*) AS n FROM (" + _FINAL + ") x"))
def stream_replay(spark, d):
    """Replaying dead letters (none of which became valid) twice changes nothing."""
    from vigil.streaming import ingest

    store = _streamed(spark, d)
    for _ in range(2):
        ingest.replay(store)
    return store.read("txn_events").agg(F.count("*").alias("n"))


def _outcomes(spark, d):
    """All rows but the tenth that is held back, and then all rows once more; the watermark is ten days."""
    from vigil.sources.store import TableStore
    from vigil.streaming import ingest

    store, raw = _store(spark), t.raw_rows(spark, d)
    for rows in (raw.where("event_id % 10 <> 0"), raw):
        ingest.feed(rows.select(*ingest.KEYS), f"{store.root}/in", 4000)
        ingest.run(spark, f"{store.root}/in", store, f"{store.root}/checkpoint", within="10 days")
    return TableStore(spark, store.root)


_DELIVERED = "delivered AS (SELECT checked.*, good AND step_n < (SELECT max(CASE WHEN good THEN CAST(step AS INTEGER) END) FROM checked WHERE event_id % 10 <> 0) - 240 AS late FROM (SELECT *, CASE WHEN good THEN CAST(step AS INTEGER) END AS step_n FROM checked) checked)"


@query(o.with_(o.RAW, o.VALID, _DELIVERED, select="SELECT CAST(src AS INTEGER) AS \"sourceNodeId\", CAST(dst AS INTEGER) AS \"targetNodeId\", CAST(value AS DOUBLE) AS value, CAST(step AS INTEGER) AS time, COUNT(*) AS n FROM delivered WHERE late GROUP BY 1, 2, 3, 4"))
def stream_late_rows(spark, d):
    """The rows that came later than the watermark, each with how often it came; none of them is lost."""
    return _outcomes(spark, d).read("txn_events_late").groupBy("sourceNodeId", "targetNodeId", "value", "time").agg(F.count("*").alias("n"))


_KEPT = """SELECT (SELECT COUNT(*) FROM checked) + (SELECT COUNT(*) FROM checked WHERE event_id % 10 <> 0) AS delivered,
  (SELECT COUNT(*) FROM (SELECT DISTINCT src, dst, CAST(value AS DOUBLE) AS value, step FROM delivered WHERE good AND (NOT late OR event_id % 10 <> 0)) x) AS in_target,
  (SELECT COUNT(*) FROM delivered WHERE late) AS late, (SELECT COUNT(*) FROM checked WHERE NOT good) + (SELECT COUNT(*) FROM checked WHERE NOT good AND event_id % 10 <> 0) AS invalid, CAST(0 AS BIGINT) AS unaccounted"""


@query(o.with_(o.RAW, o.VALID, _DELIVERED, select=_KEPT))
def stream_row_outcomes(spark, d):
    """What became of all rows delivered: those of no outcome (first, repeated, late or invalid) would be unaccounted for."""
    store = _outcomes(spark, d)
    parts = store.read("ops_control").agg(*[F.sum(c).cast("long").alias(n) for c, n in (("expected_row_count", "delivered"), ("processed_row_count", "first"), ("repeated_rows", "repeated"), ("late_rows", "late"), ("dead_letter_count", "invalid"))])
    target = store.read("txn_events").agg(F.count("*").alias("in_target"))
    return parts.crossJoin(target).select("delivered", "in_target", "late", "invalid", F.expr("delivered - first - repeated - late - invalid").alias("unaccounted"))


# --- operations -------------------------------------------------------------------------------------------------------

_CTL = "pipeline_name business_process impacted_table freshness_status last_good_batch_age_minutes upstream_owner batch_id recorded_at".split()


@query(o.with_(o.CONTROL, select="SELECT pipeline_name, freshness_status, COUNT(*) AS n FROM control GROUP BY 1, 2"))
def ops_freshness(spark, d):
    return t.control(spark, d).groupBy("pipeline_name", "freshness_status").agg(F.count("*").alias("n"))


@query(o.with_(o.CONTROL, select="SELECT " + ", ".join(_CTL) + " FROM control WHERE freshness_status <> 'fresh' OR dead_letter_count > 0"))
def ops_alerts(spark, d):
    return ops.needs_action(t.control(spark, d)).select(*_CTL).orderBy(F.desc("recorded_at"))


@query(o.with_(o.CONTROL, select="SELECT batch_id, CAST(CASE freshness_status WHEN 'degraded' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END AS INTEGER) AS urgency, dead_letter_count, recorded_at FROM control WHERE freshness_status <> 'fresh' OR dead_letter_count > 0"))
def ops_handoff(spark, d):
    return ops.handoff_queue(t.control(spark, d)).select("batch_id", ops.urgency().alias("urgency"), "dead_letter_count", "recorded_at")


_CARD = "avg_runtime_seconds max_runtime_seconds avg_estimated_cost_usd total_estimated_cost_usd avg_last_good_batch_age_minutes max_last_good_batch_age_minutes".split()


@query(o.with_(o.CONTROL, select="""SELECT pipeline_name, business_process, COUNT(*) AS run_count, round(AVG(runtime_seconds), 6) AS avg_runtime_seconds, round(CAST(MAX(runtime_seconds) AS DOUBLE), 6) AS max_runtime_seconds,
  round(AVG(estimated_cloud_cost_usd), 6) AS avg_estimated_cost_usd, round(SUM(estimated_cloud_cost_usd), 6) AS total_estimated_cost_usd, round(AVG(last_good_batch_age_minutes), 6) AS avg_last_good_batch_age_minutes, round(MAX(last_good_batch_age_minutes), 6) AS max_last_good_batch_age_minutes,
  CAST(SUM(dead_letter_count) AS BIGINT) AS total_dead_letter_count, COUNT(CASE WHEN freshness_status = 'fresh' THEN 1 END) AS fresh_runs, COUNT(CASE WHEN freshness_status = 'stale' THEN 1 END) AS stale_runs, COUNT(CASE WHEN freshness_status = 'degraded' THEN 1 END) AS degraded_runs
  FROM control WHERE recorded_at >= TIMESTAMP '2024-02-01' - INTERVAL 7 DAY GROUP BY 1, 2"""))
def ops_scorecard(spark, d):
    out = ops.scorecard(t.control(spark, d), F.lit(LAST_DAY).cast("timestamp_ntz"))
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in _CARD})


@query(o.with_(o.CONTROL, select="SELECT pipeline_name, impacted_table, freshness_status, batch_id AS as_of_batch_id, recorded_at FROM control WHERE pipeline_name = 'gold_month_end_publish' ORDER BY recorded_at DESC LIMIT 1"))
def ops_month_end(spark, d):
    last = ops.latest_publish(t.control(spark, d), "gold_month_end_publish")
    return last.select("pipeline_name", "impacted_table", "freshness_status", F.col("batch_id").alias("as_of_batch_id"), "recorded_at")


@query("WITH h AS (SELECT event_type AS table_name, ts AS observed_at, event_id, event_id % 3 = 0 AS is_breaking FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY observed_at DESC) AS k FROM h) SELECT table_name, CAST(event_id AS VARCHAR) AS schema_hash, observed_at FROM r WHERE k = 1 AND is_breaking")
def ops_drift_latest(spark, d):
    e = t.table(spark, d, "events")
    history = e.select(F.col("event_type").alias("table_name"), F.col("event_id").cast("string").alias("schema_hash"), F.col("ts").alias("observed_at"), (F.col("event_id") % 3 == 0).alias("is_breaking"))
    return ops.latest_breaking_drift(history)


def _week_before(spark, d):
    return features.as_of_date(t.transactions(spark, d)) - datetime.timedelta(days=7)


def _two(select: str) -> str:
    now = o.with_(*o.SCORED, select="SELECT * FROM {}")
    before = o.with_(*o.EARLIER, select="SELECT * FROM {}")
    return f"WITH now_b AS ({now.format('banded')}), old_b AS ({before.format('banded')}), now_a AS ({now.format('alerts')}), old_a AS ({before.format('alerts')}) {select}"


@query(_two("SELECT COALESCE(a.r, b.r) AS escalation_reason, COALESCE(p, 0) AS previous_alert_count, COALESCE(c, 0) AS current_alert_count, COALESCE(c, 0) - COALESCE(p, 0) AS delta FROM (SELECT escalation_reason AS r, COUNT(*) AS c FROM now_a GROUP BY 1) a FULL JOIN (SELECT escalation_reason AS r, COUNT(*) AS p FROM old_a GROUP BY 1) b ON a.r = b.r"))
def var_headline(spark, d):
    return ops.headline_deltas(_alerts(spark, d), _alerts(spark, d, _week_before(spark, d)))


@query(_two("SELECT CASE WHEN b.entity_id IS NULL THEN 'ENTERED' ELSE 'DROPPED' END AS change_type, COALESCE(a.entity_id, b.entity_id) AS entity_id, COALESCE(a.account_id, b.account_id) AS account_id, a.composite_risk_score AS current_score FROM now_a a FULL JOIN old_a b ON a.entity_id = b.entity_id AND a.account_id = b.account_id WHERE a.entity_id IS NULL OR b.entity_id IS NULL"))
def var_churn(spark, d):
    return ops.churn(_alerts(spark, d), _alerts(spark, d, _week_before(spark, d)))


@query(_two("SELECT a.entity_id, a.account_id, b.composite_risk_score AS prev_score, a.composite_risk_score AS current_score, a.composite_risk_score - b.composite_risk_score AS score_delta, b.score_band AS prev_band, a.score_band AS current_band FROM now_b a JOIN old_b b ON a.entity_id = b.entity_id WHERE a.composite_risk_score <> b.composite_risk_score ORDER BY abs(a.composite_risk_score - b.composite_risk_score) DESC, a.entity_id LIMIT 50"))
def var_movers(spark, d):
    return ops.score_movers(t.profiles(spark, d), t.profiles(spark, d, day=_week_before(spark, d)))


# --- dashboards and governance ----------------------------------------------------------------------------------------


@query(o.with_(*o.SCORED, o.CONTROL, select="""SELECT (SELECT COUNT(*) FROM banded) AS total_accounts, (SELECT COUNT(*) FROM alerts) AS alerts_prioritized, (SELECT COUNT(*) FROM banded WHERE score_band = 'high') AS high_risk_entities,
  round(1.0 - (SELECT COUNT(*) FROM alerts) * 1.0 / (SELECT COUNT(*) FROM banded), 4) AS queue_reduction_pct, (SELECT COUNT(*) FROM banded WHERE best_band_rank = 3) AS exact_matches, (SELECT COUNT(*) FROM banded WHERE best_band_rank = 2) AS strong_matches,
  (SELECT COUNT(*) FROM banded WHERE best_band_rank = 1) AS weak_matches, (SELECT round((epoch(TIMESTAMP '2024-02-01') - epoch(max(recorded_at))) / 60.0, 1) FROM control) AS minutes_since_last_batch,
  (SELECT round(SUM(dead_letter_count) * 1.0 / (SUM(dead_letter_count) + SUM(processed_row_count)), 4) FROM control) AS dead_letter_rate, (SELECT COUNT(*) FROM control) AS total_batches_recorded"""))
def bi_kpis(spark, d):
    return serving.kpis(t.profiles(spark, d), _alerts(spark, d), t.control(spark, d).withColumn("recorded_at", F.col("recorded_at").cast("timestamp")), F.lit(LAST_DAY).cast("timestamp_ntz").cast("timestamp"))


@query(o.with_(*o.SCORED, select="SELECT score_band, COUNT(*) AS cnt FROM banded GROUP BY 1"))
def bi_band_dist(spark, d):
    return score_band(spark, d)


@query(o.with_(*o.SCORED, select="SELECT priority_rank, synthetic_holder_name, synthetic_country, composite_risk_score, escalation_reason, status FROM alerts JOIN acc ON acc.account_id = alerts.account_id"))
def bi_alert_display(spark, d):
    out = _alerts(spark, d).join(t.accounts(spark, d), "account_id")
    return out.select("priority_rank", "synthetic_holder_name", "synthetic_country", "composite_risk_score", "escalation_reason", "status").orderBy("priority_rank")


@query(_SUMMARY.format("highest_confidence_band, COUNT(*) AS cnt", " GROUP BY 1"))
def bi_confidence_mix(spark, d):
    return _summary(spark, d).groupBy("highest_confidence_band").agg(F.count("*").alias("cnt"))


@query(_SUMMARY.format("risk_type, CAST(SUM(matched_account_count) AS BIGINT) AS total_matched", " GROUP BY 1"))
def bi_exposure(spark, d):
    return _summary(spark, d).groupBy("risk_type").agg(F.sum("matched_account_count").alias("total_matched"))


@query(o.with_(*o.SCORED, "rk AS (SELECT composite_risk_score AS s, RANK() OVER (ORDER BY composite_risk_score DESC) AS k FROM banded)", select="SELECT round(CAST(SUM(CASE WHEN k <= ceil((SELECT COUNT(*) FROM banded) * 0.1) THEN s END) AS DOUBLE) / SUM(s), 6) AS risk_concentration FROM rk"))
def bi_concentration(spark, d):
    return serving.concentration(t.profiles(spark, d))


@query(o.with_(*o.SCORED, select="SELECT (SELECT COUNT(*) FROM banded) AS screened, (SELECT COUNT(*) FROM alerts) AS alerts, round(((SELECT COUNT(*) FROM banded) - (SELECT COUNT(*) FROM alerts)) * 8 / 60.0, 6) AS hours_saved"))
def bi_hours_saved(spark, d):
    return serving.hours_saved(t.profiles(spark, d), _alerts(spark, d))


@query(o.with_(*o.SCORED, select="SELECT factor, COUNT(*) AS accounts, CAST(SUM(points) AS BIGINT) AS points FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS factor, CAST({p} AS INTEGER) AS points FROM banded WHERE {p} > 0" for p, name, _ in _FACTORS) + ") x GROUP BY 1"))
def bi_factor_freq(spark, d):
    return serving.factor_frequency(t.profiles(spark, d))


@query(o.with_(*o.SCORED, select="SELECT CASE best_band_rank WHEN 3 THEN 'Exact' WHEN 2 THEN 'Strong' WHEN 1 THEN 'Weak' ELSE 'None' END AS label, COUNT(*) AS n FROM banded GROUP BY 1"))
def bi_band_label(spark, d):
    return t.profiles(spark, d).groupBy(serving.band_label().alias("label")).agg(F.count("*").alias("n"))


@query(o.with_(o.CONTROL, select="SELECT pipeline_name, batch_id, processed_row_count, dead_letter_count, freshness_status, recorded_at FROM control"))
def bi_ops_rows(spark, d):
    return t.control(spark, d).select("pipeline_name", "batch_id", "processed_row_count", "dead_letter_count", "freshness_status", "recorded_at")


@query(o.with_(o.CONTROL, select="SELECT round(AVG(lag_seconds) / 60, 6) AS avg_lag_minutes, round(CAST(SUM(dead_letter_count) AS DOUBLE) / (SUM(dead_letter_count) + SUM(processed_row_count)), 6) AS dead_letter_rate, COUNT(CASE WHEN freshness_status <> 'fresh' THEN 1 END) AS stale_or_degraded FROM control"))
def bi_ops_measures(spark, d):
    dead = F.sum("dead_letter_count")
    return t.control(spark, d).agg(F.round(F.avg("lag_seconds") / 60, 6).alias("avg_lag_minutes"), F.round(F.try_divide(dead, dead + F.sum("processed_row_count")), 6).alias("dead_letter_rate"), F.count_if(F.col("freshness_status") != "fresh").alias("stale_or_degraded"))


@query(o.with_(*o.SCORED, o.CONTROL, select="SELECT account_id, (SELECT batch_id FROM control WHERE pipeline_name = 'gold_month_end_publish' ORDER BY recorded_at DESC LIMIT 1) AS as_of_batch_id, true AS is_stale FROM banded"))
def serving_month_end(spark, d):
    c = t.control(spark, d).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    ops.publish_serving_view(t.profiles(spark, d), c, "gold_month_end_publish")
    return spark.table("month_end_serving").select("account_id", "as_of_batch_id", "is_stale")


@query(o.with_(o.ACCOUNTS, select="SELECT account_id, 'MASKED#' || substr(sha256(synthetic_holder_name), 1, 8) AS synthetic_holder_name, synthetic_country, CAST(NULL AS VARCHAR) AS synthetic_dob, init_balance FROM acc"))
def gov_masked_accounts(spark, d):
    governance.publish(spark, "analyst", accounts=t.accounts(spark, d))
    return spark.table("account_view")


@query(o.with_(*o.SCORED, select="SELECT account_id, composite_risk_score FROM alerts WHERE composite_risk_score % 20 <> 0"))
def gov_alert_visibility(spark, d):
    a = _alerts(spark, d).withColumn("status", F.when(F.col("composite_risk_score") % 20 == 0, "suppressed").otherwise(F.col("status")))
    governance.publish(spark, "analyst", alerts=a)
    return spark.table("alert_view").select("account_id", "composite_risk_score")


_DRIFT = """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, CAST(month(o_orderdate) AS INTEGER) AS n, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus AS s, o_totalprice IS NULL AS none FROM orders),
f AS (SELECT m, 'id' AS path, 'BIGINT' AS type FROM r UNION SELECT m, 'ship.urgency', 'STRING' FROM r
  UNION SELECT m, 'price', CASE WHEN count(DISTINCT CASE WHEN n % 4 = 0 AND s = 'P' OR n % 6 = 5 THEN 1 ELSE 0 END) > 1 THEN 'VARIANT' WHEN bool_or(n % 6 = 5) OR bool_and(n % 4 = 0 AND s = 'P') THEN 'STRING' ELSE 'DECIMAL' END FROM r WHERE NOT none GROUP BY m
  UNION SELECT m, 'ship.paid', 'BOOLEAN' FROM r WHERE s = 'F' AND n % 3 = 1
  UNION SELECT m, 'tags[]', CASE WHEN y % 2 = 0 THEN 'BIGINT' ELSE 'STRING' END FROM r WHERE s = 'P'
  UNION SELECT m, '$', 'MALFORMED' FROM r WHERE s = 'O' AND n = 7),
ms AS (SELECT m, lag(m) OVER (ORDER BY m) AS p FROM (SELECT DISTINCT m FROM f) x),
old AS (SELECT ms.m, path, type FROM f JOIN ms ON ms.p = f.m), new AS (SELECT f.* FROM f JOIN ms USING (m) WHERE p IS NOT NULL)
SELECT period, path, change, old_type, new_type, CASE WHEN path = '$' THEN change = 'added' ELSE change <> 'added' END AS is_breaking FROM (
  SELECT COALESCE(new.m, old.m) AS period, COALESCE(new.path, old.path) AS path, old.type AS old_type, new.type AS new_type,
    CASE WHEN old.type IS NULL THEN 'added' WHEN new.type IS NULL THEN 'removed' WHEN old.type <> new.type THEN 'type_changed' END AS change
  FROM new FULL OUTER JOIN old ON new.m = old.m AND new.path = old.path) y WHERE change IS NOT NULL"""


@query(_DRIFT)
def ops_drift_in_json(spark, d):
    """Fields that come, go and change by month in orders turned to JSON, whose fields depend on status and date."""
    orders = t.table(spark, d, "orders").withColumns({"n": F.month("o_orderdate"), "s": F.col("o_orderstatus")})
    n, s, price = F.col("n"), F.col("s"), F.col("o_totalprice").cast("decimal(18, 2)")
    as_text = ((n % 4 == 0) & (s == "P")) | (n % 6 == 5)
    ship = F.struct(F.col("o_orderpriority").alias("urgency"), F.when((s == "F") & (n % 3 == 1), F.lit(True)).alias("paid"))
    numbers, words = F.array(F.lit(1), F.lit(2)), F.array(F.lit("a"))
    even = F.year("o_orderdate") % 2 == 0
    made = F.to_json(F.struct(F.col("o_orderkey").alias("id"), ship.alias("ship"), F.lit("@").alias("price"), F.when((s == "P") & even, numbers).alias("tags"), F.when((s == "P") & ~even, words).alias("tags_")))
    shown = F.when(as_text, F.concat(F.lit('"'), price.cast("string"), F.lit('"'))).otherwise(price.cast("string"))
    made = F.regexp_replace(F.replace(made, F.lit('"tags_"'), F.lit('"tags"')), '"@"', F.coalesce(shown, F.lit("null")))
    broken = F.when((s == "O") & (n == 7), F.substring(made, 1, 9)).otherwise(made)
    return drift.drift_within(orders.select("o_orderdate", broken.alias("body")), "body", F.date_format("o_orderdate", "yyyy-MM"))


@query(o.with_(*o.SCORED, select="SELECT (SELECT COUNT(*) FROM acc) AS accounts, (SELECT COUNT(*) FROM banded) AS profiles, (SELECT COUNT(*) FROM alerts) AS alerts"))
def gate_reconcile(spark, d):
    return ops.counts_to_reconcile(t.accounts(spark, d), t.profiles(spark, d), _alerts(spark, d))


@query(o.with_(o.RAW, select="SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT src, dst, value, step FROM raw WHERE src IS NOT NULL AND dst IS NOT NULL AND value IS NOT NULL AND step IS NOT NULL) x) AS whole_keys, (SELECT COUNT(*) FROM raw) AS n"))
def agg_distinct_keys(spark, d):
    """Distinct combinations of several columns; those with a null in any of them don't count."""
    from vigil.streaming import ingest

    return t.raw_rows(spark, d).agg(F.count_distinct(*ingest.KEYS).alias("whole_keys"), F.count("*").alias("n"))


@query(o.with_(o.ACCOUNTS, select="SELECT account_id, '*** REDACTED ***' AS address_line, synthetic_country AS country FROM acc"))
def gov_masked_addresses(spark, d):
    a = t.accounts(spark, d).select("account_id", F.col("synthetic_holder_name").alias("address_line"), F.col("synthetic_country").alias("country"))
    governance.publish(spark, "analyst", addresses=a)
    return spark.table("address_view")


@query(o.with_(o.RAW, o.VALID, select="SELECT COUNT(CASE WHEN good THEN 1 END) AS valid, COUNT(CASE WHEN NOT good THEN 1 END) AS invalid, round(COUNT(CASE WHEN NOT good THEN 1 END) / CAST(COUNT(*) AS DOUBLE), 6) AS share FROM checked"))
def quality_invalid_ratio(spark, d):
    v = t.raw_rows(spark, d).select(quality.valid_transaction().alias("v"))
    return v.agg(F.count_if("v").alias("valid"), F.count_if(~F.col("v")).alias("invalid"), F.round(F.count_if(~F.col("v")) / F.count("*"), 6).alias("share"))
