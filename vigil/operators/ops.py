"""The control table of batches, freshness, drift history, reconciliation, and the reports over them."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.quality import DataContractError, schema_diff, schema_fields, schema_hash

# Seconds of lag up to which a batch is fresh or stale, and dollars a row by kind of pipeline.
FRESH_SECONDS, STALE_SECONDS = 900, 2_700
COST = {"stream": 2e-6, "silver": 1e-6, "gold": 8e-7}
CONTROL_SCHEMA = (
    "pipeline_name string, business_process string, impacted_table string, batch_id string, last_successful_batch_id string, "
    "expected_row_count int, processed_row_count int, dead_letter_count int, lag_seconds double, freshness_status string, "
    "runtime_seconds double, estimated_cloud_cost_usd double, last_good_batch_age_minutes double, upstream_system string, "
    "upstream_owner string, upstream_contact string, recorded_at timestamp"
)
DRIFT_SCHEMA = "pipeline_name string, table_name string, schema_hash string, schema_json string, drift_json string, is_breaking boolean, observed_at timestamp"


def freshness(lag: Column) -> Column:
    return F.when(lag <= FRESH_SECONDS, "fresh").when(lag <= STALE_SECONDS, "stale").otherwise("degraded")


def freshness_status(lag: float) -> str:
    return "fresh" if lag <= FRESH_SECONDS else "stale" if lag <= STALE_SECONDS else "degraded"


def estimated_cost(rows: Column, kind: str) -> Column:
    return rows * F.lit(COST[kind])


def needs_action(control: DataFrame) -> DataFrame:
    return control.where((F.col("freshness_status") != "fresh") | (F.col("dead_letter_count") > 0))


def urgency() -> Column:
    return F.when(F.col("freshness_status") == "degraded", 1).when(F.col("freshness_status") == "stale", 2).otherwise(3)


def handoff_queue(control: DataFrame) -> DataFrame:
    return needs_action(control).orderBy(urgency(), F.desc("dead_letter_count"), F.desc("recorded_at"))


def scorecard(control: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Runs, runtimes, costs, ages, dead letters and freshness by pipeline since `days` before now."""
    status = lambda s: F.count_if(F.col("freshness_status") == s)
    return (
        control.where(F.col("recorded_at") >= now - F.make_dt_interval(days=F.lit(days)))
        .groupBy("pipeline_name", "business_process")
        .agg(
            F.count("*").alias("run_count"), F.avg("runtime_seconds").alias("avg_runtime_seconds"), F.max("runtime_seconds").alias("max_runtime_seconds"),
            F.avg("estimated_cloud_cost_usd").alias("avg_estimated_cost_usd"), F.sum("estimated_cloud_cost_usd").alias("total_estimated_cost_usd"),
            F.avg("last_good_batch_age_minutes").alias("avg_last_good_batch_age_minutes"), F.max("last_good_batch_age_minutes").alias("max_last_good_batch_age_minutes"),
            F.sum("dead_letter_count").alias("total_dead_letter_count"), status("fresh").alias("fresh_runs"), status("stale").alias("stale_runs"), status("degraded").alias("degraded_runs"),
        )
    )


def latest_publish(control: DataFrame, pipeline: str) -> DataFrame:
    return control.where(F.col("pipeline_name") == pipeline).orderBy(F.desc("recorded_at"), "batch_id").limit(1)


def serving_view(profiles: DataFrame, control: DataFrame, pipeline: str, now: Column) -> DataFrame:
    """profiles with the age of the latest publish, judged when read; without a publish the rows stay, as stale."""
    last = latest_publish(control, pipeline).select(F.col("batch_id").alias("as_of_batch_id"), F.col("recorded_at").alias("serving_metadata_recorded_at"))
    out = profiles.withColumn("_one", F.lit(1)).join(F.broadcast(last.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    age = F.unix_timestamp(now) - F.unix_timestamp("serving_metadata_recorded_at")
    return out.withColumns({"is_stale": F.coalesce(freshness(age) != "fresh", F.lit(True)), "last_good_batch_age_minutes": age / 60.0})


def publish_serving_view(profiles: DataFrame, control: DataFrame, pipeline: str, name: str = "month_end_serving") -> None:
    """The same as a view over the two relations: it finds the latest publish and its age whenever it is read."""
    spark = profiles.sparkSession
    profiles.createOrReplaceTempView(f"{name}_profiles")
    control.createOrReplaceTempView(f"{name}_control")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY VIEW {name} AS
        WITH last AS (SELECT batch_id, recorded_at FROM {name}_control WHERE pipeline_name = '{pipeline}' ORDER BY recorded_at DESC, batch_id LIMIT 1)
        SELECT p.*, last.batch_id AS as_of_batch_id, last.recorded_at AS serving_metadata_recorded_at,
          coalesce(unix_timestamp(current_timestamp()) - unix_timestamp(last.recorded_at) > {FRESH_SECONDS}, true) AS is_stale,
          (unix_timestamp(current_timestamp()) - unix_timestamp(last.recorded_at)) / 60.0D AS last_good_batch_age_minutes
        FROM {name}_profiles p LEFT JOIN last ON true""")


def latest_breaking_drift(history: DataFrame) -> DataFrame:
    """Tables whose latest observation is a breaking change."""
    order = Window.partitionBy("table_name").orderBy(F.desc("observed_at"), F.desc("schema_hash"))
    return history.withColumn("_n", F.row_number().over(order)).where("_n = 1 AND is_breaking").drop("_n", "is_breaking")


def observe_schema(store, pipeline: str, table: str, schema: T.StructType, observed_at: datetime.datetime) -> dict:
    """Snapshot a table's schema and its difference to the last accepted one; a breaking change is kept, then raised.

    A broken observation isn't accepted, so the change blocks every run until the schema fits again or accept_schema() is called.
    """
    fields = schema_fields(schema)
    before = fields
    if store.exists("ops_schema_drift"):
        last = store.read("ops_schema_drift").where((F.col("table_name") == table) & ~F.col("is_breaking")).orderBy(F.desc("observed_at"), F.desc("schema_hash")).first()
        before = json.loads(last.schema_json) if last else fields
    drift = schema_diff(before, fields)
    row = (pipeline, table, schema_hash(fields), json.dumps(fields, sort_keys=True), json.dumps(drift), drift["is_breaking"], observed_at)
    store.append(store.spark.createDataFrame([row], DRIFT_SCHEMA), "ops_schema_drift")
    if drift["is_breaking"]:
        raise DataContractError(f"{table} breaks its schema: removed {drift['removed']}, retyped {drift['type_changed']}")
    return drift


def accept_schema(store, pipeline: str, table: str, schema: T.StructType, observed_at: datetime.datetime) -> None:
    """Take a schema for the one to compare with from now on."""
    fields = schema_fields(schema)
    row = (pipeline, table, schema_hash(fields), json.dumps(fields, sort_keys=True), json.dumps(schema_diff(fields, fields)), False, observed_at)
    store.append(store.spark.createDataFrame([row], DRIFT_SCHEMA), "ops_schema_drift")


def headline_deltas(now: DataFrame, before: DataFrame) -> DataFrame:
    a = now.groupBy("escalation_reason").agg(F.count("*").alias("c"))
    b = before.groupBy("escalation_reason").agg(F.count("*").alias("p"))
    out = a.join(b, "escalation_reason", "full").select("escalation_reason", F.coalesce("p", F.lit(0)).alias("previous_alert_count"), F.coalesce("c", F.lit(0)).alias("current_alert_count"))
    return out.withColumn("delta", F.col("current_alert_count") - F.col("previous_alert_count"))


def churn(now: DataFrame, before: DataFrame) -> DataFrame:
    """Entities in one queue only; two anti joins rather than a full join of everything."""
    keys = ["entity_id", "account_id"]
    entered = now.join(before, keys, "left_anti").select(F.lit("ENTERED").alias("change_type"), *keys, F.col("composite_risk_score").alias("current_score"))
    return entered.unionByName(before.join(now, keys, "left_anti").select(F.lit("DROPPED").alias("change_type"), *keys, F.lit(None).cast("int").alias("current_score")))


def score_movers(now: DataFrame, before: DataFrame, n: int | None = 50) -> DataFrame:
    old = before.select("entity_id", "account_id", F.col("composite_risk_score").alias("prev_score"), F.col("score_band").alias("prev_band"))
    out = now.select("entity_id", "account_id", F.col("composite_risk_score").alias("current_score"), F.col("score_band").alias("current_band")).join(old, ["entity_id", "account_id"])
    out = out.where("current_score <> prev_score").withColumn("score_delta", F.col("current_score") - F.col("prev_score"))
    return out.orderBy(F.desc(F.abs("score_delta")), "entity_id").limit(n) if n else out


def counts_to_reconcile(accounts: DataFrame, profiles: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: accounts, profiles, alerts."""
    one = lambda df, name: df.agg((F.count_distinct("account_id") if name == "accounts" else F.count(F.lit(1))).alias("n")).select(F.lit(name).alias("of"), "n")
    parts = one(accounts, "accounts").union(one(profiles, "profiles")).union(one(alerts, "alerts"))
    return parts.agg(*[F.max(F.when(F.col("of") == c, F.col("n"))).alias(c) for c in ("accounts", "profiles", "alerts")])


def reconcile(accounts: DataFrame, profiles: DataFrame, alerts: DataFrame) -> dict[str, int]:
    """Every account has one profile, and no more alerts than profiles; counts, or a broken contract."""
    n = counts_to_reconcile(accounts, profiles, alerts).first().asDict()
    if n["accounts"] != n["profiles"] or n["alerts"] > n["profiles"]:
        raise DataContractError(f"counts don't reconcile: {n}")
    return n


def control_row(pipeline: str, process: str, table: str, batch_id: str, expected: int, processed: int, dead: int, lag: float, runtime: float, kind: str, upstream: dict[str, str], recorded_at: datetime.datetime, last_good: str | None = None) -> tuple:
    return (pipeline, process, table, batch_id, last_good or batch_id, expected, processed, dead, lag, freshness_status(lag), runtime, processed * COST[kind], lag / 60.0, upstream.get("system"), upstream.get("owner"), upstream.get("contact"), recorded_at)
