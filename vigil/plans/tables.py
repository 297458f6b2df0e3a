"""The engine's relations, made from the tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import scoring
from vigil.session import ship

#: Rules that trip on the synthetic tables, beside the default ones.
STAND_IN_RULES = scoring.DEFAULT_RULES | {"thr_velocity_7d": 40.0, "thr_diversity_30d": 80.0, "thr_round_dollar_ratio": 0.02, "thr_network_risk": 0.2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("source_account_id"), F.get_json_object("props", "$.k").alias("target_account_id"),
        F.col("value").alias("amount"), F.col("ts").cast("timestamp_ntz").alias("event_time"), F.to_date("ts").alias("event_date"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("synthetic_country"))), "c_nationkey", "left")
    return c.select(F.col("c_custkey").cast("string").alias("account_id"), F.col("c_name").alias("synthetic_holder_name"), "synthetic_country", F.concat(F.lit("19"), F.lpad((F.col("c_custkey") % 90 + 10).cast("string"), 2, "0"), F.lit("-01-01")).alias("synthetic_dob"), F.col("c_acctbal").alias("init_balance"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in candidates by account number: band and entity are plain arithmetic, so that SQL can say the same."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    band = F.when(F.col("c_custkey") % 50 == 7, "exact").when(F.col("c_custkey") % 50 == 13, "strong").when(F.col("c_custkey") % 20 == 3, "weak")
    return c.select(F.col("c_custkey").cast("string").alias("account_id"), F.sha2(F.concat(F.lit("ofac:"), (F.col("c_custkey") % 90 + 1).cast("string")), 256).alias("entity_id"), band.alias("match_confidence_band")).where("match_confidence_band IS NOT NULL")


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where("c_custkey % 20 = 1").select(F.col("c_custkey").cast("string").alias("account_id"), (F.col("c_custkey") % 7 / 10.0).cast("double").alias("network_risk_exposure"))


def profiles(spark: SparkSession, sf_dir: str, rules: dict[str, float] | None = None, day=None) -> DataFrame:
    return scoring.profile(accounts(spark, sf_dir), transactions(spark, sf_dir), matches(spark, sf_dir), network(spark, sf_dir), rules or STAND_IN_RULES, day)


def sdn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a list with sentinels: type by size, trailing spaces as the source writes them."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 5 == 0, "individual").when(F.col("p_size") % 5 == 1, "vessel ").when(F.col("p_size") % 5 == 2, "-0- ").when(F.col("p_size") % 5 == 3, "aircraft").otherwise("castle")
    return p.select(F.col("p_partkey").cast("string").alias("ent_num"), "p_partkey", F.when(F.col("p_partkey") % 17 == 0, "-0- ").otherwise(F.concat("p_name", F.lit(" "))).alias("sdn_name"), kind.alias("sdn_type"), F.when(F.col("p_size") % 3 == 0, "-0- ").otherwise(F.col("p_brand")).alias("program"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    schema = F.when(F.col("s_suppkey") % 4 == 0, "Person").when(F.col("s_suppkey") % 4 == 1, "Organization").when(F.col("s_suppkey") % 4 == 2, "Vessel").otherwise("Company")
    lists = F.when(F.col("s_suppkey") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("c"), F.col("s_nationkey").cast("string"), F.lit("; c"), (F.col("s_nationkey") + 1).cast("string")))
    return s.select(
        F.col("s_suppkey").cast("string").alias("id"), schema.alias("schema"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise("1970-01-01").alias("birth_date"),
        lists.alias("countries"), F.lit("PRG").alias("program_ids"), F.when(F.col("s_suppkey") % 2 == 0, "opensanctions_sanctions").otherwise("opensanctions_peps").alias("source_system"),
        F.concat("s_name", F.lit("; AKA-"), F.col("s_suppkey").cast("string"), F.lit(" x!;")).alias("aliases"),
    )


def spread(rows: DataFrame, other: DataFrame, key: str, each: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt by key to tasks of about `each` of rows, where the session's number of partitions would give them more.

    What a task of their join sorts then has a bound, however large the tables are. rows should be a table, as they are counted.
    """
    parts = -(-rows.count() // each)
    if parts <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows, other
    return rows.repartition(parts, key), other.repartition(parts, key)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines, o = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), o, "l_orderkey")
    lines = lines.join(o, "l_orderkey")
    return lines.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.when(F.col("c_acctbal") < 0, "1").when(F.col("c_acctbal") >= 5000, "2").otherwise("unknown").alias("class"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.lit("unknown").alias("class")))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and four strings as a stream delivers them; one row in a hundred is broken in one of three ways."""
    e = table(spark, sf_dir, "events")
    step = (F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 3600) + 1).cast("string")
    bad, kind = F.col("event_id") % 100 == 7, F.floor(F.col("event_id") / 100) % 3
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("sourceNodeId"),
        F.when(bad & (kind == 1), None).otherwise(F.get_json_object("props", "$.k")).alias("targetNodeId"),
        F.when(bad & (kind == 0), "not_a_number").otherwise(F.format_string("%.2f", "value")).alias("value"),
        F.when(bad & (kind == 2), "-1").otherwise(step).alias("time"),
    )


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each event type and day: counts, dead letters, and the lag from the last event to midnight."""
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    g = e.groupBy("event_type", "d").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 100 == 7).alias("dead"), F.max("ts").alias("last"))
    midnight = F.date_add("d", 1).cast("timestamp")
    lag = (F.unix_timestamp(midnight) - F.unix_timestamp(F.col("last").cast("timestamp"))).cast("double")
    g = g.select(
        F.when(F.col("event_type") == "purchase", "gold_month_end_publish").otherwise(F.concat(F.lit("ingest_"), "event_type")).alias("pipeline_name"), F.lit("monitoring").alias("business_process"),
        F.concat(F.lit("events_"), "event_type").alias("impacted_table"), F.concat(F.date_format("d", "yyyyMMdd"), F.lit("-"), "event_type").alias("batch_id"),
        (F.col("n") - F.col("dead")).cast("int").alias("processed_row_count"), F.col("dead").cast("int").alias("dead_letter_count"), lag.alias("lag_seconds"), F.col("d").alias("day"),
    )
    from vigil.operators.ops import freshness

    return g.withColumns({"freshness_status": freshness(F.col("lag_seconds")), "recorded_at": F.date_add("day", 1).cast("timestamp_ntz"), "runtime_seconds": F.col("processed_row_count") / 100.0, "estimated_cloud_cost_usd": F.col("processed_row_count") * 2e-6, "last_good_batch_age_minutes": F.col("lag_seconds") / 60.0, "upstream_owner": F.concat(F.lit("team_"), F.substring("impacted_table", 8, 3))}).drop("day")
