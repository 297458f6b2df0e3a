"""Explainable risk scores: rules from a table, additive points, bands, factors, and the ranked alert queue."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import features
from vigil.operators.quality import DataContractError
from vigil.session import written

# The default rules, valid from 2026-01-01.
DEFAULT_RULES = {
    "pts_watchlist_exact": 50.0, "pts_watchlist_strong": 30.0, "pts_watchlist_weak": 10.0, "pts_velocity": 10.0, "pts_diversity": 10.0,
    "pts_round_dollar": 10.0, "pts_burst": 15.0, "pts_risky_counterparty": 20.0, "pts_network_risk": 15.0,
    "thr_velocity_7d": 20.0, "thr_diversity_30d": 15.0, "thr_round_dollar_ratio": 0.5, "thr_network_risk": 0.5, "thr_burst_multiplier": 3.0,
    "score_cap": 100.0, "band_high_min": 70.0, "band_medium_min": 40.0, "alert_min_score": 40.0,
}
RULES_FROM = datetime.date(2026, 1, 1)
RULE_SCHEMA = "rule_key string, rule_value double, valid_from date, valid_to date, is_current boolean"


def rule_table(spark: SparkSession, values: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame([(k, float(v), RULES_FROM, None, True) for k, v in (values or DEFAULT_RULES).items()], RULE_SCHEMA)


def pivot_rules(rules: DataFrame) -> DataFrame:
    """One row with a column for each rule's current value (null where a rule has none); always exactly one row."""
    return rules.where("is_current").agg(*[F.max(F.when(F.col("rule_key") == k, F.col("rule_value"))).alias(k) for k in DEFAULT_RULES])


def current_rules(rules: DataFrame) -> dict[str, float]:
    """Current values on the driver (18 numbers); a rule that is missing or doubled breaks the contract."""
    rows = rules.where("is_current").select("rule_key", "rule_value").collect()
    found = {r.rule_key: r.rule_value for r in rows}
    if len(found) != len(rows) or set(DEFAULT_RULES) - set(found):
        raise DataContractError(f"rules missing or doubled: {sorted(set(DEFAULT_RULES) - set(found))}")
    return found


def watchlist_summary(matches: DataFrame) -> DataFrame:
    """Best band (3 exact, 2 strong, 1 weak) and number of matches by account."""
    return matches.groupBy("account_id").agg(F.max(band_rank()).alias("best_band_rank"), F.count("*").alias("watchlist_match_count"))


def band_rank(column: str = "match_confidence_band") -> Column:
    return F.when(F.col(column) == "exact", 3).when(F.col(column) == "strong", 2).when(F.col(column) == "weak", 1).otherwise(0)


def band_name(rank: Column) -> Column:
    return F.when(rank == 3, "exact").when(rank == 2, "strong").otherwise("weak")


def join_features(accounts: DataFrame, txns: DataFrame, matches: DataFrame, network: DataFrame, day: datetime.date | None = None) -> DataFrame:
    """One row an account: all behaviour, exposure and match columns, with defaults for accounts without activity."""
    day = day or features.as_of_date(txns)
    out = accounts.select("account_id").withColumn("as_of_date", F.lit(day))
    for part in (features.activity(txns, day), features.diversity(txns, day), features.exposure(txns, matches).withColumn("_exposed", F.lit(True)), network.select("account_id", "network_risk_exposure"), watchlist_summary(matches)):
        out = out.join(part, "account_id", "left")
    zero = ["velocity_1d", "velocity_7d", "velocity_30d", "counterparty_diversity_30d", "watchlist_match_count", "best_band_rank"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    share = F.when(F.col("velocity_30d") > 0, F.col("round_dollar_count_30d") / F.col("velocity_30d")).otherwise(0.0)
    return out.withColumns({"round_dollar_ratio": share, "risky_counterparty_exposure": F.coalesce("_exposed", F.lit(False))}).drop("_exposed", "round_dollar_count_30d")


def score(joined: DataFrame, rules: dict[str, float]) -> DataFrame:
    """Points of the seven factors, composite score and band."""
    r = {k: F.lit(float(v)) for k, v in rules.items()}
    pts = lambda test, key: F.when(F.coalesce(test, F.lit(False)), r[key]).otherwise(0.0).cast("int")
    burst = F.coalesce(F.col("max_daily_count") > r["thr_burst_multiplier"] * F.col("avg_daily_count"), F.lit(False))
    rank = F.col("best_band_rank")
    points = {
        "pts_watchlist": F.when(rank == 3, r["pts_watchlist_exact"]).when(rank == 2, r["pts_watchlist_strong"]).when(rank == 1, r["pts_watchlist_weak"]).otherwise(0.0).cast("int"),
        "pts_velocity": pts(F.col("velocity_7d") > r["thr_velocity_7d"], "pts_velocity"),
        "pts_diversity": pts(F.col("counterparty_diversity_30d") > r["thr_diversity_30d"], "pts_diversity"),
        "pts_round_dollar": pts(F.col("round_dollar_ratio") > r["thr_round_dollar_ratio"], "pts_round_dollar"),
        "pts_burst": pts(burst, "pts_burst"),
        "pts_risky_counterparty": pts(F.col("risky_counterparty_exposure"), "pts_risky_counterparty"),
        "pts_network_risk": pts(F.col("network_risk_exposure") > r["thr_network_risk"], "pts_network_risk"),
    }
    out = joined.withColumn("burst_flag", burst).withColumns(points)
    total = sum((F.col(c) for c in points), F.lit(0))
    out = out.withColumn("composite_risk_score", F.least(r["score_cap"], total).cast("int")).withColumn("entity_id", F.col("account_id"))
    return out.withColumn("score_band", F.when(F.col("composite_risk_score") >= r["band_high_min"], "high").when(F.col("composite_risk_score") >= r["band_medium_min"], "medium").otherwise("low"))


def factors() -> Column:
    """The non-zero factors in fixed order, each with its evidence and points."""
    text = lambda c: F.col(c).cast("string")
    share = lambda c: F.format_string("%.2f", F.round(c, 2))
    rows = (
        ("pts_watchlist", "watchlist_match", band_name(F.col("best_band_rank"))),
        ("pts_velocity", "high_velocity_7d", text("velocity_7d")),
        ("pts_diversity", "high_counterparty_diversity_30d", text("counterparty_diversity_30d")),
        ("pts_round_dollar", "high_round_dollar_ratio_30d", share("round_dollar_ratio")),
        ("pts_burst", "burst_activity", F.lit("flagged")),
        ("pts_risky_counterparty", "risky_counterparty_exposure", F.lit("flagged")),
        ("pts_network_risk", "elliptic_network_risk_exposure", share("network_risk_exposure")),
    )
    each = [F.when(F.col(p) > 0, F.struct(F.lit(name).alias("factor"), evidence.alias("band"), F.col(p).alias("points"))) for p, name, evidence in rows]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def profile(accounts: DataFrame, txns: DataFrame, matches: DataFrame, network: DataFrame, rules: dict[str, float], day: datetime.date | None = None) -> DataFrame:
    return score(join_features(accounts, txns, matches, network, day), rules).withColumn("top_contributing_factors", factors())


def alert_queue(profiles: DataFrame, least: float) -> DataFrame:
    """Exact matches and scores of at least `least`, ranked. Ranks come from the few distinct scores, not a global sort."""
    due = profiles.where((F.col("best_band_rank") == 3) | (F.col("composite_risk_score") >= least))
    due = written(due.select("entity_id", "account_id", "as_of_date", "composite_risk_score", "best_band_rank"))  # ranks and rows both take it
    from pyspark.sql import Window

    per_score = due.groupBy("composite_risk_score").agg(F.count("*").alias("_n"))
    above = Window.orderBy(F.desc("composite_risk_score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_score.select("composite_risk_score", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("int").alias("priority_rank"))
    return due.join(F.broadcast(ranks), "composite_risk_score").select(
        F.sha2(F.concat("entity_id", F.lit("-"), F.col("as_of_date").cast("string")), 256).alias("alert_id"),
        "entity_id",
        "account_id",
        "priority_rank",
        "composite_risk_score",
        F.when(F.col("best_band_rank") == 3, "sanctions_hard_override").otherwise("behavioral_threshold").alias("escalation_reason"),
        F.lit("new").alias("status"),
    )


def match_summary(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """Matched accounts, best band, jurisdictions and type by watchlist entity; unknown entities drop out."""
    by = matches.select(F.col("entity_id").alias("watchlist_entity_id"), "account_id", F.greatest(F.lit(1), band_rank()).alias("rank")).distinct()
    by = by.groupBy("watchlist_entity_id").agg(F.count_distinct("account_id").alias("matched_account_count"), F.max("rank").alias("rank"))
    known = entities.select(F.col("entity_id").alias("watchlist_entity_id"), F.col("countries").alias("jurisdictions"), F.col("entity_type").alias("risk_type"))
    return by.join(known, "watchlist_entity_id").select("watchlist_entity_id", "matched_account_count", band_name(F.col("rank")).alias("highest_confidence_band"), "jurisdictions", "risk_type")
