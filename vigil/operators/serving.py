"""Datasets and measures of the dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MINUTES_PER_REVIEW = 8  # an assumption of the business case, not measured


def kpis(profiles: DataFrame, alerts: DataFrame, control: DataFrame, now) -> DataFrame:
    """One row of headline figures."""
    band = lambda k: F.count_if(F.col("best_band_rank") == k)
    a = profiles.agg(F.count("*").alias("total_accounts"), F.count_if(F.col("score_band") == "high").alias("high_risk_entities"), band(3).alias("exact_matches"), band(2).alias("strong_matches"), band(1).alias("weak_matches"))
    b = alerts.agg(F.count("*").alias("alerts_prioritized"))
    dead, done = F.sum("dead_letter_count"), F.sum("processed_row_count")
    c = control.agg(
        F.round((F.unix_timestamp(now) - F.unix_timestamp(F.max("recorded_at"))) / 60.0, 1).alias("minutes_since_last_batch"),
        F.round(F.try_divide(dead, dead + done), 4).alias("dead_letter_rate"),
        F.count("*").alias("total_batches_recorded"),
    )
    out = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))
    return out.withColumn("queue_reduction_pct", F.round(1 - F.try_divide(F.col("alerts_prioritized"), F.col("total_accounts")), 4))


def hours_saved(profiles: DataFrame, alerts: DataFrame) -> DataFrame:
    both = profiles.agg(F.count("*").alias("screened")).crossJoin(F.broadcast(alerts.agg(F.count("*").alias("alerts"))))
    return both.withColumn("hours_saved", F.round((F.col("screened") - F.col("alerts")) * MINUTES_PER_REVIEW / 60.0, 6))


def concentration(profiles: DataFrame) -> DataFrame:
    """Share of all risk held by the top tenth of accounts (ties in). Scores are few, so ranks come from their counts."""
    per = profiles.groupBy(F.col("composite_risk_score").alias("s")).agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("rank", F.coalesce(F.sum("n").over(above), F.lit(0)) + 1)
    total = per.agg(F.sum("n").alias("accounts"), F.sum(F.col("n") * F.col("s")).alias("score"))
    top = ranked.crossJoin(F.broadcast(total)).where(F.col("rank") <= F.ceil(F.col("accounts") * 0.1))
    return top.agg(F.round(F.try_divide(F.sum(F.col("n") * F.col("s")), F.max("score")), 6).alias("risk_concentration"))


def factor_frequency(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.explode("top_contributing_factors").alias("f")).groupBy("f.factor").agg(F.count("*").alias("accounts"), F.sum("f.points").alias("points"))


def band_label(column: str = "best_band_rank"):
    return F.when(F.col(column) == 3, "Exact").when(F.col(column) == 2, "Strong").when(F.col(column) == 1, "Weak").otherwise("None")
