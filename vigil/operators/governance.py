"""Masks and row filters by the reader's role: as projections, and as views that read the role from a session variable.

`publish` makes the views. They hold SQL functions as masks and a filter on the variable `reader_role`, so what a reader
sees changes with `become`, without new views or code; a role that isn't known sees the masked rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The roles that see everything, and those that see suppressed alerts.
CLEAR_ROLES = frozenset({"data_engineers", "platform_admins"})
REVIEW_ROLES = CLEAR_ROLES | {"analytics_engineers"}


def mask_name(name: Column) -> Column:
    return F.concat(F.lit("MASKED#"), F.substring(F.sha2(F.coalesce(name, F.lit("")), 256), 1, 8))


def mask_accounts(accounts: DataFrame, role: str) -> DataFrame:
    if role in CLEAR_ROLES:
        return accounts
    return accounts.withColumns({"synthetic_holder_name": mask_name(F.col("synthetic_holder_name")), "synthetic_dob": F.lit(None).cast("string")})


def mask_addresses(addresses: DataFrame, role: str) -> DataFrame:
    return addresses if role in CLEAR_ROLES else addresses.withColumn("address_line", F.lit("*** REDACTED ***"))


def visible_alerts(alerts: DataFrame, role: str) -> DataFrame:
    return alerts if role in REVIEW_ROLES else alerts.where(F.col("status") != "suppressed")


def _in(roles: frozenset[str]) -> str:
    return "reader_role IN (" + ", ".join(f"'{r}'" for r in sorted(roles)) + ")"


def become(spark: SparkSession, role: str) -> None:
    """Set the session's role."""
    spark.sql("DECLARE OR REPLACE VARIABLE reader_role STRING DEFAULT 'none'")
    spark.sql("SET VARIABLE reader_role = :role", args={"role": role})


def publish(spark: SparkSession, role: str, accounts: DataFrame | None = None, addresses: DataFrame | None = None, alerts: DataFrame | None = None) -> None:
    """Views account_view, address_view and alert_view over the relations given, for whatever role the session has."""
    become(spark, role)
    clear = _in(CLEAR_ROLES)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION masked_name(name STRING) RETURNS STRING RETURN CASE WHEN {clear} THEN name ELSE concat('MASKED#', substring(sha2(coalesce(name, ''), 256), 1, 8)) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION masked_birth(day STRING) RETURNS STRING RETURN CASE WHEN {clear} THEN day END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION masked_address(line STRING) RETURNS STRING RETURN CASE WHEN {clear} THEN line ELSE '*** REDACTED ***' END")
    masks = {"synthetic_holder_name": "masked_name", "synthetic_dob": "masked_birth", "address_line": "masked_address"}
    for name, df, where in (("account", accounts, "true"), ("address", addresses, "true"), ("alert", alerts, f"status <> 'suppressed' OR {_in(REVIEW_ROLES)}")):
        if df is not None:
            df.createOrReplaceTempView(f"{name}_base")
            columns = ", ".join(f"{masks[c]}(`{c}`) AS `{c}`" if c in masks and name != "alert" else f"`{c}`" for c in df.columns)
            spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name}_view AS SELECT {columns} FROM {name}_base WHERE {where}")
