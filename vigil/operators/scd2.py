"""Reference tables with history: a row is valid from a day until the day another takes its place."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.quality import DataContractError


def change(table: DataFrame, keys: list[str], new: DataFrame, day: datetime.date) -> DataFrame:
    """table with the current rows of new's keys closed on `day`, and new's rows opened; one pass, so never half done."""
    marks = new.select(*keys).distinct().withColumn("_changed", F.lit(True))
    joined = table.join(marks, keys, "left")
    closing = F.col("is_current") & F.coalesce("_changed", F.lit(False))
    old = joined.withColumn("valid_to", F.when(closing, F.lit(day)).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & ~closing)
    opened = new.withColumns({"valid_from": F.lit(day), "valid_to": F.lit(None).cast("date"), "is_current": F.lit(True)})
    return old.select(*table.columns).unionByName(opened.select(*table.columns))


def as_of(table: DataFrame, day: Column | datetime.date) -> DataFrame:
    """The rows that were valid on a day."""
    d = F.lit(day)
    return table.where((F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (d < F.col("valid_to"))))


def as_of_join(facts: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str = "valid_from", days: int = 30) -> DataFrame:
    """facts, each with the columns of its key's last version whose `since` is not after the fact's day `at`; nulls without one.

    Facts and versions are one sorted union through which the last version is carried forward. It is dealt by key and
    range of so many days, so a key of very many facts is spread over its days; what is valid when a range begins is
    found from the ranges' last versions and goes in as a row of its own. Of a key's versions there is one a day at most
    (facts of a null key or day have none). Columns of versions may not be named as other columns of facts.
    """
    rest = [c for c in versions.columns if c not in keys]
    range_of = lambda day: F.floor(F.unix_date(F.col(day)) / days).alias("_range")
    version = F.struct(*[F.col(c) for c in rest])
    known = versions.select(*keys, range_of(since), F.col(since).alias("_at"), F.lit(0).alias("_fact"), version.alias("_version"), F.lit(None).cast(facts.select(F.struct("*")).schema[0].dataType).alias("_row"))
    asked = facts.select(*keys, range_of(at), F.col(at).alias("_at"), F.lit(1).alias("_fact"), F.lit(None).cast(versions.select(version).schema[0].dataType).alias("_version"), F.struct("*").alias("_row"))
    lasts = known.groupBy(*keys, "_range").agg(F.max_by("_version", "_at").alias("_version"))
    ranges = lasts.unionByName(asked.select(*keys, "_range").distinct(), allowMissingColumns=True).groupBy(*keys, "_range").agg(F.max_by("_version", F.col("_version").isNotNull()).alias("_version"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each key and range
    carried = ranges.withColumn("_version", F.last("_version", True).over(before)).where("_version IS NOT NULL").withColumns({"_at": F.lit(None).cast("date"), "_fact": F.lit(0)})
    every = known.unionByName(asked).unionByName(carried, allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_range").orderBy(F.asc_nulls_first("_at"), "_fact").rowsBetween(Window.unboundedPreceding, 0)
    filled = every.withColumn("_version", F.last("_version", True).over(order)).where("_fact = 1")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return filled.withColumn("_version", F.when(whole & F.col("_at").isNotNull(), F.col("_version"))).select("_row.*", *[F.col("_version")[c].alias(c) for c in rest])


def require_one_current(table: DataFrame, keys: list[str]) -> None:
    twice = table.where("is_current").groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise DataContractError(f"more than one current row: {twice[0].asDict()}")
