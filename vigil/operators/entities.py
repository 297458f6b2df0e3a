"""One table of entities, their aliases and addresses, from two kinds of lists."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.text import ascii_name, clean_sentinel, split_list

# Entity types by source and the source's own word, valid from 2026-01-01.
TYPE_MAP = (
    ("ofac", "individual", "person"),
    ("ofac", "vessel", "vessel"),
    ("ofac", "aircraft", "aircraft"),
    ("ofac", "", "organization"),
    ("opensanctions", "Person", "person"),
    ("opensanctions", "Organization", "organization"),
    ("opensanctions", "Vessel", "vessel"),
    ("opensanctions", "Airplane", "aircraft"),
)


def type_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, datetime.date(2026, 1, 1), None, True) for r in TYPE_MAP], "source_system string, source_value string, unified_value string, valid_from date, valid_to date, is_current boolean")


def latest_batch(df: DataFrame) -> DataFrame:
    """The rows of the greatest _batch_id."""
    return df.join(F.broadcast(df.agg(F.max("_batch_id").alias("_batch_id"))), "_batch_id", "left_semi")


def with_type(df: DataFrame, system: str, value, types: DataFrame) -> DataFrame:
    """df with entity_type from the current type map ('other' where there is none)."""
    now = types.where(F.col("is_current") & (F.col("source_system") == system)).select(F.col("source_value").alias("_v"), "unified_value")
    return df.withColumn("_v", value).join(F.broadcast(now), "_v", "left").withColumn("entity_type", F.coalesce("unified_value", F.lit("other"))).drop("_v", "unified_value")


def _entity(df: DataFrame, name, program, birth, countries) -> DataFrame:
    return df.select(
        F.sha2(F.concat("source_system", F.lit(":"), "source_entity_id"), 256).alias("entity_id"),
        "source_system", "source_entity_id", name.alias("primary_name"), "entity_type", program.alias("watchlist_program"),
        birth.alias("birth_date"), countries.alias("countries"), F.lit(True).alias("is_watchlist"),
    )


def unify(sdn: DataFrame, targets: DataFrame, types: DataFrame) -> DataFrame:
    """sdn: ent_num, sdn_name, sdn_type, program; targets: id, schema, name, birth_date, countries, program_ids, source_system."""
    clean = sdn.select(*[F.trim(c).alias(c) for c in ("ent_num", "sdn_name", "sdn_type", "program")])
    one = with_type(clean.withColumns({"source_system": F.lit("ofac"), "source_entity_id": F.col("ent_num")}), "ofac", F.coalesce(clean_sentinel(F.col("sdn_type")), F.lit("")), types)
    two = with_type(targets.withColumn("source_entity_id", F.col("id")), "opensanctions", F.col("schema"), types)
    none = F.lit(None)
    return _entity(one, clean_sentinel(F.col("sdn_name")), clean_sentinel(F.col("program")), none.cast("string"), none.cast("array<string>")).unionByName(
        _entity(two, F.col("name"), F.col("program_ids"), F.nullif(F.trim("birth_date"), F.lit("")), split_list(F.col("countries")))
    )


def aliases(entity_aliases: DataFrame) -> DataFrame:
    """entity_id, alias_name, alias_normalized from entity_id and a ;-list of aliases; blanks drop out."""
    one = entity_aliases.select("entity_id", F.explode(split_list(F.col("aliases"))).alias("alias_name"))
    return one.withColumn("alias_normalized", ascii_name(F.col("alias_name")))


def addresses(structured: DataFrame, free: DataFrame) -> DataFrame:
    """Structured rows with a line or a city, and free-text ;-lists, as entity_id, address_line, city, country."""
    one = structured.select("entity_id", *[clean_sentinel(F.col(c)).alias(c) for c in ("address_line", "city", "country")]).where("address_line IS NOT NULL OR city IS NOT NULL")
    two = free.select("entity_id", F.explode(split_list(F.col("addresses"))).alias("address_line"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("country"))
    return one.unionByName(two)


def standardize_transactions(rows: DataFrame) -> DataFrame:
    """source, target, amount, event_time to the transaction table; exact repeats collapse."""
    amount = F.format_string("%.4f", "amount")
    return rows.select(
        F.sha2(F.concat_ws("|", "source_account_id", "target_account_id", amount, F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256).alias("transaction_id"),
        "source_account_id", "target_account_id", "amount", F.lit("USD").alias("currency"), "event_time", F.to_date("event_time").alias("event_date"),
    ).distinct()
