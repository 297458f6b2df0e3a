"""Validity splits with dead letters, data contracts, and schema drift."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataContractError(Exception):
    """A table doesn't keep to its contract."""


def split_valid(df: DataFrame, valid: Column, reason: Column | str = "invalid_key") -> tuple[DataFrame, DataFrame]:
    """(valid rows, the others with `_error_reason`); a null verdict counts as invalid."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("_error_reason", F.lit(reason) if isinstance(reason, str) else reason)


def digits(c: str) -> Column:
    return F.col(c).rlike(r"^\d+$")


def not_blank(c: str) -> Column:
    return F.trim(F.col(c)) != ""


def not_null(c: str) -> Column:
    return F.col(c).isNotNull()


def valid_transaction(finite_only: bool = False) -> Column:
    """Of raw string rows: whole-number ids that fit, a numeric value, a positive time; never null."""
    whole = lambda c: F.expr(f"try_cast({c} AS INT)").isNotNull() & digits(c)
    value = F.expr("try_cast(value AS DOUBLE)")
    number = value.isNotNull() & (~F.isnan(value) & (F.abs(value) < float("inf")) if finite_only else F.lit(True))
    return F.coalesce(whole("sourceNodeId") & whole("targetNodeId") & number & (F.expr("try_cast(time AS INT)") > 0), F.lit(False))


def transaction_error() -> Column:
    """The first rule that a raw transaction breaks."""
    return (
        F.when(~F.coalesce(digits("sourceNodeId"), F.lit(False)), "bad_source")
        .when(~F.coalesce(digits("targetNodeId"), F.lit(False)), "missing_target")
        .when(F.expr("try_cast(value AS DOUBLE)").isNull(), "bad_value")
        .otherwise("bad_time")
    )


def require_columns(df: DataFrame, columns: set[str], name: str = "table") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise DataContractError(f"{name} lacks columns: {', '.join(missing)}")


def require_non_empty(df: DataFrame, name: str = "table") -> None:
    if df.isEmpty():
        raise DataContractError(f"{name} is empty")


def require_invalid_ratio_below(valid: int, invalid: int, most: float = 0.10) -> float:
    """The share of invalid rows; an empty batch, or a share above `most`, breaks the contract."""
    if valid + invalid == 0:
        raise DataContractError("the batch is empty")
    share = invalid / (valid + invalid)
    if share > most:
        raise DataContractError(f"{share:.1%} of the rows are invalid; at most {most:.1%} may be")
    return share


def is_permission_error(error: Exception) -> bool:
    return any(x in str(error).lower() for x in ("permission", "privilege", "access denied", "unauthorized"))


def schema_fields(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema}


def schema_hash(fields: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps([f"{n}:{t}" for n, t in sorted(fields.items())]).encode()).hexdigest()


def schema_diff(old: dict[str, str], new: dict[str, str]) -> dict:
    """Added, removed and retyped columns; removing or retyping one breaks consumers."""
    retyped = sorted(c for c in old.keys() & new.keys() if old[c] != new[c])
    removed = sorted(old.keys() - new.keys())
    return {"added": sorted(new.keys() - old.keys()), "removed": removed, "type_changed": retyped, "is_breaking": bool(removed or retyped)}
