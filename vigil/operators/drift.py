"""Drift inside semi-structured values: which fields came, went or changed their type from one period to the next.

Texts are parsed once, to variants, whose schemas are merged on the map side; what is shuffled and compared is one schema
a period and group. Only these few texts reach Python, which lists their fields.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import ship

MALFORMED = "MALFORMED"
FIELDS = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("type", T.StringType())]))
_TOKEN = re.compile(r"`((?:[^`]|``)*)`|([A-Za-z_][\w ]*(?:\([\d,]+\))?)|([<>:,])")


def fields_of(schema: str) -> list[tuple[str, str]]:
    """Paths and types of a variant schema's leaves; `x.y` is a field of an object, `x[]` an array's element, `$` the value.

    Precisions of decimals are left out, and empty objects and arrays are leaves themselves. A name in quotes counts as
    it is, so a dot within a name isn't told from a dot between names.
    """
    tokens = [(m.group(1).replace("``", "`") if m.group(1) is not None else m.group(2) or m.group(3), m.group(3) is not None) for m in _TOKEN.finditer(schema)]
    out, at = [], 0

    def value(path: str) -> None:
        nonlocal at
        kind = tokens[at][0].strip()
        at += 1
        if kind not in ("OBJECT", "ARRAY") or at == len(tokens) or tokens[at] != ("<", True):
            out.append((path or "$", kind.partition("(")[0]))
            return
        at += 1
        if kind == "ARRAY":
            value(f"{path}[]")
        elif tokens[at] == (">", True):
            out.append((path or "$", "OBJECT"))
        else:
            while tokens[at] != (">", True):
                at += tokens[at] == (",", True)
                name = tokens[at][0]
                at += 2  # the name and its colon
                value(f"{path}.{name}" if path else name)
        at += 1

    value("")
    return out


@F.pandas_udf(FIELDS)
def _fields(schemas: pd.Series) -> pd.Series:
    return schemas.map(lambda s: [{"path": p, "type": t} for p, t in fields_of(s)])


def fields_by_period(df: DataFrame, text: str, period: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The fields of a column of JSON texts in each period: (by), period, path, type.

    Values of more than one type make the type VARIANT; fields that are null throughout are VOID. Texts that don't parse
    count as a field `$` of type MALFORMED beside the others; null texts count as nothing.
    """
    ship(df.sparkSession)
    rows = df.select(*by, period.alias("period"), F.try_parse_json(text).alias("v"), F.col(text).isNotNull().alias("there")).where("there")
    merged = rows.groupBy(*by, "period").agg(F.schema_of_variant_agg("v").alias("schema"), F.count_if(F.col("v").isNull()).alias("bad"), F.count("v").alias("good"))
    parsed = F.when(F.col("good") > 0, _fields("schema")).otherwise(F.array().cast(FIELDS))
    broken = F.when(F.col("bad") > 0, F.array(F.struct(F.lit("$").alias("path"), F.lit(MALFORMED).alias("type")))).otherwise(F.array().cast(FIELDS))
    return merged.select(*by, "period", F.explode(F.concat(parsed, broken)).alias("f")).select(*by, "period", "f.path", "f.type")


def _sided(side: str) -> Column:
    return F.transform(side, lambda x: F.struct(x["path"].alias("path"), x["type"].alias("type"), F.lit(side).alias("side"), (x["type"] == MALFORMED).alias("malformed")))


def drift_within(df: DataFrame, text: str, period: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """What changed from each period that has rows to the next: (by), period, path, change, old_type, new_type, is_breaking.

    Changes are added, removed and type_changed; the last two break consumers, and so do malformed texts that appear. A
    null type (VOID) changes to any other without notice. The first period has no changes. Null periods come first.
    """
    fields = fields_by_period(df, text, period, by)
    # One row a period and group from here on: the windows run over these.
    lists = fields.groupBy(*by, "period").agg(F.collect_list(F.struct("path", "type")).alias("new"))
    order = Window.partitionBy(*by).orderBy(F.col("period").asc_nulls_first())
    pairs = lists.withColumn("old", F.lag("new").over(order)).where("old IS NOT NULL")
    sides = pairs.select(*by, "period", F.explode(F.concat(_sided("old"), _sided("new"))).alias("f")).select(*by, "period", "f.*")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("type")))
    both = sides.groupBy(*by, "period", "path", "malformed").agg(of("old").alias("old_type"), of("new").alias("new_type"))
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when((F.col("old_type") != F.col("new_type")) & (F.col("old_type") != "VOID") & (F.col("new_type") != "VOID"), "type_changed")
    breaking = F.when(F.col("malformed"), F.col("change") == "added").otherwise(F.col("change") != "added")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*by, "period", "path", "change", "old_type", "new_type", breaking.alias("is_breaking"))
