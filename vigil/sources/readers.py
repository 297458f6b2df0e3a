"""CSV sources, batch and streaming, and the columns that every ingested row carries."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.sources import schemas


def delimited(spark: SparkSession, path: str, schema: str, header: bool = True, multiline: bool = False) -> DataFrame:
    """A CSV file by explicit schema; quotes are doubled inside quotes, and multiline fields may hold line breaks."""
    return spark.read.schema(schema).options(header=header, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE").csv(path)


def headerless_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return quoted_records(spark, path, schema)


def quoted_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headerless CSV whose quoted fields may hold line breaks, with each file read in byte ranges by many tasks.

    Lines are read as text, in ranges. A line begins a record if the quotes before it in its file are even in number
    (doubled quotes keep them so): quotes are summed up by range, ranges by prefix sums, lines within their range.
    A record of one line is parsed as it is; the lines of longer ones meet by file and the record's number. A carriage
    return before a line break that ends a record is dropped. Empty lines outside quotes are no records.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.withColumn("odd", (F.length("value") - F.length(F.translate("value", '"', ""))) % 2)
    within = Window.partitionBy("file", "block").orderBy("line")
    lines = lines.withColumn("seen", F.sum("odd").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "block", F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("before"))  # a row a range
    lines = lines.join(ranges, ["file", "block"]).withColumn("open", (F.coalesce("seen", F.lit(0)) + F.col("before")) % 2 == 1)
    alone = lines.where("NOT open AND odd = 0").select(F.col("value").alias("record"))
    parts = lines.where("open OR odd = 1").withColumn("starts", F.when(F.col("open"), 0).otherwise(1))
    starts = parts.groupBy("file", "block").agg(F.sum("starts").alias("starts"))
    starts = starts.select("file", "block", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("before_starts"))
    parts = parts.join(starts, ["file", "block"]).withColumn("record", F.col("before_starts") + F.sum("starts").over(within))
    joined = parts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("lines"))
    records = alone.union(joined.select(F.array_join(F.transform("lines", lambda x: x["value"]), "\n"))).select(F.rtrim("record", F.lit("\r")).alias("record"))
    parsed = F.from_csv("record", F.lit(schema), {"quote": '"', "escape": '"', "multiLine": "true"})
    return records.where("record <> ''").select(parsed.alias("x")).select("x.*")


def feature_vectors(spark: SparkSession, path: str, n: int = schemas.N_FEATURES) -> DataFrame:
    """Wide rows to id, time_step and one array."""
    rows = delimited(spark, path, schemas.features(n), header=False)
    return rows.select("txId", "time_step", F.array(*[f"f{i}" for i in range(1, n + 1)]).alias("features"))


def transaction_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.TRANSACTIONS).option("header", True)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).csv(path)


def new_batch_id(now: datetime.datetime | None = None) -> str:
    """UTC to the second and a random tail: later batches sort later."""
    return f"{now or datetime.datetime.now(datetime.timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def stamp(df: DataFrame, batch_id: str, ingested_at: datetime.datetime, source: str, version: str = "1") -> DataFrame:
    return df.withColumns({"_batch_id": F.lit(batch_id), "_ingested_at": F.lit(ingested_at), "_source_file": F.lit(source), "_schema_version": F.lit(version)})
