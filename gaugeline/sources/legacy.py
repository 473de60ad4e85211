"""Tables of the first version: readings and its text buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_legacy(df: DataFrame) -> DataFrame:
    return df.select(F.col("time").cast("timestamp").alias("time"), F.col("tag").cast("string").alias("tag"), F.col("value").cast("decimal(38,9)").alias("value"), F.col("unit").cast("string").alias("unit"))


def append(readings: DataFrame, path: str) -> None:
    """Append to the readings table, one folder per day."""
    read_legacy(readings).withColumn("dt", F.to_date("time")).write.mode("append").partitionBy("dt").parquet(path)


def latest(readings: DataFrame, limit: int = 100) -> DataFrame:
    return readings.orderBy(F.desc("time"), "tag").limit(limit)


def replay_buffer(buffer: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending rows of the text buffer: parsed ones, those that cannot be parsed, and the ids to mark as done. A row
    that cannot be parsed is marked too, so it never blocks the others."""
    rows = buffer.filter("synced = 0").orderBy("id").limit(limit)
    parsed = rows.withColumn("_t", F.try_to_timestamp("timestamp")).withColumn("_v", F.expr("try_cast(value AS decimal(38,9))"))
    good = F.col("_t").isNotNull() & F.col("_v").isNotNull()
    ok = parsed.filter(good).select("id", F.col("_t").alias("time"), "tag", F.col("_v").alias("value"), "unit")
    return ok, parsed.filter(~good).drop("_t", "_v"), rows.select("id")
