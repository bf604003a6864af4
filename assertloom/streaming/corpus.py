"""Assertions as they arrive: parsed without state, first of each key within a watermark, and coverage by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assertloom.functions.parse import with_parsed
from assertloom.functions.text import clean
from assertloom.operators.coverage import construct_counts


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of (ts, sva) from JSON Lines files that are added to a folder."""
    return spark.readStream.schema("ts TIMESTAMP, sva STRING").option("maxFilesPerTrigger", files_per_batch).json(path)


def parsed(stream: DataFrame) -> DataFrame:
    """stream with `parsed`; nothing is kept between batches."""
    return with_parsed(stream)


def first_of_each(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first row of each cleaned assertion, as long as the watermark remembers it."""
    return stream.withWatermark("ts", delay).withColumn("key", F.md5(clean(F.col("sva")))).dropDuplicatesWithinWatermark(["key"])


def coverage(stream: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, construct, properties, occurrences) of each time window; rows later than the watermark are left out."""
    rows = stream.withWatermark("ts", delay).select("ts", F.explode(construct_counts(F.col("sva"))).alias("construct", "n"))
    out = rows.groupBy(F.window("ts", window).alias("w"), "construct").agg(F.count(F.lit(1)).alias("properties"), F.sum("n").alias("occurrences"))
    return out.select(F.col("w.start").alias("start"), "construct", "properties", "occurrences")
