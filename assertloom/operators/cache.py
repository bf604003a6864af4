"""Results kept by key, so that a run that is resumed calls no model or prover twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits(items: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """items that the cache has, with its payload; the item's own columns stand, its index above all. Of repeated keys the least payload counts."""
    return items.join(cache.groupBy(key).agg(F.min("payload").alias("payload")), key).withColumn("from_cache", F.lit(True))


def pending(items: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """items that the cache doesn't have; a null key is never had."""
    return items.join(cache.select(key), key, "left_anti")


def read(spark, path: str) -> DataFrame:
    """The cache at a path; empty where there is none yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "key string, payload string")
    return spark.read.schema("key string, payload string").parquet(path)


def append(results: DataFrame, path: str) -> None:
    """Adds results (key, payload) that are no failures, which have a null payload and so are tried again."""
    results.select("key", "payload").where("payload IS NOT NULL").write.mode("append").parquet(path)


def stats(cache: DataFrame) -> DataFrame:
    """One row: entries, and bytes of payload."""
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length("payload").cast("long")), F.lit(0)).alias("bytes"))


def clear(spark, path: str) -> None:
    spark.createDataFrame([], "key string, payload string").write.mode("overwrite").parquet(path)
