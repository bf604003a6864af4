"""Merging, splitting and comparing datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assertloom.functions.text import clean


def merge(datasets: list[DataFrame], key: str = "SVA", order: str = "pos") -> DataFrame:
    """All rows of the datasets, the first of each cleaned key alone, and none with an empty key; rows stay as they were.

    First is by dataset, then by `order` in it. Only keys' first places are grouped, so a frequent key is no hot window.
    """
    tagged = [d.withColumn("_src", F.lit(i)) for i, d in enumerate(datasets)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).withColumn("_key", clean(F.col(key))).where("_key <> ''")
    columns = [c for c in every.columns if c not in ("_src", "_key")]
    return every.groupBy("_key").agg(F.min_by(F.struct(*columns), F.struct("_src", order)).alias("r")).select("r.*")


def split(dataset: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """dataset with a column `split`: exactly int(n train) rows of train, int(n val) of val, the rest test, in an order by md5 of key and seed.

    Ranks are counted within 256 hash buckets and added up, so no single task orders the whole.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), F.lit(str(seed))))
    data = dataset.withColumns({"_h": h, "_b": F.substring(h, 1, 2)})
    counts = data.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    placed = data.withColumn("_r", rank).join(F.broadcast(ahead), "_b").withColumn("_at", F.col("_ahead") + F.col("_r"))  # 256 rows at most
    first, second = F.floor(F.col("_all") * train), F.floor(F.col("_all") * val)
    name = F.when(F.col("_at") <= first, "train").when(F.col("_at") <= first + second, "val").otherwise("test")
    return placed.select(*dataset.columns, name.alias("split"))


def shuffled(dataset: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """dataset in an order by md5 of key and seed, the same on any cluster."""
    return dataset.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), F.lit(str(seed)))), key)


def hybrid(stratified: DataFrame, random: DataFrame) -> DataFrame:
    """Stratified and random properties together, each row with where it came from."""
    return stratified.withColumn("mode", F.lit("stratified")).unionByName(random.withColumn("mode", F.lit("random")), allowMissingColumns=True)
