"""Connected components by large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertloom.session import release, written


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a")).distinct()
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of `edges` (two columns of one type that has an order, undirected) with the least node of its component.

    Alternates the two star operations until a round changes nothing; the rounds grow with the logarithm of a component's size. Null ends
    and loops are dropped; repeated edges count once; no edges give no rows.
    """
    now = written(edges.toDF("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        after = written(_small(_large(now)), "edges")
        release(now)
        now, last, state = after, state, _state(after)
        if state == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") / 2**32), F.lit(0.0)).cast("long"), F.bit_xor(F.xxhash64("a", "b"))).first())
