"""The sampled-value functions of the language on recorded traces: rows of one trace in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec, Window


def past(x: Column, n: int, w: WindowSpec) -> Column:
    """The value n rows ago; false before the first."""
    return F.coalesce(F.lag(x, n).over(w), F.lit(False))


def rose(x: Column, w: WindowSpec) -> Column:
    return x & ~past(x, 1, w)


def fell(x: Column, w: WindowSpec) -> Column:
    return ~x & past(x, 1, w)


def stable(x: Column, w: WindowSpec) -> Column:
    return x == past(x, 1, w)


def follows(trigger: Column, x: Column, low: int, high: int, w: WindowSpec) -> Column:
    """Whether `trigger |-> ##[low:high] x` holds in each row; a trace that ends too early counts as a failure."""
    within = F.coalesce(F.max(x.cast("int")).over(w.rowsBetween(low, high)), F.lit(0)) == 1
    return ~trigger | within


def sampled_values(events: DataFrame) -> DataFrame:
    """(user_id, event_id, rose, fell, stable, changed, past_2, purchase_then_high) of the bit value > 50, each user's events as a trace."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x, y = F.col("x"), F.col("y")
    bits = events.select("user_id", "event_id", "ts", (F.col("value") > 50).alias("x"), (F.col("event_type") == "purchase").alias("y"))
    return bits.select(
        "user_id",
        "event_id",
        rose(x, w).alias("rose"),
        fell(x, w).alias("fell"),
        stable(x, w).alias("stable"),
        (~stable(x, w)).alias("changed"),
        past(x, 2, w).alias("past_2"),
        follows(y, x, 1, 3, w).alias("purchase_then_high"),
    )
