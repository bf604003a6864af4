"""Which language constructs a corpus has, how often, and which are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assertloom.functions.names import CONSTRUCTS

#: (construct, description, category, ord) in dictionary order.
TABLE = [(k, d, category, i) for i, (k, d, category) in enumerate((k, d, category) for category, items in CONSTRUCTS.items() for k, d in items.items())]


def constructs(spark) -> DataFrame:
    return spark.createDataFrame(TABLE, "construct string, description string, category string, ord int")


def occurrences(c: Column, text: str) -> Column:
    """How often `text` stands in the column, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))) / len(text)).cast("long")


def construct_counts(c: Column) -> Column:
    """map(construct, occurrences) of one text, with those that it has."""
    every = F.create_map(*[x for k, *_ in TABLE for x in (F.lit(k), occurrences(c, k))])
    return F.map_filter(every, lambda _, n: n > 0)


def coverage_by_construct(corpus: DataFrame, sva: str = "sva", by: list[str] | None = None) -> DataFrame:
    """(construct, description, category, ord, properties_with_construct, occurrences, total_properties, coverage_pct), 48 rows.

    One pass and no join: two sums a construct, partial on the map side, then unpivoted. Null texts count as properties without constructs;
    an empty corpus has all constructs at 0. With `by`, 48 rows for each group.
    """
    sums = [F.count(F.lit(1)).alias("total_properties")]
    for k, _, _, i in TABLE:
        n = occurrences(F.col(sva), k)
        sums += [F.coalesce(F.sum(n), F.lit(0)).alias(f"n{i}"), F.coalesce(F.sum((n > 0).cast("long")), F.lit(0)).alias(f"p{i}")]
    wide = corpus.groupBy(*(by or [])).agg(*sums)
    rows = F.array(*[F.struct(F.lit(k).alias("construct"), F.lit(d).alias("description"), F.lit(c).alias("category"), F.lit(i).alias("ord"), F.col(f"p{i}").alias("properties_with_construct"), F.col(f"n{i}").alias("occurrences")) for k, d, c, i in TABLE])
    out = wide.select(*(by or []), "total_properties", F.explode(rows).alias("r")).select(*(by or []), "r.*", "total_properties")
    return out.withColumn("coverage_pct", F.coalesce(F.try_divide(F.col("properties_with_construct") * 100.0, F.col("total_properties")), F.lit(0.0)))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """One row over coverage_by_construct: totals and the share of constructs that some property has."""
    has = (F.col("properties_with_construct") > 0).cast("long")
    return covered.agg(
        F.max("total_properties").alias("total_properties"),
        F.count(F.lit(1)).alias("constructs_total"),
        F.sum(has).alias("constructs_covered"),
        (F.sum(has) / F.count(F.lit(1)) * 100).alias("coverage_pct"),
    )


def coverage_missing(covered: DataFrame) -> DataFrame:
    """(construct, description, ord) of those that no property has: all constructs without the covered ones."""
    return constructs(covered.sparkSession).join(covered.where("properties_with_construct > 0").select("construct"), "construct", "left_anti").select("construct", "description", "ord")


def coverage_by_category(covered: DataFrame) -> DataFrame:
    """Constructs and occurrences by (category, construct), by category, and in all: three levels of one rollup."""
    out = covered.rollup("category", "construct").agg(F.sum("occurrences").alias("occurrences"), F.sum((F.col("properties_with_construct") > 0).cast("long")).alias("constructs_covered"), F.grouping_id().cast("long").alias("level"))
    return out.select("category", "construct", "level", "occurrences", "constructs_covered")


def coverage_top(covered: DataFrame, n: int) -> DataFrame:
    """The n constructs of each category with the highest coverage, first of the dictionary first among equals."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("coverage_pct"), "ord"))
    return covered.withColumn("rank", rank).where(F.col("rank") <= n).select("category", "construct", "coverage_pct", "rank")


def construct_ranking(covered: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent constructs of the corpus: a top-k report over 48 rows."""
    return covered.where("occurrences > 0").orderBy(F.desc("occurrences"), "ord").limit(n).select("construct", "occurrences", "coverage_pct", "ord")


def coverage_by_size(corpus: DataFrame, sizes: list[int], order: str = "prop_id", sva: str = "sva") -> DataFrame:
    """(size, constructs_covered): distinct constructs in the first `size` properties, for each size.

    A construct counts for every size from its first property's rank on, so one pass finds the 48 first ranks and the sizes join those.
    """
    # ranks matter up to the largest size only: the top of the order is found by partial sorts
    first = corpus.orderBy(order).limit(max(sizes)).withColumn("rank", F.row_number().over(Window.orderBy(order)))
    sums = [F.min(F.when(occurrences(F.col(sva), k) > 0, F.col("rank"))).alias(f"r{i}") for k, _, _, i in TABLE]
    ranks = first.agg(*sums).select(F.explode(F.array(*[f"r{i}" for *_, i in TABLE])).alias("rank"))
    wanted = corpus.sparkSession.createDataFrame([(s,) for s in sizes], "size int")
    return wanted.join(ranks, F.col("rank") <= F.col("size"), "left").groupBy("size").agg(F.count("rank").alias("constructs_covered"))


def length_metrics(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row: average and greatest characters and words, and texts of under 15, 15 to 29, and 30 or more words."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    base = texts.select(F.length(text).cast("long").alias("c"), words.cast("long").alias("w"))
    return base.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg("c"), 6).alias("avg_chars"),
        F.max("c").alias("max_chars"),
        F.round(F.avg("w"), 6).alias("avg_words"),
        F.max("w").alias("max_words"),
        F.count_if(F.col("w") < 15).alias("short"),
        F.count_if((F.col("w") >= 15) & (F.col("w") < 30)).alias("medium"),
        F.count_if(F.col("w") >= 30).alias("long"),
    )
