"""Counters and rates over datasets, benchmark results, pair checks and generated batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("equivalent", "generated_implies_reference", "reference_implies_generated", "no_relationship")


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def given(name: str) -> Column:
    return F.coalesce(F.length(name) > 0, F.lit(False))


def model_metrics(results: DataFrame) -> DataFrame:
    """A row a model: a counter for each relationship, anything else as an error; average times; rates."""
    r, n = F.col("relationship"), F.count(F.lit(1))
    counts = results.groupBy("model_name").agg(
        n.alias("total_items"),
        F.count_if(r == "equivalent").alias("equivalent_count"),
        F.count_if(r == "generated_implies_reference").alias("generated_implies_reference_count"),
        F.count_if(r == "reference_implies_generated").alias("reference_implies_generated_count"),
        F.count_if(r == "no_relationship").alias("no_relationship_count"),
        F.count_if(r.isNull() | ~r.isin(*LABELS)).alias("error_count"),
        F.coalesce(F.round(F.avg("generation_time"), 6), F.lit(0.0)).alias("avg_generation_time"),
        F.coalesce(F.round(F.avg("verification_time"), 6), F.lit(0.0)).alias("avg_verification_time"),
    )
    any_way = F.col("equivalent_count") + F.col("generated_implies_reference_count") + F.col("reference_implies_generated_count")
    total = F.col("total_items")
    return counts.withColumns({"equivalent_rate": rate(F.col("equivalent_count"), total), "any_implication_rate": rate(any_way, total), "success_rate": rate(total - F.col("error_count"), total)})


def model_comparison(metrics: DataFrame, order: str = "model_name") -> DataFrame:
    """One row over model_metrics: parallel arrays in `order`, the best rates, and the first model that has each; no row without models."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "model_name", "equivalent_rate", "any_implication_rate", "success_rate", "avg_generation_time")))
    base = metrics.agg(rows.alias("m")).where(F.size("m") > 0)  # a row a model

    def best(c: str) -> tuple[Column, Column]:
        top = F.array_max(F.col(f"m.{c}"))
        return top, F.get(F.filter("m", lambda x: x[c] == top), 0)["model_name"]

    (er, em), (ir, im) = best("equivalent_rate"), best("any_implication_rate")
    return base.select(
        F.col("m.model_name").alias("models"),
        F.col("m.equivalent_rate").alias("equivalent_rates"),
        F.col("m.any_implication_rate").alias("any_implication_rates"),
        F.col("m.success_rate").alias("success_rates"),
        F.col("m.avg_generation_time").alias("avg_generation_times"),
        er.alias("best_equivalent_rate"),
        em.alias("best_equivalent_model"),
        ir.alias("best_any_implication_rate"),
        im.alias("best_implication_model"),
    )


def relationship(forward: Column, backward: Column, error: Column | None = None) -> Column:
    """The label of two implication results; null in either, or an error, gives error."""
    bad = forward.isNull() | backward.isNull()
    if error is not None:
        bad = bad | error.isNotNull()
    return F.when(bad, "error").when(forward & backward, LABELS[0]).when(forward, LABELS[1]).when(backward, LABELS[2]).otherwise(LABELS[3])


def dataset_report(entries: DataFrame) -> DataFrame:
    """One row: entries, those with a description, an explanation, an error of either, and coverages."""
    errors = F.col("metadata").isNotNull() & (F.map_contains_key("metadata", "svad_error") | F.map_contains_key("metadata", "cot_error"))
    out = entries.agg(F.count(F.lit(1)).alias("total"), F.count_if(given("SVAD")).alias("with_svad"), F.count_if(given("CoT")).alias("with_cot"), F.count_if(errors).alias("with_errors"))
    return out.withColumns({"svad_coverage": rate(F.col("with_svad"), F.col("total")), "cot_coverage": rate(F.col("with_cot"), F.col("total"))})


def dataset_stats(entries: DataFrame) -> DataFrame:
    """One row: how many entries have each part, and percentages."""
    sva, svad = given("SVA"), given("SVAD")
    out = entries.agg(F.count(F.lit(1)).alias("total"), F.count_if(sva).alias("has_sva"), F.count_if(svad).alias("has_svad"), F.count_if(sva & svad).alias("has_both"), F.count_if(given("CoT")).alias("has_cot"))
    return out.withColumns({f"pct_{c[4:]}": rate(F.col(c) * 100, F.col("total")) for c in ("has_sva", "has_svad", "has_both", "has_cot")})


def good_entries(entries: DataFrame, least: int = 50) -> DataFrame:
    """Entries without an error, with a description of `least` characters or more, and with an explanation."""
    errors = F.col("metadata").isNotNull() & (F.map_contains_key("metadata", "svad_error") | F.map_contains_key("metadata", "cot_error"))
    return entries.where(~errors & (F.coalesce(F.length("SVAD"), F.lit(0)) >= least) & given("CoT"))


def pair_summary(checks: DataFrame, result: str = "result") -> DataFrame:
    """One row over pair checks: equivalent, not, errors, timeouts, one-way implications. Syntax errors are in the total alone."""
    r = F.col(result)
    out = checks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(r == "equivalent").alias("equivalent"),
        F.count_if(r == "not_implies").alias("not_equivalent"),
        F.count_if(r == "error").alias("errors"),
        F.count_if(r == "timeout").alias("timeouts"),
        F.count_if(F.col("forward") & ~F.col("backward")).alias("forward_only"),
        F.count_if(~F.col("forward") & F.col("backward")).alias("backward_only"),
    )
    return out.withColumn("equivalent_pct", rate(F.col("equivalent") * 100, F.col("total")))


def cross_validation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, result_a, result_b, aligned): the first engine's results with the second's where it ran; aligned is false where it didn't."""
    out = a.select("id", F.col("result").alias("result_a")).join(b.select("id", F.col("result").alias("result_b")), "id", "left")
    return out.withColumn("aligned", F.coalesce(F.col("result_a") == F.col("result_b"), F.lit(False)))


def mismatches(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("result_b").isNotNull() & ~F.col("aligned"))


def cross_validation_summary(entries: DataFrame) -> DataFrame:
    """One row over cross_validation: aligned, mismatched, skipped, and each engine's results as a map of counts."""

    def counts(c: str) -> DataFrame:
        by = entries.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"{c}_counts"))

    ran = F.col("result_b").isNotNull()
    totals = entries.agg(F.count(F.lit(1)).alias("total"), F.count_if("aligned").alias("aligned"), F.count_if(ran & ~F.col("aligned")).alias("mismatched"), F.count_if(~ran).alias("skipped"))
    return totals.crossJoin(counts("result_a")).crossJoin(counts("result_b"))


def mcnemar(results: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the 2x2 table of two models' equivalent items, paired by item_idx, and the exact two-sided p-value."""
    hit = (F.col("relationship") == "equivalent").alias("hit")
    x = results.where(F.col("model_name") == a).select("item_idx", hit)
    y = results.where(F.col("model_name") == b).select("item_idx", hit.alias("other"))
    out = x.join(y, "item_idx").agg(
        F.count_if(F.col("hit") & F.col("other")).alias("both"),
        F.count_if(F.col("hit") & ~F.col("other")).alias("only_a"),
        F.count_if(~F.col("hit") & F.col("other")).alias("only_b"),
        F.count_if(~F.col("hit") & ~F.col("other")).alias("neither"),
    )
    return out.withColumn("p_value", _sign_test(F.col("only_a"), F.col("only_b")))


def _sign_test(b: Column, c: Column) -> Column:
    """min(1, 2 P[X <= min(b, c)]) of a fair binomial over b + c: its terms summed for up to 1,000 in all, beyond that the normal law with continuity correction."""
    n, k = b + c, F.least(b, c)

    def step(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1).cast("double") / i)
        return F.struct(term.alias("t"), (acc["s"] + F.exp(term)).alias("s"))

    few = n <= 1000
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    exact = F.aggregate(F.when(few & (k > 0), F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, step)["s"]
    x = F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double") / F.sqrt(F.greatest(n, F.lit(1)).cast("double")) / F.sqrt(F.lit(2.0))
    # the complementary error function by Abramowitz and Stegun 7.1.26
    t, poly = 1 / (1 + 0.3275911 * x), F.lit(0.0)
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = t * (a + poly)
    tail = F.least(F.lit(1.0), poly * F.exp(-x * x))
    return F.round(F.when(n == 0, F.lit(1.0)).when(few, F.least(F.lit(1.0), 2 * exact)).otherwise(tail), 6)


def explanation_score(text: Column) -> Column:
    """The mean of four tests: a heading, a code block, all five steps, and 200 characters or more."""
    steps = F.lit(True)
    for i in range(1, 6):
        steps = steps & F.contains(text, F.lit(f"Step {i}"))
    tests = F.array(F.contains(text, F.lit("# ")), F.contains(text, F.lit("```systemverilog")), steps, F.length(text) >= 200)
    return F.aggregate(tests, F.lit(0.0), lambda a, t: a + F.when(t, 0.25).otherwise(0.0))


def batch_tally(generated: DataFrame) -> DataFrame:
    """One row over (batch, is_valid): batches with any valid property, as a stress test counts them, and the honest share of properties."""
    by = generated.groupBy("batch").agg(F.bool_or("is_valid").alias("ok"), F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("valid"))
    out = by.agg(F.count(F.lit(1)).alias("batches"), F.count_if("ok").alias("valid_batches"), F.sum("n").alias("properties"), F.sum("valid").alias("valid_properties"))
    return out.withColumn("property_rate", rate(F.col("valid_properties"), F.col("properties")))


def health_summary(checks: DataFrame) -> DataFrame:
    """One row over (name, ok): endpoints that answered and those that didn't."""
    return checks.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"))
