"""Every query of the assertion side by name, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assertloom.functions import cot, describe, parse, text
from assertloom.operators import cache, coverage, quality, setops, synthesis, traces, verification
from assertloom.plans import oracle, pipelines
from assertloom.plans.corpus import ASSERTIONS, CHECKS, ENTRIES, LOGS, RESULTS, derived, table
from assertloom.services.models import Echo
from assertloom.session import spread
from assertloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ASSERTIONS)


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus dealt out evenly, for what costs far more than moving two numbers a row."""
    return derived(spark, sf_dir, ASSERTIONS, lambda orders: spread(orders.select("o_orderkey", "o_custkey")))


def _of_corpus(*columns: Callable[[], Column | str]) -> Query:
    return lambda spark, sf_dir: corpus(spark, sf_dir).select("prop_id", *[c() for c in columns])


def _of_parsed(*fields: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parse.parsed_columns(_dealt(spark, sf_dir)).select("prop_id", *[_shown(f).alias(f) for f in fields])

    return run


def _shown(field: str) -> Column:
    """A parsed field; arrays as text, so that any engine prints them alike."""
    c = F.col(field)
    if field == "signals":
        c = F.transform(c, lambda s: F.concat_ws(":", s["name"], s["is_clock"].cast("string"), s["is_reset"].cast("string")))
    elif field == "builtin_functions":
        c = F.transform(c, lambda f: F.concat(f["name"], F.lit("("), F.array_join(f["arguments"], "|"), F.lit(")")))
    elif field == "delays":
        c = F.transform(c, lambda d: F.concat(d["min"].cast("string"), F.lit("-"), F.when(d["unbounded"], "$").otherwise(d["max"].cast("string"))))
    elif field != "temporal_operators":
        return c
    return F.array_join(c, ",")


def _covered(then: Callable[[DataFrame], DataFrame] = lambda c: c) -> Query:
    return lambda spark, sf_dir: then(coverage.coverage_by_construct(corpus(spark, sf_dir)))


def _construct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("prop_id", F.explode(coverage.construct_counts(F.col("sva"))).alias("construct", "occurrences"))


def _normal(*columns: Callable[[], Column]) -> Query:
    return lambda spark, sf_dir: corpus(spark, sf_dir).withColumn("body", text.normalized(F.col("sva"))).select("prop_id", *[c() for c in columns])


def _past(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("prop_id", F.inline(text.past_depths(F.col("sva"))))


def _file_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prop_id"), "o_custkey")
    rows = F.array_sort(F.collect_list(F.struct("prop_id", "sva")))
    whole = corpus(spark, sf_dir).join(owners, "prop_id").groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda r: r["sva"]), "\n").alias("text"))
    return files.properties_of(whole.select(F.concat(F.lit("file_"), F.col("o_custkey").cast("string"), F.lit(".sv")).alias("path"), "text"))


def _syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, and the corpus with brackets damaged."""
    base = corpus(spark, sf_dir)
    damaged = F.col("sva")
    for a, b in (("(valid", "valid"), ("ack)", "ack]"), ("(a", "a)(")):
        damaged = F.replace(damaged, F.lit(a), F.lit(b))
    both = base.unionByName(base.select((-F.col("prop_id")).alias("prop_id"), damaged.alias("sva")))
    return both.select("prop_id", text.syntax_check(F.col("sva")).alias("c")).select("prop_id", "c.*")


def _delay_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    kind = F.col("p_size") % 4
    spec = F.when(kind == 0, F.concat(F.lit("##"), size)).when(kind == 1, F.concat(F.lit("##["), size, F.lit(":"), (F.col("p_size") + 3).cast("string"), F.lit("]")))
    spec = spec.when(kind == 2, F.concat(F.lit("##["), size, F.lit(":$]"))).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.delay_spec(spec).alias("d")).select("p_partkey", "d.*")


def _logs(*columns: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: derived(spark, sf_dir, LOGS).select("event_id", *[c(F.col("log")) for c in columns])


def _key() -> Column:
    return text.entry_key(F.col("sva"), F.lit("m1"))


def _items_and_cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All items, and a cache that a run over the property blocks has left."""
    items = corpus(spark, sf_dir)
    kept = items.where(F.col("sva").startswith("property")).select(_key().alias("key"), F.concat(F.lit("done:"), text.clean(F.col("sva"))).alias("payload"))
    return items.select("prop_id", _key().alias("key")), kept.groupBy("key").agg(F.min("payload").alias("payload"))


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    return setops.merge([docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), "text")], key="text")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    failure = F.when(F.col("failure").isNotNull(), F.create_map("failure", F.lit("failed")))
    return derived(spark, sf_dir, ENTRIES).withColumn("metadata", failure).drop("failure")


def _of_entries(then: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: then(entries(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.model_metrics(derived(spark, sf_dir, RESULTS))


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = F.transform("equivalent_rates", lambda x: F.round(x, 6).cast("string"))
    out = quality.model_comparison(_metrics(spark, sf_dir)).withColumns({"models": F.array_join("models", ","), "equivalent_rates": F.array_join(rates, ",")})
    return out.drop("any_implication_rates", "success_rates", "avg_generation_times")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CHECKS)


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both engines' results come from one table, whose second result is null where the second engine didn't run."""
    checks = _checks(spark, sf_dir)
    return quality.cross_validation(checks.select("id", "result"), checks.where("other IS NOT NULL").select("id", F.col("other").alias("result")))


def _cross_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return quality.cross_validation_summary(_cross(spark, sf_dir)).withColumns({c: shown(c) for c in ("result_a_counts", "result_b_counts")})


def _mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("o_custkey") % 6 < 3, "equivalent").otherwise("error")
    b = F.when((F.col("o_orderkey") + F.col("o_custkey")) % 5 < 2, "equivalent").otherwise("no_relationship")
    rows = F.array(*[F.struct(F.lit(m).alias("model_name"), r.alias("relationship")) for m, r in (("model_a", a), ("model_b", b))])
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_idx"), F.inline(rows))
    return quality.mcnemar(results, "model_a", "model_b")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.batch_tally(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), (F.col("l_returnflag") != "R").alias("is_valid")))


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.health_summary(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") >= 0).alias("ok")))


def _work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = spark.createDataFrame([(f"model_{i}",) for i in range(3)], "model_name string")  # a handful of names, whatever the corpus
    items = table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(models))
    return items.select("model_name", "item_id", text.item_key(F.col("text"), F.col("text"), F.col("model_name")).alias("key"))


def _explained(part: Callable[[parse.Fields, Column], Column], name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parse.parsed_columns(_dealt(spark, sf_dir)).select("prop_id", part(parse.Fields(F.col("sva")), F.col("sva")).alias(name))

    return run


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("sig_"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.declaration(name, F.col("p_size")).alias("text"))


def _text_of(c: Column) -> Column:
    return F.array_join(c, ",")


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.sampled_values(table(spark, sf_dir, "events"))


def _described(style: str) -> Query:
    return lambda spark, sf_dir: describe.described(_dealt(spark, sf_dir), style=style).select("prop_id", "description")


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


def _random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.synthesize(_ids(spark, sf_dir))


def _window(low: Column | int) -> Column:
    return F.concat(F.lit("req |-> ##[1:"), (1 + low % 5).cast("string"), F.lit("] ack"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of windows of 1 to 5 cycles: the narrower implies the wider."""
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _window(F.col("o_custkey")).alias("sva1"), _window(F.col("o_orderkey")).alias("sva2"))
    return verification.check_pairs(pairs).select("id", "sva1", "sva2", "forward", "backward", "result", "relationship")


def _late_window(low: Column) -> Column:
    return F.concat(F.lit("req |-> ##[1:"), (9 + low % 12).cast("string"), F.lit("] ack"))


def _late_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of windows of 9 to 20 cycles, up to the bound of the built-in checker."""
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _late_window(F.col("o_custkey")).alias("sva1"), _late_window(F.col("o_orderkey")).alias("sva2"))
    return verification.check_pairs(pairs).select("id", "sva1", "sva2", "forward", "backward", "result", "relationship")


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus(spark, sf_dir).select(F.col("prop_id").alias("pos"), F.col("sva").alias("SVA"))
    return pipelines.enrich(lines, Echo(), with_steps=False).select("pos", "SVA", "SVAD")


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_idx"), _window(F.col("p_size")).alias("SVAD"), _window(F.col("p_partkey")).alias("SVA"))
    return quality.model_metrics(pipelines.evaluate(items, [Echo("m1"), Echo("m2")])).drop("avg_generation_time", "avg_verification_time")


QUERIES: dict[str, Query] = {
    "coverage_by_construct": _covered(),
    "coverage_summary": _covered(coverage.coverage_summary),
    "coverage_missing": _covered(coverage.coverage_missing),
    "coverage_by_category": _covered(coverage.coverage_by_category),
    "coverage_topn_per_category": _covered(lambda c: coverage.coverage_top(c, 3)),
    "construct_ranking": _covered(coverage.construct_ranking),
    "coverage_by_prefix_size": lambda spark, sf_dir: coverage.coverage_by_size(corpus(spark, sf_dir), [100, 500, 1000, 5000, 10000]),
    "construct_counts": _construct_counts,
    "parse_body": _of_corpus(lambda: parse.body(F.col("sva")).alias("body")),
    "parse_name": _of_parsed("property_name"),
    "parse_kind": _of_parsed("is_assertion", "is_assumption", "is_cover"),
    "parse_clock": _of_parsed("clock_signal", "clock_edge"),
    "parse_disable": _of_parsed("disable_condition", "reset_signal", "reset_active_low"),
    "parse_implication": _of_parsed("implication_type", "antecedent", "consequent"),
    "parse_delays": _of_parsed("delays"),
    "parse_temporal_ops": _of_parsed("temporal_operators"),
    "parse_signals": _of_parsed("signals"),
    "parse_builtins": _of_parsed("builtin_functions"),
    "parse_full": _of_parsed(*parse.FIELDS),
    "file_properties": _file_properties,
    "normalize": _normal(lambda: F.col("body")),
    "clock_spec": lambda spark, sf_dir: corpus(spark, sf_dir).select("prop_id", text.clock_spec(F.col("sva")).alias("c")).select("prop_id", "c.*"),
    "checker_signals": _normal(lambda: _text_of(text.checker_signals(F.col("body"))).alias("checker"), lambda: _text_of(text.formal_signals(F.col("body"))).alias("formal")),
    "past_depth": _past,
    "unsupported_functions": _of_corpus(lambda: _text_of(text.unsupported_functions(F.col("sva"))).alias("functions"), lambda: text.has_if_else(F.col("sva")).alias("has_if_else")),
    "clean": lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("text")),
    "markdown_extract": _of_corpus(lambda: text.fenced(F.col("sva")).alias("code")),
    "wrap_module": _of_corpus(lambda: text.in_module(F.col("sva")).alias("text")),
    "syntax_check": _syntax,
    "delay_spec": _delay_spec,
    "declaration": _declared,
    "prover_log_category": lambda spark, sf_dir: derived(spark, sf_dir, LOGS).select("event_id", text.log_category(F.col("log")).alias("c")).select("event_id", "c.*"),
    "error_detail": _logs(lambda c: text.error_detail(c).alias("detail")),
    "counterexample": _logs(lambda c: text.counterexample(c).alias("trace")),
    "formal_report": lambda spark, sf_dir: derived(spark, sf_dir, LOGS).select("event_id", text.formal_report(F.col("log")).alias("r")).select("event_id", "r.*"),
    "entry_hash": _of_corpus(lambda: _key().alias("key")),
    "cache_pending": lambda spark, sf_dir: cache.pending(*_items_and_cache(spark, sf_dir)),
    "cache_hits": lambda spark, sf_dir: cache.hits(*_items_and_cache(spark, sf_dir)),
    "cache_stats": lambda spark, sf_dir: cache.stats(_items_and_cache(spark, sf_dir)[1]),
    "merge_dedup": _merge,
    "split_80_10_10": lambda spark, sf_dir: setops.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"),
    "dataset_validate": _of_entries(quality.dataset_report),
    "dataset_stats": _of_entries(quality.dataset_stats),
    "quality_filter": _of_entries(lambda e: quality.good_entries(e).select("pos", "SVA", "SVAD", "CoT")),
    "benchmarkable": _of_entries(lambda e: files.benchmarkable(e).select("pos", "SVA", "SVAD")),
    "entries_as_json": _of_entries(files.as_json),
    "chat_samples": _of_entries(files.chat_samples),
    "length_buckets": lambda spark, sf_dir: coverage.length_metrics(table(spark, sf_dir, "documents")),
    "model_metrics": _metrics,
    "model_compare": _compare,
    "pair_summary": lambda spark, sf_dir: quality.pair_summary(_checks(spark, sf_dir)),
    "relationship_labels": lambda spark, sf_dir: _checks(spark, sf_dir).select("id", quality.relationship(F.col("forward"), F.col("backward"), F.when(F.col("result") == "error", F.col("result"))).alias("relationship")),
    "cross_validation": _cross,
    "cross_validation_mismatches": lambda spark, sf_dir: quality.mismatches(_cross(spark, sf_dir)),
    "cross_validation_summary": _cross_summary,
    "mcnemar_table": _mcnemar,
    "batch_tally": _batches,
    "health_summary": _health,
    "work_items": _work_items,
    "explanation_score": lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", quality.explanation_score(F.col("text")).alias("score")),
    "signal_info": _explained(lambda p, _: text.signal_info(p), "info"),
    "cot_header": _explained(lambda p, _: cot.header(p), "content"),
    "cot_assembly": _explained(lambda p, _: cot.assembly(p), "content"),
    "cot": _explained(cot.explanation, "cot"),
    "trace_sampled_values": _traces,
    "describe_symbolic": _described("symbolic"),
    "describe_natural": _described("natural"),
    "without_comments": _of_corpus(lambda: text.without_comments(F.col("sva")).alias("text")),
    "reply_code": _of_corpus(lambda: text.reply_code(F.col("sva")).alias("code")),
    "synth_random": _random,
    "synth_stratified": lambda spark, sf_dir: synthesis.stratified(spark),
    "synth_nodes": lambda spark, sf_dir: synthesis.random_nodes(_ids(spark, sf_dir)),
    "implication_pairs": _pairs,
    "implication_pairs_late": _late_pairs,
    "enrich": _enriched,
    "evaluate": _evaluated,
}


def queries() -> dict[str, Query]:
    """Every query by name; each takes (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every query that SQL can express."""
    return dict(oracle.SQL)
