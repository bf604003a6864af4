"""Whole runs over a corpus: enriching it, and evaluating models on it. Calls that cost are made once, in one stage, and kept by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertloom.functions.cot import explanation
from assertloom.functions.parse import with_parsed
from assertloom.functions.text import entry_key, item_key, prompt, reply_code, signal_info
from assertloom.operators import cache
from assertloom.operators.verification import check_pairs
from assertloom.services.models import SYSTEM, TO_CODE, TO_TEXT, TextModel
from assertloom.session import written
from assertloom.sources.files import benchmarkable, entries_of
from assertloom.verify.engines import Bounded, Engine


def asked(items: DataFrame, models: list[TextModel], system: str = SYSTEM, temperature: float | None = None) -> DataFrame:
    """items (key, model_name, prompt) answered: (key, payload, error, seconds). A failed call has a null payload and its error."""
    known = {m.name: m for m in models}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in batches:
            rows = []
            for key, name, text in zip(pdf["key"], pdf["model_name"], pdf["prompt"]):
                began = time.monotonic()
                try:
                    rows.append((key, known[name].generate(text, system, temperature), None, time.monotonic() - began))
                except Exception as e:  # kept with its row; the next run tries again
                    rows.append((key, None, f"{type(e).__name__}: {e}", time.monotonic() - began))
            yield pd.DataFrame(rows, columns=["key", "payload", "error", "seconds"])

    return items.select("key", "model_name", "prompt").mapInPandas(run, "key string, payload string, error string, seconds double")


def _resumed(items: DataFrame, store: str | None, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers by key: those in the cache at `store`, and fresh ones, which are written before anything reads them twice."""
    spark = items.sparkSession
    wanted = items.dropDuplicates(["key"])
    if store is None:
        return written(ask(wanted), "answers").withColumn("from_cache", F.lit(False))
    old = cache.read(spark, store).groupBy("key").agg(F.min("payload").alias("payload"))
    had = written(wanted.join(old, "key").select("key", "payload"), "hits")
    fresh = written(ask(cache.pending(wanted, old)), "answers")
    cache.append(fresh, store)
    none = had.select("key", "payload", F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("seconds"), F.lit(True).alias("from_cache"))
    return none.unionByName(fresh.withColumn("from_cache", F.lit(False)))


def enrich(lines: DataFrame, model: TextModel | None = None, with_steps: bool = True, store: str | None = None, temperature: float = 0.3) -> DataFrame:
    """(pos, SVA, SVAD, CoT, metadata) for every row of `lines` (pos, SVA or sva) with an assertion.

    SVAD is the model's description (null without a model), CoT the step-by-step explanation; a failed description is noted in metadata as
    svad_error. With `store`, a second run over the same assertions calls no model.
    """
    parsed = with_parsed(entries_of(lines).select("pos", "SVA"), "SVA", "parsed")
    steps = (explanation(F.col("parsed"), F.col("SVA")) if with_steps else F.lit(None).cast("string")).alias("CoT")
    if model is None:
        return parsed.select("pos", "SVA", F.lit(None).cast("string").alias("SVAD"), steps, F.lit(None).cast("map<string,string>").alias("metadata"))
    items = parsed.withColumns({"key": entry_key(F.col("SVA"), F.lit(model.name)), "model_name": F.lit(model.name), "prompt": prompt(TO_TEXT, signals=signal_info(F.col("parsed")), sva=F.col("SVA"))})
    answers = _resumed(items.select("key", "model_name", "prompt"), store, lambda x: asked(x, [model], temperature=temperature))
    noted = F.when(F.col("error").isNotNull(), F.create_map(F.lit("svad_error"), F.col("error")))
    return items.join(answers, "key").select("pos", "SVA", F.col("payload").alias("SVAD"), steps, noted.alias("metadata"))


def evaluate(items: DataFrame, models: list[TextModel], engine: Engine = Bounded(), store: str | None = None, temperature: float = 0.1) -> DataFrame:
    """A row for each model and item (item_idx, SVAD, SVA): the model's assertion, how it relates to the reference, and the times taken.

    Items with the same description and reference are asked about, read and checked once a model.
    """
    names = items.sparkSession.createDataFrame([(m.name,) for m in models], "model_name string")
    base = benchmarkable(items).select("item_idx", "SVAD", "SVA")
    different = base.select("SVAD", "SVA").distinct().crossJoin(F.broadcast(names))  # a row a model, whatever the items
    different = different.withColumns({"key": item_key(F.col("SVAD"), F.col("SVA"), F.col("model_name")), "prompt": prompt(TO_CODE, svad=F.col("SVAD"))})
    answers = _resumed(different.select("key", "model_name", "prompt"), store, lambda x: asked(x, models, temperature=temperature))
    told = different.drop("prompt").join(answers, "key").withColumn("generated_sva", reply_code(F.coalesce("payload", F.lit(""))))
    checked = check_pairs(written(told.drop("payload"), "replies"), engine, "generated_sva", "SVA")
    failed = F.col("error").isNotNull()
    return base.join(checked, ["SVAD", "SVA"]).select(
        "model_name",
        "item_idx",
        F.col("SVAD").alias("svad"),
        F.col("SVA").alias("reference_sva"),
        "generated_sva",
        F.when(failed, "error").otherwise(F.col("relationship")).alias("relationship"),
        F.when(failed, F.concat(F.lit("Generation error: "), "error")).when(F.col("relationship") == "error", F.concat(F.lit("Verification error: "), F.coalesce("forward_message", F.lit("")))).alias("error_message"),
        F.col("seconds").alias("generation_time"),
        "verification_time",
        "from_cache",
    )
