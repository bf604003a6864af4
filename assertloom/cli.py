"""Commands over files: `python -m assertloom.cli GROUP COMMAND ...`. Tables go to stdout as JSON Lines, or to --out as a folder of them."""

from __future__ import annotations

import argparse
import json
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assertloom.functions import cot
from assertloom.functions.describe import described
from assertloom.functions.parse import with_parsed
from assertloom.grammar.synth import PRESETS
from assertloom.operators import cache, coverage, quality, synthesis
from assertloom.operators.verification import check_pairs
from assertloom.plans import pipelines
from assertloom.services.models import Echo, Server
from assertloom.session import build_session
from assertloom.sources import files
from assertloom.verify.bounded import BOUND
from assertloom.verify.engines import Bounded, Program, valid


def _text(spark: SparkSession, code: str) -> DataFrame:
    return spark.createDataFrame([(0, code)], "pos int, sva string")


def _engine(a: argparse.Namespace):
    return Program(a.prover, a.depth) if a.prover else Bounded(a.depth)


def _models(a: argparse.Namespace) -> list:
    """Models of a configuration file (base_url, model, key_variable), or the built-in one; keys come from the environment alone."""
    if not a.config_file:
        return [Server(a.base_url, a.model)] if a.base_url else [Echo()]
    with open(a.config_file, encoding="utf-8") as f:
        return [Server(m["base_url"], m["model"], m.get("key_variable", "TEXT_MODEL_KEY")) for m in json.load(f)]


def _valid(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: valid(x or "")[0])


def _pair(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return check_pairs(spark.createDataFrame([("pair", a.antecedent, a.consequent)], "id string, sva1 string, sva2 string"), _engine(a))


def _cross(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    pairs = files.read_pairs(spark, a.path)
    one, two = (check_pairs(pairs, e).select("id", "result") for e in (Program(a.prover or "ebmc", a.depth), Bounded(a.depth)))
    return quality.cross_validation(two, one)


def _synthesize(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    names = a.signals.split(",") if a.signals else PRESETS[a.preset]
    if a.mode == "stratified":
        return synthesis.stratified(spark, a.samples, a.seed, names, a.depth)
    return synthesis.synthesize(spark.range(a.number), a.seed, names, a.depth)


def _cover(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    covered = coverage.coverage_by_construct(files.read_generated(spark, a.path))
    return coverage.coverage_top(covered, a.top_n) if a.top_n else covered


def _stress(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    made = synthesis.synthesize(spark.range(a.number), a.seed, PRESETS[a.preset], a.depth, tries=1)
    return quality.batch_tally(made.select(F.floor(F.col("id") / 10).alias("batch"), "is_valid"))


def _checked(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    ok, message = valid(a.code)
    return spark.createDataFrame([(ok, message)], "is_valid boolean, message string")


def _cot(spark: SparkSession, rows: DataFrame, parts: bool = False) -> DataFrame:
    p = with_parsed(rows)
    return p.select("pos", F.inline(cot.sections(F.col("parsed"), F.col("sva")))) if parts else p.select("pos", cot.explanation(F.col("parsed"), F.col("sva")).alias("cot"))


def _of_file(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
    return files.properties_of(text).withColumn("pos", F.row_number().over(Window.orderBy("pass", "pos")) - 1)  # one file's


def _clear(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    before = cache.stats(cache.read(spark, a.path)).collect()
    cache.clear(spark, a.path)
    return spark.createDataFrame(before)


def _evaluated(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    items = files.read_dataset(spark, a.path).withColumnRenamed("pos", "item_idx")
    return pipelines.evaluate(items, _models(a), _engine(a), a.store)


COMMANDS = {
    ("ast", "parse"): (("code",), lambda s, a: with_parsed(_text(s, a.code))),
    ("ast", "parse-file"): (("path",), lambda s, a: with_parsed(_of_file(s, a.path))),
    ("ast", "signals"): (("code",), lambda s, a: with_parsed(_text(s, a.code)).select(F.inline("parsed.signals"))),
    ("implication", "check"): (("antecedent", "consequent"), lambda s, a: _pair(s, a).select("forward", "forward_message", "forward_trace")),
    ("implication", "equivalent"): (("antecedent", "consequent"), lambda s, a: _pair(s, a).select("result", "forward_message", "backward_message")),
    ("implication", "relationship"): (("antecedent", "consequent"), lambda s, a: _pair(s, a).select("relationship")),
    ("implication", "batch-equivalent"): (("path",), lambda s, a: check_pairs(files.read_pairs(s, a.path), _engine(a))),
    ("implication", "cross-validate"): (("path",), _cross),
    ("cot", "build"): (("code",), lambda s, a: _cot(s, _text(s, a.code))),
    ("cot", "build-file"): (("path",), lambda s, a: _cot(s, _of_file(s, a.path))),
    ("cot", "sections"): (("code",), lambda s, a: _cot(s, _text(s, a.code), True)),
    ("dataset", "build"): (("path",), lambda s, a: pipelines.enrich(files.read_dataset(s, a.path), _models(a)[0], store=a.store)),
    ("dataset", "build-cot-only"): (("path",), lambda s, a: pipelines.enrich(files.read_dataset(s, a.path))),
    ("dataset", "generate-svad"): (("code",), lambda s, a: pipelines.enrich(_text(s, a.code), _models(a)[0], with_steps=False)),
    ("dataset", "generate-cot"): (("code",), lambda s, a: pipelines.enrich(_text(s, a.code))),
    ("dataset", "validate"): (("path",), lambda s, a: quality.dataset_report(files.read_dataset(s, a.path))),
    ("dataset", "clear-cache"): (("path",), _clear),
    ("benchmark", "run"): (("path",), _evaluated),
    ("benchmark", "run-multi"): (("path",), lambda s, a: quality.model_metrics(_evaluated(s, a))),
    ("benchmark", "stats"): (("path",), lambda s, a: quality.dataset_stats(files.read_dataset(s, a.path))),
    ("benchmark", "clear-cache"): (("path",), _clear),
    ("gen", "generate"): ((), _synthesize),
    ("gen", "validate"): (("code",), _checked),
    ("gen", "validate-file"): (("path",), lambda s, a: files.read_generated(s, a.path).select("name", "sva", F.pandas_udf(_valid, "boolean")("sva").alias("is_valid"))),
    ("gen", "stress-test"): ((), _stress),
    ("gen", "list-presets"): ((), lambda s, a: s.createDataFrame(list(PRESETS.items()), "preset string, signals array<string>")),
    ("gen", "coverage"): (("path",), _cover),
    ("describe", "translate"): (("path",), lambda s, a: described(files.read_generated(s, a.path).drop("translation"), style=a.style, out="translation")),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assertloom")
    groups = p.add_subparsers(dest="group", required=True)
    made: dict[str, argparse._SubParsersAction] = {}
    for (group, command), (wanted, _) in COMMANDS.items():
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(dest="command", required=True)
        c = made[group].add_parser(command)
        for name in wanted:
            c.add_argument(name)
        c.add_argument("--out")
        c.add_argument("--prover", help="an external prover's command; without it the built-in checker runs")
        for flag, value in (("--depth", BOUND if group in ("implication", "benchmark") else 2), ("--seed", 42), ("--number", 10), ("--samples", 50), ("--top-n", 0)):
            c.add_argument(flag, type=int, default=value)
        for flag, value in (("--mode", "random"), ("--preset", "default"), ("--signals", ""), ("--style", "symbolic"), ("--config-file", None), ("--base-url", None), ("--model", None), ("--store", None)):
            c.add_argument(flag, default=value)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or build_session()
    out = COMMANDS[a.group, a.command][1](spark, a)
    if a.out:
        out.write.mode("overwrite").json(a.out)
    else:
        for line in out.select(F.to_json(F.struct("*"))).toLocalIterator():
            sys.stdout.write(line[0] + "\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
