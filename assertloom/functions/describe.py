"""Descriptions of assertions: parsed by column expressions, split and worded in Arrow batches."""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assertloom.functions.parse import FIELDS, body, parsed_columns
from assertloom.grammar.translate import STYLES, translate

_READ = [f for f in FIELDS if f not in ("property_name", "is_assertion", "is_assumption", "is_cover", "delays", "temporal_operators")]


@lru_cache(maxsize=20_000)
def _told(text: str, fields: str, style: str) -> str:
    """A description by all that it depends on: properties that differ in name alone have one, and those met of late aren't worded again."""
    return translate(text, json.loads(fields), text, style)


def _worded(style: str):
    @F.pandas_udf("string")
    def run(text: pd.Series, fields: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _told(t, f, style) for t, f in zip(text, fields)], dtype=object)

    return run


def described(df: DataFrame, sva: str = "sva", style: str = "symbolic", out: str = "description") -> DataFrame:
    """df with the description of each assertion; a null text has none, and a blank one an empty one.

    `symbolic` names sequences, sums and calls and defines them; `natural` puts operators in words. Other styles raise.
    """
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    names = [n for n in df.columns if n != out]
    inner = df.select(*[F.col(n).alias(f"_{i}_") for i, n in enumerate(names)])
    at = f"_{names.index(sva)}_"
    full = parsed_columns(inner, at).withColumn("_b", body(F.col(at)))
    shown = F.when(F.col("_b") == "", F.col(at)).otherwise(F.col("_b"))
    told = _worded(style)(shown, F.to_json(F.struct(*_READ), {"ignoreNullFields": "false"}))
    told = F.when(F.regexp_like(at, F.lit(r"^\s*$")), F.lit("")).otherwise(told)
    return full.select(*[F.col(f"_{i}_").alias(n) for i, n in enumerate(names)], told.alias(out))


def module_text(name: str, signals: Column, blocks: Column, clock: str = "clk", reset: str = "rst_n", assertions: bool = True) -> Column:
    """A module that declares signals and holds property blocks, each asserted; both are arrays of strings."""
    declared = F.array_join(F.transform(signals, lambda s: F.concat(F.lit("  logic "), s, F.lit(";"))), "\n")
    instances = F.array_join(F.transform(blocks, lambda b, i: F.concat(F.lit("  assert_p"), i.cast("string"), F.lit(": assert property ("), F.regexp_extract(b, r"property\s+(\w+)", 1), F.lit(");"))), "\n")
    head = F.lit(f"module {name} (\n  input logic {clock},\n  input logic {reset}\n);\n")
    return F.concat(head, declared, F.lit("\n\n"), F.array_join(blocks, "\n\n"), F.concat(F.lit("\n\n"), instances) if assertions else F.lit(""), F.lit("\nendmodule\n"))


def single(kind: str, name: Column, expression: Column, clock: str = "clk", edge: str = "posedge") -> Column:
    """NAME: assert, cover or assume property (@(edge clock) expression);"""
    if kind not in ("assert", "cover", "assume"):
        raise ValueError("assert, cover or assume")
    return F.concat(name, F.lit(f": {kind} property (@({edge} {clock}) "), expression, F.lit(");"))


def signal_names(base: Column, count: Column, prefix: str = "") -> Column:
    """base_0, base_1, ... or with the prefix before; no names for a count of 0."""
    head = F.concat(F.lit(f"{prefix}_" if prefix else ""), base, F.lit("_"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(head, i.cast("string")))).otherwise(F.array().cast("array<string>"))
