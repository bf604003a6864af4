"""Synthesis of assertions as tables: random ones, and ones that cover every construct; a row's seed decides it, wherever it is made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assertloom.grammar.narrate import narrate
from assertloom.grammar.nodes import Node
from assertloom.grammar.parser import SyntaxProblem, parse
from assertloom.grammar.synth import CONSTRUCTS, PRESETS, Grammar, Source, make
from assertloom.session import arrow_batch, spread

SCHEMA = "id long, name string, sva string, svad string, property_block string, category string, construct string, is_valid boolean, attempts int, message string"
NODES = "tree_id long, node_id int, parent_id int, kind string, op string, text string"
Validator = Callable[[str], tuple[bool, str | None]]


def grammatical(text: str) -> tuple[bool, str | None]:
    """The built-in validator: whether the expression parses."""
    try:
        parse(text)
        return True, None
    except (SyntaxProblem, RecursionError) as e:
        return False, str(e)


def block(name: str, sva: str, clock: str) -> str:
    return f"property {name};\n  @(posedge {clock}) {sva};\nendproperty"


def _drawn(i: int, seed: int, source: Source, draw: Callable[[Random], Node], valid: Validator, tries: int) -> tuple[Node, str, bool, int, str | None]:
    """The first valid tree of up to `tries`, the last one if none is: (tree, text, whether it is valid, attempts, message)."""
    for attempt in range(1, tries + 1):
        source.seed(f"{seed}|{i}|{attempt}")
        node = draw(source)
        sva = str(node)
        ok, message = valid(sva)
        if ok:
            break
    return node, sva, ok, attempt, message


def _columns(schema: str) -> tuple[list, ...]:
    return tuple([] for _ in schema.split(", "))


def _add_row(columns: tuple[list, ...], i: int, drawn: tuple[Node, str, bool, int, str | None], clock: str, category: str | None, construct: str | None) -> None:
    node, sva, ok, attempt, message = drawn
    name = f"p_{i}"
    for c, value in zip(columns, (i, name, sva, narrate(node), block(name, sva, clock), category, construct, ok, attempt, message)):
        c.append(value)


def _random(ids: DataFrame, add: Callable[[tuple[list, ...], int, tuple], None], schema: str, seed: int, signals: list[str] | None, max_depth: int, advanced: bool, valid: Validator, tries: int) -> DataFrame:
    """The rows that `add` appends to the columns for each id and the random property drawn for it.

    Drawing costs far more than reading an id, and a file's row groups may be few: the ids are dealt out evenly first.
    """
    names = signals or PRESETS["default"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Source()
        draw = lambda r: Grammar(r, names, max_depth, advanced).property()
        for batch in batches:
            columns = _columns(schema)
            for i in batch.column(0).to_pylist():
                add(columns, i, _drawn(i, seed, source, draw, valid, tries))
            yield arrow_batch(columns, schema)

    return spread(ids.toDF("id", *ids.columns[1:]).where("id IS NOT NULL").select(F.col("id").cast("long"))).mapInArrow(run, schema)


def synthesize(ids: DataFrame, seed: int = 42, signals: list[str] | None = None, max_depth: int = 2, advanced: bool = True, clock: str = "clk", valid: Validator = grammatical, tries: int = 3) -> DataFrame:
    """A random property for each id (the first column, a long): SCHEMA, with null category and construct.

    The same id and seed give the same property on any cluster and partitioning. Null ids give no row; repeated ids repeat the property.
    """
    return _random(ids, lambda columns, i, drawn: _add_row(columns, i, drawn, clock, None, None), SCHEMA, seed, signals, max_depth, advanced, valid, tries)


def random_nodes(ids: DataFrame, seed: int = 42, signals: list[str] | None = None, max_depth: int = 2, advanced: bool = True, valid: Validator = grammatical, tries: int = 3) -> DataFrame:
    """nodes(synthesize(ids)) where the properties are drawn, without the texts that trees don't have."""
    return _random(ids, lambda columns, i, drawn: _add_nodes(columns, i, drawn[1]), NODES, seed, signals, max_depth, advanced, valid, tries)


def stratified(spark: SparkSession, samples: int = 50, seed: int = 42, signals: list[str] | None = None, max_depth: int = 2, clock: str = "clk", valid: Validator = grammatical, tries: int = 3) -> DataFrame:
    """`samples` properties for each of the 47 constructs, each with its construct in it, in an order by hash of the id."""
    names = signals or PRESETS["default"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Source()
        for batch in batches:
            columns = _columns(SCHEMA)
            for i in batch.column(0).to_pylist():
                category, construct = CONSTRUCTS[i // samples]
                draw = lambda r: make(category, construct, Grammar(r, names, max_depth))  # noqa: B023, E731
                _add_row(columns, i, _drawn(i, seed, source, draw, valid, tries), clock, category, construct)
            yield arrow_batch(columns, SCHEMA)

    return spark.range(len(CONSTRUCTS) * samples).mapInArrow(run, SCHEMA).orderBy(F.xxhash64(F.lit(seed), "id"), "id")


def _add_nodes(columns: tuple[list, ...], i: int, text: str) -> None:
    try:
        parse(text).into(columns, i)
    except SyntaxProblem:
        pass


def nodes(properties: DataFrame, key: str = "id", sva: str = "sva") -> DataFrame:
    """(tree_id, node_id, parent_id, kind, op, text) of every node of every property that parses: trees as a relation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _columns(NODES)
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                _add_nodes(columns, i, text)
            yield arrow_batch(columns, NODES)

    base = properties.select(F.col(key).cast("long").alias("k"), F.col(sva).alias("s")).dropna()
    return spread(base).mapInArrow(run, NODES)
