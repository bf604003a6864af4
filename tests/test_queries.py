"""Every query of the assertion side against its SQL, and the ones without SQL against plain Python."""

import os

import pytest

import __spark_entry__ as entry
from assertloom.functions import cot, parse, text
from assertloom.plans import catalogue, oracle
from pyspark.sql import functions as F

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(name, agree):
    agree(QUERIES[name], SQL[name])


def test_entry_and_names(spark):
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 48


def test_a_header_computes_no_more_than_it_shows(spark, sf):
    plan = QUERIES["cot_header"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "sort_array" not in plan and "array_sort" not in plan  # signals, calls and delays aren't in it


def test_explanations_of_fields_are_those_of_the_struct(spark):
    rows = [(1, None), (2, ""), (3, "property p; @(posedge clk) a |-> ##1 b; endproperty"), (4, "assume property (x);")]
    df = spark.createDataFrame(rows, "prop_id int, sva string")
    shown = lambda p: [cot.header(p), cot.assembly(p), cot.explanation(p, F.col("sva")), cot.sections(p, F.col("sva")), text.signal_info(p)]
    got = parse.parsed_columns(df).select("prop_id", *shown(parse.Fields(F.col("sva")))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, parse.with_parsed(df, out="p").select("prop_id", *shown(F.col("p"))).collect()))


def test_corpus_sql_is_shared(spark, sf, duck):
    got = [tuple(r) for r in catalogue.corpus(spark, sf).orderBy("prop_id").collect()]
    assert got == duck.sql(f"SELECT * FROM ({oracle.ASSERTIONS}) ORDER BY prop_id").fetchall()


def test_nothing_imports_the_training_data_operators():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(top, "assertloom")):
        for n in names:
            path = os.path.join(folder, n)
            if n.endswith(".py") and f"{os.sep}llm" not in folder:
                assert "assertloom.llm" not in open(path).read(), path
