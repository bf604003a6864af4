"""Corpora derived from the driver's tables by SQL that means the same in Spark and DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: An assertion for every order: blocks, inline assertions, plain sequences, copies that differ in white space, nothing at all.
ASSERTIONS = """
SELECT o_orderkey AS prop_id, CASE o_orderkey % 18
 WHEN 0 THEN concat('property p_', o_orderkey, ';', chr(10), '  @(posedge clk) disable iff (!rst_n)', chr(10), '  req |-> ##[1:', 1 + o_custkey % 5, '] ack;', chr(10), 'endproperty')
 WHEN 1 THEN concat('property p_', o_orderkey, '; @(posedge clk) valid |=> $stable(data); endproperty')
 WHEN 2 THEN concat('assert property (@(negedge clk_b) $rose(req_', o_custkey % 7, ') |-> ##', o_custkey % 4, ' gnt);')
 WHEN 3 THEN concat('property p_', o_orderkey, '; @(posedge clk) (req ##1 ack)[*', 2 + o_custkey % 3, '] |-> done; endproperty')
 WHEN 4 THEN 'cover property (@(posedge clk) a ##[0:$] b);'
 WHEN 5 THEN concat('property p_', o_orderkey, '; @(posedge clk) disable iff (rst) (count == MAX) |-> !push; endproperty')
 WHEN 6 THEN concat('property p_', o_orderkey, '; @(posedge clk) valid throughout (busy[->', 1 + o_custkey % 3, ']) |=> $past(data, ', 1 + o_custkey % 3, ') === q; endproperty')
 WHEN 7 THEN 'property dup; @(posedge clk) a |-> b; endproperty'
 WHEN 8 THEN 'property  dup;  @(posedge clk)  a |-> b;  endproperty'
 WHEN 9 THEN 'assume property (@(posedge clk) not (full && push) or empty);'
 WHEN 10 THEN ''
 WHEN 11 THEN 'req ##1 gnt'
 WHEN 12 THEN concat('property p_', o_orderkey, '; @(posedge core_clk) first_match(req ##[1:3] ack) |-> (mode == 2', chr(39), 'b01) ##1 done; endproperty')
 WHEN 13 THEN concat('lbl_', o_custkey % 9, ': assert property (@(posedge clk) disable iff (~reset_n) $fell(en) |=> (a intersect b) and c) else $error("bad, very bad");')
 WHEN 14 THEN concat('property p_', o_orderkey, '; @(posedge clk) a until_with b; endproperty // until it ends', chr(10), '/* a comment */')
 WHEN 15 THEN concat('`$onehot(state) && $countones(mask & sel) > ', o_custkey % 4, ' |-> $past(x) ^ $past(x, ', 2 + o_custkey % 3, ') | y`')
 WHEN 16 THEN concat('Here it is:', chr(10), '```systemverilog', chr(10), 'assert property (@(posedge clk) $changed(v) |-> ##2 w);', chr(10), '```', chr(10), 'Done.')
 ELSE concat('property p_', o_orderkey, '; @(posedge clk) if (en) a |-> ##1 b else c |-> d; endproperty')
END AS sva FROM orders"""

#: Benchmark results of three models over all line items.
RESULTS = """
SELECT concat('model_', CAST(l_suppkey % 3 AS VARCHAR(9))) AS model_name, l_orderkey * 8 + l_linenumber AS item_idx,
 CASE (l_linenumber + l_partkey) % 6 WHEN 0 THEN 'equivalent' WHEN 1 THEN 'equivalent' WHEN 2 THEN 'generated_implies_reference' WHEN 3 THEN 'reference_implies_generated'
  WHEN 4 THEN 'no_relationship' ELSE 'error' END AS relationship, l_quantity / 10 AS generation_time, l_tax AS verification_time FROM lineitem"""

#: Dataset entries with parts missing or empty here and there.
ENTRIES = """
SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('assert property (a_', o_orderkey, ' |-> b);') END AS SVA,
 CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 13 = 0 THEN '' ELSE concat('When a_', o_orderkey, ' holds, b holds in the same cycle', repeat(' at once', CAST(o_custkey % 4 AS INT)), '.') END AS SVAD,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('# Steps for ', o_orderkey) END AS CoT,
 CASE WHEN o_orderkey % 17 = 0 THEN 'svad_error' WHEN o_orderkey % 19 = 0 THEN 'cot_error' END AS failure FROM orders"""

#: Pair checks by two engines; the second ran on some only.
CHECKS = """
SELECT concat('pair_', CAST(o_orderkey AS VARCHAR(20))) AS id,
 CASE o_custkey % 6 WHEN 0 THEN 'equivalent' WHEN 1 THEN 'not_implies' WHEN 2 THEN 'error' WHEN 3 THEN 'timeout' WHEN 4 THEN 'syntax_error' ELSE 'not_implies' END AS result,
 CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'not_implies' ELSE CASE o_custkey % 6 WHEN 0 THEN 'equivalent' WHEN 1 THEN 'not_implies' ELSE 'error' END END AS other,
 o_custkey % 6 IN (0, 5) AS forward, o_custkey % 6 IN (0, 1) AND o_orderkey % 2 = 0 AS backward FROM orders"""

#: Tool logs, one for every event.
LOGS = """
SELECT event_id, CASE event_id % 10
 WHEN 0 THEN concat('Parsing', chr(10), 'file m.sv line 12: syntax error before `|->', chr(39), chr(10), 'stop')
 WHEN 1 THEN concat('** Results', chr(10), '[p1] always a: REFUTED', chr(10), 'Counterexample:', chr(10), 'State 0: a=', CAST(user_id AS VARCHAR(20)), chr(10), 'State 1: a=0')
 WHEN 2 THEN concat('** Results', chr(10), '[p1] always a: PROVED up to bound 20')
 WHEN 3 THEN 'Invariant check failed at 3'
 WHEN 4 THEN concat('conversion error', chr(10), 'error: in token ', event_type)
 WHEN 5 THEN 'error: cannot open display'
 WHEN 6 THEN concat('assert_consequent : Proven (', event_type, ')')
 WHEN 7 THEN 'assert_consequent : falsified at depth 4'
 WHEN 8 THEN concat('unknown identifier x_', CAST(user_id AS VARCHAR(20)))
 ELSE 'nothing to say' END AS log FROM events"""

_NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, first: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
    """The rows of one of the statements above over the tables of a folder; `first` is done to the table that it reads."""
    name = sql.rsplit("FROM ", 1)[1].strip()
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}").replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING"), source=first(table(spark, sf_dir, name)))
