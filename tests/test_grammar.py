"""Trees, synthesis, both describers and the bounded checker."""

from dataclasses import dataclass
from itertools import product
from random import Random

import pytest

from assertloom.functions import describe
from assertloom.functions.describe import described, module_text, signal_names, single
from assertloom.grammar.narrate import narrate
from assertloom.grammar.parser import SyntaxProblem, parse
from assertloom.grammar.synth import CONSTRUCTS, PRESETS, Grammar, Source, contains, make
from assertloom.operators import synthesis, verification
from assertloom.plans import catalogue
from assertloom.verify.bounded import check
from assertloom.verify.engines import module
from pyspark.sql import functions as F


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_trees_parse_back(depth):
    for i in range(300):
        text = str(Grammar(Random(f"{depth}|{i}"), PRESETS["fifo"], depth).property())
        assert str(parse(text)) == text


@pytest.mark.parametrize("category, construct", CONSTRUCTS)
def test_makers_contain_their_construct(category, construct):
    for i in range(10):
        node = make(category, construct, Grammar(Random(i)))
        assert contains(node, category, construct) and narrate(node).startswith(("Logic", "Scope"))


def test_there_are_47_constructs():
    assert len(CONSTRUCTS) == 47


@pytest.mark.parametrize("bad", ["", "a |-> (", "a b", "a ##[1 b", "first_match a", "@ a"])
def test_bad_text_raises(bad):
    with pytest.raises(SyntaxProblem):
        parse(bad)


@pytest.mark.parametrize(
    "sva, want",
    [
        ("req", "Logic: the request (req) signal\nDefinitions:\n"),
        ("a |=> b", "Logic: When the a signal occurs, then in the next cycle, the b signal must hold.\nDefinitions:\n"),
        ("a |-> (b[->4])", "Logic: When the a signal occurs, then in the same cycle, wait for the 4th occurrence of the b signal must hold.\nDefinitions:\n"),
        ("disable iff (r) (a |-> $rose(b))", "Scope: This property is active unless the r signal is asserted.\nLogic: When the a signal occurs, then in the same cycle, the b signal rises from low to high must hold.\nDefinitions:\n"),
        ("((a && $fell(b)) until c)", "Logic: Exp_1 holds until the c signal occurs\nDefinitions:\n* Sys_0: the b signal falls from high to low\n* Exp_1: the a signal and Sys_0\n"),
    ],
)
def test_narration(sva, want):
    assert narrate(parse(sva)) == want


def test_descriptions(spark):
    rows = [("(a ##[0:2] b) |-> ($countones(b) && c)",), ("  ",), (None,), ("a until b",)]
    out = [r.description for r in described(spark.createDataFrame(rows, "sva string")).collect()]
    assert out[0].endswith("- Calc_0: The result of: ($countones(b) && c)\n- Exp_0: the a signal followed by the b signal between 0 and 2 cycles later\n- Exp_1: Calc_0\n- Sys_0: the count of high bits in the b signal")
    assert out[1:3] == ["", None] and "Evaluate the property: a until b" in out[3]
    natural = described(spark.createDataFrame([("a == b |-> !c",)], "sva string"), style="natural").first().description
    assert "- Exp_0: the a signal equals the b signal" in natural and "- Exp_1: not the c signal" in natural
    with pytest.raises(ValueError):
        described(spark.createDataFrame(rows, "sva string"), style="other")


def test_descriptions_are_worded_once_for_all_names(spark):
    rows = [(f"property p_{i}; @(posedge clk) $rose(a) |-> ##[1:2] (b && c); endproperty",) for i in range(50)] + [("property q; endproperty",)]
    df = described(spark.createDataFrame(rows, "sva string").coalesce(1))
    got = [r.description for r in df.collect()]
    assert len(set(got[:50])) == 1 and "Evaluate the property: property q; endproperty" in got[50]
    plan = df._jdf.queryExecution().toString()
    assert "to_json" in plan  # what is worded is known by one text, which the name isn't in
    describe._told.cache_clear()
    fields = '{"signals":[{"name":"a","is_clock":false,"is_reset":false}],"builtin_functions":[],"antecedent":null,"consequent":null,"clock_signal":null,"clock_edge":"posedge","implication_type":null,"reset_signal":null,"reset_active_low":true,"disable_condition":null}'
    assert describe._told("a", fields, "symbolic") == describe._told("a", fields, "symbolic") and describe._told.cache_info().hits == 1


@pytest.mark.parametrize("name", ["describe_symbolic", "describe_natural", "parse_full", "cot"])
def test_a_file_of_one_row_group_is_not_one_task(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).rdd.getNumPartitions() > 4


def test_synthesis_depends_on_the_id_alone(spark):
    ids = spark.range(200)
    a = {r.id: r.sva for r in synthesis.synthesize(ids.repartition(7)).collect()}
    b = {r.id: r.sva for r in synthesis.synthesize(ids.repartition(2)).collect()}
    assert a == b and len(a) == 200 and len(set(a.values())) > 50


def test_stratified_covers_every_construct(spark):
    rows = synthesis.stratified(spark, samples=2).collect()
    assert len(rows) == 94 and all(r.is_valid for r in rows)
    assert {(r.category, r.construct) for r in rows} == set(CONSTRUCTS)
    for r in rows:
        assert contains(parse(r.sva), r.category, r.construct) or r.construct in ("and", "or")  # and, or between sequences read as sequences


def test_a_slot_that_never_passes_is_marked(spark):
    rows = synthesis.synthesize(spark.range(3), valid=lambda s: (False, "no")).collect()
    assert [(r.is_valid, r.attempts, r.message) for r in rows] == [(False, 3, "no")] * 3


def test_nodes_as_rows(spark):
    rows = synthesis.nodes(spark.createDataFrame([(1, "a |-> !b"), (2, "a ("), (None, "a"), (3, None)], "id long, sva string")).collect()
    assert [(r.tree_id, r.node_id, r.parent_id, r.kind) for r in rows] == [(1, 0, None, "implies"), (1, 1, 0, "signal"), (1, 2, 0, "unary"), (1, 3, 2, "signal")]


def test_random_nodes_are_the_nodes_of_random_properties(spark):
    ids = spark.createDataFrame([(i,) for i in (*range(300), -4, 7, None)], "id long").coalesce(1)
    got = synthesis.random_nodes(ids)
    want = synthesis.nodes(synthesis.synthesize(ids))
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.rdd.getNumPartitions() > 1  # a file of one row group is drawn for by more than one task


def test_a_source_draws_what_random_draws():
    source = Source()
    for i in range(200):
        source.seed(f"42|{i}|1")
        assert str(Grammar(source, max_depth=4).property()) == str(Grammar(Random(f"42|{i}|1"), max_depth=4).property())


def test_operators_bind_as_before():
    text = "a || b && c | d ^ e & f == g < h + i * -j ? k : l"
    assert str(parse(text)) == "((a || (b && (c | (d ^ (e & (f == (g < (h + (i * (-j)))))))))) ? k : l)"
    assert str(parse("a - b - c or d and e intersect f within g")) == "(((a - b) - c) or (d and (e intersect (f within g))))"
    for bad, message in (("a ##1", "unexpected end"), ("(a b", "expected ), found b"), ("a  @b", "unexpected token '@b'"), ("a // c\n $", "unexpected token '$'")):
        with pytest.raises(SyntaxProblem) as e:
            parse(bad)
        assert str(e.value) == message


def test_deep_nesting_parses():
    assert str(parse("(" * 60 + "a" + ")" * 60)) == "a"  # the levels of each operator in turn were too deep for Python's stack


def test_texts(spark):
    df = spark.createDataFrame([(["a", "b"], ["property p0;\n x;\nendproperty"], 2)], "s array<string>, b array<string>, n int")
    r = df.select(module_text("m", F.col("s"), F.col("b")).alias("m"), single("cover", F.lit("c"), F.lit("x")).alias("c"), signal_names(F.lit("d"), F.col("n"), "u").alias("n"), signal_names(F.lit("d"), F.lit(0)).alias("z")).first()
    assert "assert_p0: assert property (p0);" in r.m and r.m.startswith("module m (") and r.c == "c: cover property (@(posedge clk) x);"
    assert (r.n, r.z) == (["u_d_0", "u_d_1"], [])


TRUTH = [
    ("req |-> ack", "req |-> ack", "implies"), ("a |-> b", "a |-> b || c", "implies"), ("a |-> b || c", "a |-> b", "not_implies"), ("a |-> ##1 b", "a |=> b", "implies"),
    ("a |-> ##[1:2] b", "a |-> ##[1:3] b", "implies"), ("a |-> ##[1:3] b", "a |-> ##[1:2] b", "not_implies"), ("a && c |-> b", "a |-> b", "not_implies"), ("a |-> b", "a && c |-> b", "implies"),
    ("a", "b", "not_implies"), ("a[*2] |-> b", "a[*3] |-> b", "implies"), ("a |-> b", "$rose(a) |-> b", "implies"), ("$changed(a) |-> b", "a |-> b", "error"), ("a |-> (", "b", "syntax_error"),
    ("(a ##[1:3] b) |-> c", "first_match(a ##[1:3] b) |-> c", "implies"), ("first_match(a ##[1:3] b) |-> c", "(a ##[1:3] b) |-> c", "not_implies"), ("not a", "!a", "implies"),
    ("if (a) b else c", "b", "error"), ("a |-> b[->1]", "a |-> ##[0:$] b", "implies"),
]


@pytest.mark.parametrize("a, c, want", TRUTH)
def test_truth_table(a, c, want):
    assert check(a, c, 6)[0] == want


def test_checker_agrees_with_all_traces():
    """Boolean sides with delays, against every trace of two signals over four cycles."""
    forms = [
        ("a |-> b", lambda x, y, t, k: not x[t] or y[t]),
        ("a |=> b", lambda x, y, t, k: not x[t] or t + 1 > k or y[t + 1]),
        ("a |-> ##[0:1] b", lambda x, y, t, k: not x[t] or y[t] or t + 1 > k or y[t + 1]),
        ("$rose(a) |-> b", lambda x, y, t, k: not (x[t] and not (t and x[t - 1])) or y[t]),
        ("a ##1 b", lambda x, y, t, k: x[t] and (t + 1 > k or y[t + 1])),
        ("$past(a) |-> b", lambda x, y, t, k: not (t and x[t - 1]) or y[t]),
        ("a || b", lambda x, y, t, k: x[t] or y[t]),
    ]
    k = 3
    traces = list(product(product([0, 1], repeat=k + 1), repeat=2))
    holds = {name: [all(f(x, y, t, k) for t in range(k + 1)) for x, y in traces] for name, f in forms}
    for a in holds:
        for c in holds:
            want = "implies" if all(q for p, q in zip(holds[a], holds[c]) if p) else "not_implies"
            assert check(a, c, k)[0] == want, (a, c)


def test_a_counterexample_is_one(spark):
    result, _, trace = check("a || b", "a", 2)
    assert result == "not_implies" and "a=0 b=1" in trace


def test_pairs(spark):
    rows = [(1, "a |-> b", "a |-> b"), (2, "a |-> b", "a |-> b || c"), (3, None, "a"), (4, "@(posedge x) a", "@(negedge x) a"), (5, "a (", "a"), (1, "a |-> b", "a |-> b")]
    got = {r.id: (r.forward, r.backward, r.result, r.relationship) for r in verification.check_pairs(spark.createDataFrame(rows, "id int, sva1 string, sva2 string")).collect()}
    assert got[1] == ("implies", "implies", "equivalent", "equivalent")
    assert got[2] == ("implies", "not_implies", "not_implies", "generated_implies_reference")
    assert got[3][2:] == ("error", "error") and got[4][2:] == ("equivalent", "equivalent") and got[5][2:] == ("syntax_error", "error")


def test_each_direction_runs_on_the_clock_of_its_antecedent(spark):
    @dataclass(frozen=True)
    class Told:
        def check(self, antecedent, consequent, clock="clk", edge="posedge"):
            return "implies", f"{edge} {clock}", None

    rows = [(1, "@(negedge ck) a", "@(posedge x) a"), (2, "a", "a"), (3, "@(posedge x) a", "@(negedge ck) a")]
    got = {r.id: r for r in verification.check_pairs(spark.createDataFrame(rows, "id int, sva1 string, sva2 string"), Told()).collect()}
    assert {k: (r.forward_message, r.backward_message) for k, r in got.items()} == {1: ("negedge ck", "posedge x"), 2: ("posedge clk", "posedge clk"), 3: ("posedge x", "negedge ck")}
    assert all(r.verification_time > 0 for r in got.values())


def test_a_prover_gets_the_clock():
    text = module("a", "b", ["a", "b"], "ck", "negedge")
    assert "input wire ck" in text and text.count("@(negedge ck)") == 3 and "posedge" not in text
