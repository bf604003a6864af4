"""Parsing, explanations and text utilities on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from assertloom.functions import cot, parse, pure, text


def parsed(spark, sva):
    return parse.with_parsed(spark.createDataFrame([(sva,)], "sva string"), out="p").first().p


def test_a_named_property(spark):
    p = parsed(spark, "property handshake;\n @(posedge clk) disable iff (!rst_n) req |-> ##[1:3] ack;\nendproperty\nassert property (handshake);")
    assert (p.property_name, p.clock_signal, p.clock_edge, p.reset_signal, p.reset_active_low) == ("handshake", "clk", "posedge", "rst_n", True)
    assert (p.implication_type, p.antecedent, p.consequent) == ("|->", "req", "##[1:3] ack")
    assert [tuple(d) for d in p.delays] == [(1, 3, False)]
    assert [s.name for s in p.signals] == ["ack", "clk", "req", "rst_n"]


@pytest.mark.parametrize(
    "sva, field, want",
    [
        ("a |=> b |-> c", "implication_type", "|=>"),
        ("a |=> b |-> c", "antecedent", "a"),
        ("cover property (@(negedge c) x);", "is_cover", True),
        ("cover property (@(negedge c) x);", "is_assertion", False),
        ("x ##1 y", "is_assertion", True),
        ("x", "clock_edge", "posedge"),
        ("disable iff (rst) a", "reset_active_low", False),
        ("a ##[0:$] b ##2 c", "delays", [(2, 2, False), (0, None, True)]),
        ("$past(x, 2) == $rose(y)", "builtin_functions", [("$rose", ["y"]), ("$past", ["x", "2"])]),
        ("a throughout b[*3] or c[->1]", "temporal_operators", ["[*", "[->", "throughout", "or"]),
        ("s == 2'h2", "signals", [("h2", False, False), ("s", False, False)]),
        ("", "clock_edge", "posedge"),
    ],
)
def test_fields(spark, sva, field, want):
    got = parsed(spark, sva)[field]
    if isinstance(got, list):
        got = [tuple(x) if not isinstance(x, str) else x for x in got]
    assert got == want


def test_null_text_gives_a_null_struct(spark):
    assert parsed(spark, None) is None


def test_parsed_keeps_clashing_columns(spark):
    df = spark.createDataFrame([("a |-> b", "x", "y")], "sva string, signals string, _body string")
    r = parse.with_parsed(df).first()
    assert (r.signals, r._body, r.parsed.antecedent) == ("x", "y", "a")


def test_explanation_has_all_sections(spark):
    df = parse.with_parsed(spark.createDataFrame([("property p; @(posedge clk) disable iff (!rst_n) $rose(req) |=> $past(d, 2) == q; endproperty",)], "sva string"), out="p")
    out = df.select(cot.explanation(F.col("p"), F.col("sva")).alias("t"), cot.sections(F.col("p"), F.col("sva")).alias("s")).first()
    assert [s.title for s in out.s] == list(cot.TITLES)
    for part in ("**Property:** p", "Step 5", "Non-overlapping", "Reference to `d` from 2 cycles ago", "Active Low", "using built-in functions: $past, $rose."):
        assert part in out.t


@pytest.mark.parametrize("code", ["assert property (a);", "a (", "a ]", "property p; a; endproperty", "a [ b", "sequence s; a;", ")(", ""])
def test_syntax_check_agrees_with_plain_python(spark, code):
    got = spark.createDataFrame([(code,)], "s string").select(text.syntax_check(F.col("s")).alias("c")).first().c
    assert tuple(got) == pure.check_syntax(code)


def test_plain_text_functions():
    assert pure.reindent("module m;\nbegin\nx;\nend\nendmodule") == "module m;\n    begin\n        x;\n    end\nendmodule"
    assert pure.strip_comments('a; // b\n/* c\nd */ e;\n\ns = "//x"; /* y */') == 'a;\ne;\ns = "//x";'
    assert pure.reply_code("text\n```sv\na (\n```\n```\nb\n```") == "b"
    assert pure.split_arguments("f(a, b), 2,, c") == ["f(a, b)", "2", "c"]
    assert pure.nested_calls("$past(f(a, b), 2)") == [{"name": "$past", "arguments": ["f(a, b"]}]  # the first closing parenthesis ends a call
    assert pure.past_uses("$past(a) $past(a, 3) $past(b)") == {"a": 3, "b": 1}
    assert "reg a_d2;" in pure.past_registers("$past(a, 2)") and pure.past_registers("a") == ""
