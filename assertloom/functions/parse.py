"""Assertion text to a typed struct, by column expressions alone: clock, reset, implication, delays, signals, built-in calls.

Java's regular expressions are ASCII unless told otherwise; `(?U)` is not set here, so that the same patterns mean the same in RE2.
A null text gives a null struct; an empty one a struct of defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assertloom.functions.names import BUILTINS

KEYWORDS = sorted(
    set(
        "property endproperty sequence endsequence assert assume cover disable iff posedge negedge or and not if else throughout within intersect "
        "first_match always eventually nexttime until until_with s_always s_eventually s_nexttime s_until s_until_with strong weak accept_on reject_on "
        "sync_accept_on sync_reject_on module endmodule input output wire reg logic error warning info fatal".split()
    )
)
NAME = "[a-zA-Z_][a-zA-Z0-9_]*"
CLOCK = rf"@\s*\(\s*(posedge|negedge)\s+({NAME})\s*\)"
DISABLE = r"disable\s+iff\s*\(\s*([^)]+)\s*\)"
BLOCK = r"(?i)property\s+\w+\s*;([\s\S]*?)endproperty"
INLINE = r"(?i)(?:assert|assume|cover)\s+property\s*\(([^;]+)\)"
EXACT, RANGE = r"##(\d+)", r"##\[(\d+):(\d+|\$)\]"

PARSED = (
    "STRUCT<property_name STRING,is_assertion BOOLEAN,is_assumption BOOLEAN,is_cover BOOLEAN,clock_signal STRING,clock_edge STRING,reset_signal STRING,"
    "reset_active_low BOOLEAN,disable_condition STRING,implication_type STRING,antecedent STRING,consequent STRING,"
    "signals ARRAY<STRUCT<name STRING,is_clock BOOLEAN,is_reset BOOLEAN>>,builtin_functions ARRAY<STRUCT<name STRING,arguments ARRAY<STRING>>>,"
    "delays ARRAY<STRUCT<min INT,max INT,unbounded BOOLEAN>>,temporal_operators ARRAY<STRING>>"
)


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def strip_end(c: Column) -> Column:
    """Stripped, then without semicolons at both ends, then stripped again."""
    return strip(F.btrim(strip(c), F.lit(";")))


def having(c: Column, mark: str, then: Column, otherwise: Column | None = None) -> Column:
    """`then` where the mark stands in the text, else `otherwise` (or null): a search for a mark costs far less than a pattern that needs it."""
    out = F.when(F.contains(c, F.lit(mark)), then)
    return out if otherwise is None else out.otherwise(otherwise)


def without(c: Column, mark: str, pattern: str, by: str = "") -> Column:
    """The text with `by` for all that matches; the mark stands in every match."""
    return having(c, mark, F.regexp_replace(c, pattern, by), c)


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, or null where the pattern doesn't match or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def body(c: Column) -> Column:
    """What a property says: of a named block, else of an inline assertion, else the whole text."""
    low = F.lower(c)
    block, inline = (F.contains(low, F.lit(mark)) & F.regexp_like(c, F.lit(p)) for mark, p in (("endproperty", BLOCK), ("property", INLINE)))
    return F.when(block, strip(F.regexp_extract(c, BLOCK, 1))).when(inline, strip(F.regexp_extract(c, INLINE, 1))).otherwise(c)


def property_name(c: Column) -> Column:
    return having(c, "property", found(c, rf"property\s+({NAME})"))


def kinds(c: Column) -> tuple[Column, Column, Column]:
    """(assertion, assumption, cover), by words anywhere; assertion if there is none."""
    low = F.lower(c)
    a, b, d = (F.contains(low, F.lit(w)) for w in ("assert", "assume", "cover"))
    return a | ~(b | d), b, d


def clock(c: Column) -> tuple[Column, Column]:
    """(signal, edge); without a clocking event null and posedge."""
    return having(c, "@", found(c, CLOCK, 2)), F.coalesce(having(c, "@", found(c, CLOCK, 1)), F.lit("posedge"))


def disable(c: Column) -> tuple[Column, Column, Column]:
    """(condition, reset signal, active low); without a disable clause null, null and true."""
    cond = having(c, "disable", strip(found(c, DISABLE)))
    reset = found(cond, rf"[!~]?\s*({NAME})")
    low = F.when(cond.isNull(), F.lit(True)).otherwise(cond.startswith("!") | cond.startswith("~"))
    return cond, reset, low


def implication(of_body: Column) -> tuple[Column, Column, Column]:
    """(operator, antecedent, consequent) of a body; |=> is looked for first, wherever it stands."""
    op = F.when(F.contains(of_body, F.lit("|=>")), F.lit("|=>")).when(F.contains(of_body, F.lit("|->")), F.lit("|->"))
    left = F.when(op == "|=>", F.substring_index(of_body, "|=>", 1)).when(op == "|->", F.substring_index(of_body, "|->", 1))
    left = without(without(left, "@", r"@\s*\([^)]+\)"), "disable", r"disable\s+iff\s*\([^)]+\)")
    after = lambda sign: F.substring(of_body, F.locate(sign, of_body) + 3, F.length(of_body))
    right = F.when(op == "|=>", after("|=>")).when(op == "|->", after("|->"))
    return op, strip_end(left), strip_end(right)


def delays(c: Column) -> Column:
    """All exact delays in order, then all ranges."""
    exact = F.transform(F.regexp_extract_all(c, F.lit(EXACT), F.lit(1)), lambda n: F.struct(n.cast("int").alias("min"), n.cast("int").alias("max"), F.lit(False).alias("unbounded")))
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(RANGE), F.lit(1)).alias("a"), F.regexp_extract_all(c, F.lit(RANGE), F.lit(2)).alias("b"))
    ranges = F.transform(pairs, lambda p: F.struct(p["a"].cast("int").alias("min"), F.when(p["b"] != "$", p["b"]).cast("int").alias("max"), (p["b"] == "$").alias("unbounded")))
    return having(c, "##", F.concat(exact, ranges), F.when(c.isNotNull(), F.array().cast("array<struct<min:int,max:int,unbounded:boolean>>")))


def temporal_operators(c: Column) -> Column:
    low = F.lower(c)
    tests = [(F.contains(c, F.lit(s)), s) for s in ("##", "[*", "[->", "[=")] + [(F.contains(low, F.lit(s)), s) for s in ("throughout", "within", "intersect")]
    tests += [(F.contains(low, F.lit(w)) & F.regexp_like(c, F.lit(rf"(?i)\b{w}\b")), w) for w in ("and", "or", "not")] + [(F.contains(low, F.lit("first_match")), "first_match")]
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests]))


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"\b({NAME})\b"), F.lit(1))


def signals(of_body: Column, whole: Column, clock_signal: Column, reset_signal: Column) -> Column:
    """Distinct names in the body, sorted; flags by name pattern or as the clock and reset found. A sized literal leaves its digits' name.

    A body that is empty gives way to the whole text.
    """
    text = F.when(of_body == "", whole).otherwise(of_body)
    for mark, pattern, by in (('"', r'"[^"]*"', ""), ("//", r"(?m)//.*$", ""), ("/*", r"(?s)/\*.*?\*/", ""), ("$", rf"\${NAME}\s*\(", "(")):
        text = without(text, mark, pattern, by)
    names = F.filter(F.array_distinct(identifiers(text)), lambda n: ~F.lower(n).isin(KEYWORDS))
    names = F.sort_array(names)
    return F.transform(
        names,
        lambda n: F.struct(
            n.alias("name"),
            (F.lower(n).startswith("clk") | F.lower(n).startswith("clock") | n.eqNullSafe(clock_signal)).alias("is_clock"),
            (F.lower(n).startswith("rst") | F.lower(n).startswith("reset") | n.eqNullSafe(reset_signal)).alias("is_reset"),
        ),
    )


def builtin_functions(c: Column) -> Column:
    """Calls by function in the order of BUILTINS, then by position; arguments end at the first closing parenthesis."""
    none = F.when(c.isNotNull(), F.array().cast("array<struct<name:string,arguments:array<string>>>"))

    def calls(name: str) -> Column:
        args = F.regexp_extract_all(c, F.lit(rf"(?i)\{name}\s*\(([^)]*)\)"), F.lit(1))
        return having(F.lower(c), name, F.transform(args, lambda a: F.struct(F.lit(name).alias("name"), F.filter(F.transform(F.split(a, ","), strip), lambda x: x != "").alias("arguments"))), none)

    return having(c, "$", F.concat(*[calls(name) for name in BUILTINS]), none)


def parsed_columns(df: DataFrame, sva: str = "sva") -> DataFrame:
    """df with the fields of PARSED as columns, which replace columns of those names.

    The body, the clock, the disable clause and the implication are layers of their own, used by several fields but computed once; what
    nothing reads is pruned.
    """
    c = F.col(sva)
    df = df.withColumns({"_body": body(c), "_clock": F.struct(*clock(c)), "_disable": F.struct(*disable(c))})
    df = df.withColumn("_implication", F.struct(*implication(F.col("_body"))))
    b, clk, cond, op = F.col("_body"), F.col("_clock"), F.col("_disable"), F.col("_implication")
    clk, edge = (clk[f"col{i}"] for i in (1, 2))
    cond, reset, low = (cond[f"col{i}"] for i in (1, 2, 3))
    op, left, right = (op[f"col{i}"] for i in (1, 2, 3))
    is_assertion, is_assumption, is_cover = kinds(c)
    return df.withColumns(
        {
            "property_name": property_name(c),
            "is_assertion": is_assertion,
            "is_assumption": is_assumption,
            "is_cover": is_cover,
            "clock_signal": clk,
            "clock_edge": edge,
            "reset_signal": reset,
            "reset_active_low": low,
            "disable_condition": cond,
            "implication_type": op,
            "antecedent": left,
            "consequent": right,
            "signals": signals(b, c, clk, reset),
            "builtin_functions": builtin_functions(b),
            "delays": delays(b),
            "temporal_operators": temporal_operators(b),
        }
    ).drop("_body", "_clock", "_disable", "_implication")


FIELDS = (
    "property_name is_assertion is_assumption is_cover clock_signal clock_edge reset_signal reset_active_low disable_condition implication_type antecedent consequent "
    "signals builtin_functions delays temporal_operators"
).split()


class Fields(dict):
    """The columns of parsed_columns as a struct PARSED reads: only those that are read are computed. It is null where the text is."""

    def __init__(self, text: Column):
        super().__init__({f: F.col(f) for f in FIELDS})
        self.text = text

    def isNotNull(self) -> Column:  # noqa: N802, as a Column's
        return self.text.isNotNull()


def with_parsed(df: DataFrame, sva: str = "sva", out: str = "parsed") -> DataFrame:
    """df with a column of type PARSED: null where the text is null."""
    names = [n for n in df.columns if n != out]
    inner = df.select(*[F.col(n).alias(f"_{i}_") for i, n in enumerate(names)])
    text = F.col(f"_{names.index(sva)}_")
    full = parsed_columns(inner, f"_{names.index(sva)}_")
    return full.select(*[F.col(f"_{i}_").alias(n) for i, n in enumerate(names)], F.when(text.isNotNull(), F.struct(*FIELDS)).alias(out))
