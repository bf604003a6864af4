"""Column functions over assertion text, tool logs and model replies. All take and give columns; a null input gives null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from assertloom.functions import pure
from assertloom.functions.parse import BUILTINS, NAME, identifiers, strip, strip_end

#: Functions that the external bounded prover knows.
PROVER_FUNCTIONS = ("$rose", "$fell", "$stable", "$past", "$onehot", "$onehot0")
CHECKER_WORDS = (
    "property endproperty sequence endsequence assert assume cover disable iff posedge negedge or and not if else throughout within intersect first_match clk rst_n"
).split()
FORMAL_WORDS = [w for w in CHECKER_WORDS if w != "clk"]
EXPRESSION_WORDS = (
    "property endproperty sequence endsequence assert assume cover disable iff posedge negedge or and not if else throughout within intersect first_match "
    "always eventually nexttime until until_with module endmodule input output wire reg logic"
).split()


# normalisation for provers


def clock_spec(c: Column) -> Column:
    """struct(edge, clock) as a prover needs it: any case, posedge clk by default."""
    text = strip(F.regexp_replace(strip(c), "^`+|`+$", ""))
    pattern = rf"(?i)@\s*\(\s*(posedge|negedge)\s+({NAME})\s*\)"
    edge, name = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in (1, 2))
    return F.when(c.isNotNull(), F.struct(F.coalesce(F.lower(edge), F.lit("posedge")).alias("edge"), F.coalesce(name, F.lit("clk")).alias("clock")))


def _bare(c: Column) -> Column:
    c = F.regexp_replace(c, r"@\s*\(\s*(posedge|negedge)\s+\w+\s*\)", "")
    c = F.regexp_replace(c, r"disable\s+iff\s*\([^)]+\)", "")
    return strip_end(F.regexp_replace(c, r"\s+", " "))


def normalized(c: Column) -> Column:
    """The bare property expression: no backticks, wrapper, label, name, clock, disable clause or failure action; one space between words."""
    code = strip(F.regexp_replace(strip(c), "^`+|`+$", ""))
    block = r"(?is)property\s+\w+\s*;?\s*(.*?)\s*endproperty"
    rest = F.regexp_replace(code, r"(?s)\s+else\s+\$\w+\s*\([^;]*\)\s*;?\s*$", "")
    rest = F.regexp_replace(rest, r"^\s*\w+\s*:\s*", "")
    wrapper = r"(?is)(assert|assume|cover)\s+property\s*\(\s*(.*?)\s*\)\s*;?\s*$"
    rest = F.when(F.regexp_like(rest, F.lit(wrapper)), strip(F.regexp_extract(rest, wrapper, 2))).otherwise(rest)
    rest = F.regexp_replace(rest, r"(?i)^\s*property\s+\w+\s*;?\s*", "")
    rest = F.regexp_replace(rest, r"(?i)\s*endproperty\s*$", "")
    return F.when(F.regexp_like(code, F.lit(block)), _bare(strip(F.regexp_extract(code, block, 1)))).otherwise(_bare(rest))


def checker_signals(c: Column) -> Column:
    """Sorted distinct signals of an expression; without strings, sized literals, the known built-in names, and the checker's own ports."""
    text = F.regexp_replace(c, r'"[^"]*"', "")
    text = F.regexp_replace(text, r"\d+'[bBhHdDoO][0-9a-fA-FxXzZ_]+", "")
    for name in sorted(BUILTINS, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?i)\{name}\s*\(", "(")
    return _names(text, CHECKER_WORDS)


def formal_signals(c: Column) -> Column:
    """As checker_signals for the other engine: any $call loses its name, and `clk` is a signal."""
    text = F.regexp_replace(F.regexp_replace(c, r'"[^"]*"', ""), r"\d+'[bBhHdDoO][0-9a-fA-FxXzZ_]+", "")
    return _names(F.regexp_replace(text, rf"\${NAME}\s*\(", "("), FORMAL_WORDS)


def _names(text: Column, words: list[str]) -> Column:
    return F.array_sort(F.array_distinct(F.filter(identifiers(text), lambda n: ~F.lower(n).isin(words))))


def pair_signals(a: Column, b: Column, clock: Column) -> Column:
    """Signals of either of two expressions, without the clock, sorted."""
    return F.array_sort(F.array_except(F.array_union(checker_signals(a), checker_signals(b)), F.array(clock)))


def past_depths(c: Column) -> Column:
    """array(struct(signal, depth)), by signal: the deepest $past of each name; one cycle where no depth is given."""
    pattern = rf"(?i)\$past\s*\(\s*({NAME})\s*(?:,\s*(\d+))?\s*\)"
    uses = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("s"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("d"))
    uses = F.transform(uses, lambda u: F.struct(u["s"].alias("s"), F.when(u["d"] == "", F.lit(1)).otherwise(F.nullif(u["d"], F.lit("")).cast("int")).alias("d")))
    names = F.array_sort(F.array_distinct(F.transform(uses, lambda u: u["s"])))
    return F.transform(names, lambda n: F.struct(n.alias("signal"), F.array_max(F.transform(F.filter(uses, lambda u: u["s"] == n), lambda u: u["d"])).alias("depth")))


def merged_depths(a: Column, b: Column) -> Column:
    """The depths of two expressions as a map; where both have a signal, the second's depth stands."""
    x, y = (F.map_from_entries(past_depths(e)) for e in (a, b))
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.array_contains(F.map_keys(y), k)), y)


def unsupported_functions(c: Column) -> Column:
    """Built-in functions called that the prover doesn't know, sorted."""
    others = sorted(set(BUILTINS) - set(PROVER_FUNCTIONS))
    return F.array_compact(F.array(*[F.when(F.regexp_like(c, F.lit(rf"(?i)\{n}\s*\(")), F.lit(n)) for n in others]))


def has_if_else(c: Column) -> Column:
    """Whether a conditional property stands there, which the prover doesn't take."""
    return F.regexp_like(c, F.lit(r"(?is)\bif\s*\([^)]+\)\s*[^|]*\|[-=]>.*\belse\b"))


# tool logs

_INTERNAL = ("invariant violation", "invariant check failed", "segmentation fault", "aborted", "internal error")
_SYNTAX = (
    ("syntax error", "Syntax error in SVA"),
    ("parse error", "Parse error in SVA"),
    ("parsing error", "Parsing error in SVA"),
    ("expected", "Syntax error: unexpected token"),
    ("expecting", "Syntax error: expecting element"),
    ("unexpected", "Syntax error: unexpected token"),
    ("unterminated", "Syntax error: unterminated construct"),
    ("missing", "Syntax error: missing element"),
    ("invalid", "Syntax error: invalid construct"),
    ("unrecognized", "Syntax error: unrecognized element"),
    ("unknown identifier", "Unknown identifier in SVA"),
    ("unknown preprocessor directive", "Syntax error: unknown preprocessor directive"),
    ("undeclared", "Undeclared identifier in SVA"),
    ("after backtick", "Syntax error: invalid backtick usage"),
)
_GENERAL = ("error:", "conversion error", "type error", "cannot open", "file not found")
_HINTS = ("line", "column", "token", "character")


def _has(low: Column, *words: str) -> Column:
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


def error_detail(log: Column) -> Column:
    """The first line, stripped, that speaks of an error and is shorter than 200 characters; empty if none."""
    lines = F.filter(F.split(log, "\n"), lambda x: F.regexp_like(F.lower(x), F.lit("error|expected|unexpected")))
    lines = F.filter(F.transform(lines, strip), lambda x: (x != "") & (F.length(x) < 200))
    return F.when(log.isNotNull(), F.coalesce(F.get(lines, 0), F.lit("")))


def log_category(log: Column, tool: str = "EBMC") -> Column:
    """struct(is_error, is_syntax_error, message): a tool's crash, a refutation (no error), a syntax error, a general error, or none of them."""
    low, detail = F.lower(log), error_detail(log)

    def kind(error: bool, syntax: bool, message: Column) -> Column:
        return F.struct(F.lit(error).alias("is_error"), F.lit(syntax).alias("is_syntax_error"), message.alias("message"))

    def told(head: str, joint: str = ": ") -> Column:
        return F.when(detail != "", F.concat(F.lit(head + joint), detail)).otherwise(F.lit(head))

    out = F.when(log.isNull(), F.lit(None))
    for w in _INTERNAL:
        out = out.when(_has(low, w), kind(True, False, F.lit(f"{tool} internal error: {w}")))
    out = out.when(_has(low, "refuted") | (_has(low, "violated") & ~_has(low, "invariant")), kind(False, False, F.lit("")))
    for w, message in _SYNTAX:
        out = out.when(_has(low, w), kind(True, True, told(message)))
    general = _has(low, *_GENERAL)
    out = out.when(general & _has(low, *_HINTS), kind(True, True, told("SVA syntax error"))).when(general, kind(True, False, told(f"{tool} error")))
    return out.otherwise(kind(False, False, F.lit("")))


def counterexample(log: Column) -> Column:
    """Up to 51 lines from the first that begins a trace; null if none does."""
    lines = F.split(log, "\n")
    starts = F.transform(lines, lambda x: F.regexp_like(F.lower(x), F.lit("counterexample|refuted|state|cycle")))
    at = F.array_position(starts, True)
    return F.when(at > 0, F.array_join(F.slice(lines, at.cast("int"), 51), "\n"))


def formal_report(log: Column) -> Column:
    """struct(result, message) of the second engine's report on its one assertion."""
    low = F.lower(log)

    def said(result: str, message: str) -> Column:
        return F.struct(F.lit(result).alias("result"), F.lit(message).alias("message"))

    out = F.when(log.isNull(), F.lit(None)).when(_has(low, "error") & ~_has(low, "report_fv"), said("error", "VCFormal error (see log)"))
    for pattern, result, message in (
        (r"\bproven\b", "implies", "Antecedent implies consequent (VCFormal proven)"),
        (r"\bfalsif", "not_implies", "Antecedent does not imply consequent (VCFormal falsified)"),
        (r"\bfail", "not_implies", "Antecedent does not imply consequent (VCFormal failed)"),
        (r"\binconclusive\b", "error", "VCFormal inconclusive on assertion"),
        (r"\bvacuous\b", "error", "VCFormal vacuous proof on assertion"),
    ):
        out = out.when(F.regexp_like(log, F.lit(rf"(?i)assert_consequent.*{pattern}")), said(result, message))
    unsure = _has(low, "assert_consequent") & ~_has(low, "proven") & ~_has(low, "falsif")
    return out.when(unsure, said("error", "VCFormal could not determine assertion status (see log)")).otherwise(said("error", "VCFormal output did not include recognizable property status"))


# common utilities


def clean(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fenced(c: Column) -> Column:
    """The text in the first code fence marked as the language, else in the first bare one, stripped; null if there is none."""
    marked, bare = (F.regexp_extract(c, rf"(?is)```{tag}\s*\n(.*?)```", 1) for tag in ("(?:systemverilog|verilog|sv)", ""))
    return F.coalesce(F.nullif(strip(marked), F.lit("")), F.nullif(strip(bare), F.lit("")))


def in_module(c: Column, name: str = "sva_wrapper") -> Column:
    """The text in a module of its own, unless the word module stands in it."""
    return F.when(F.contains(F.lower(c), F.lit("module")), c).otherwise(F.concat(F.lit(f"module {name};\n"), c, F.lit("\nendmodule")))


def expression_names(c: Column) -> Column:
    """Identifiers in order, with repeats, without strings, numbers and keywords."""
    text = F.regexp_replace(F.regexp_replace(c, r'"[^"]*"', ""), r"\b\d+'[bhd][\da-fA-F_]+\b", "")
    return F.filter(identifiers(F.regexp_replace(text, r"\b\d+\b", "")), lambda n: ~F.lower(n).isin(EXPRESSION_WORDS))


def syntax_check(c: Column) -> Column:
    """struct(is_valid, message): running balance of ( ) and [ ], then the counts of property and sequence words.

    An inline assertion alone has the word property without its end and is flagged so.
    """
    zero = F.struct(F.lit(0).alias("p"), F.lit(0).alias("b"), F.lit("").alias("bad"))

    def step(acc: Column, ch: Column) -> Column:
        p = acc["p"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)
        b = acc["b"] + F.when(ch == "[", 1).when(ch == "]", -1).otherwise(0)
        bad = F.when(acc["bad"] != "", acc["bad"]).when(p < 0, F.lit(")")).when(b < 0, F.lit("]")).otherwise(F.lit(""))
        return F.struct(p.cast("int").alias("p"), b.cast("int").alias("b"), bad.alias("bad"))

    signs = F.split(F.regexp_replace(c, r"[^()\[\]]", ""), "")
    end = F.aggregate(signs, zero, step)

    def count(word: str) -> Column:
        return F.regexp_count(c, F.lit(rf"(?i)\b{word}\b"))

    def said(message: Column) -> Column:
        return F.struct(F.lit(False).alias("is_valid"), message.alias("message"))

    def open_ones(field: str, kind: str, sign: str) -> Column:
        return said(F.concat(F.lit(f"Unbalanced {kind}: "), end[field].cast("string"), F.lit(f" unclosed '{sign}'")))

    def mismatch(word: str) -> Column:
        return said(F.concat(F.lit(f"Mismatched {word}/end{word}: "), count(word).cast("string"), F.lit(" vs "), count("end" + word).cast("string")))

    return (
        F.when(c.isNull(), F.lit(None))
        .when(end["bad"] == ")", said(F.lit("Unbalanced parentheses: extra ')'")))
        .when(end["bad"] == "]", said(F.lit("Unbalanced brackets: extra ']'")))
        .when(end["p"] != 0, open_ones("p", "parentheses", "("))
        .when(end["b"] != 0, open_ones("b", "brackets", "["))
        .when(count("property") != count("endproperty"), mismatch("property"))
        .when(count("sequence") != count("endsequence"), mismatch("sequence"))
        .otherwise(F.struct(F.lit(True).alias("is_valid"), F.lit(None).cast("string").alias("message")))
    )


def delay_spec(c: Column) -> Column:
    """struct(type, min, max, unbounded) of a delay at the start of the text; exact 0 if there is none."""
    n = F.nullif(F.regexp_extract(c, r"^##(\d+)", 1), F.lit("")).cast("int")
    low = F.nullif(F.regexp_extract(c, r"^##\[(\d+):(\d+|\$)\]", 1), F.lit("")).cast("int")
    high = F.nullif(F.regexp_extract(c, r"^##\[(\d+):(\d+|\$)\]", 2), F.lit(""))

    def spec(kind: str, a: Column, b: Column, unbounded: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), a.cast("int").alias("min"), b.cast("int").alias("max"), unbounded.alias("unbounded"))

    return (
        F.when(c.isNull(), F.lit(None))
        .when(n.isNotNull(), spec("exact", n, n, F.lit(False)))
        .when(low.isNotNull(), spec("range", low, F.when(high != "$", high), high == "$"))
        .otherwise(spec("exact", F.lit(0), F.lit(0), F.lit(False)))
    )


def declaration(name: Column, width: Column, direction: str = "input", kind: str = "wire") -> Column:
    return F.when(width > 1, F.concat(F.lit(f"{direction} {kind} ["), (width - 1).cast("string"), F.lit(":0] "), name)).otherwise(F.concat(F.lit(f"{direction} {kind} "), name))


def entry_key(sva: Column, model: Column) -> Column:
    """The cache key of an enriched assertion."""
    return F.md5(F.concat(sva, F.lit("|"), model))


def item_key(svad: Column, reference: Column, model: Column) -> Column:
    """The cache key of a benchmark item."""
    return F.md5(F.concat(svad, F.lit("|"), reference, F.lit("|"), model))


def signal_info(p: Column) -> Column:
    """A description of a parsed struct's clock, reset, other signals and functions, a line each."""
    others = F.filter(F.transform(p["signals"], lambda s: s["name"]), lambda n: ~n.eqNullSafe(p["clock_signal"]) & ~n.eqNullSafe(p["reset_signal"]))
    names = F.array_sort(F.array_distinct(F.transform(p["builtin_functions"], lambda f: f["name"])))
    return F.concat_ws(
        "\n",
        F.lit("The following signals are used in this assertion:"),
        F.when(p["clock_signal"].isNotNull(), F.concat(F.lit("- Clock signal: "), p["clock_signal"], F.lit(" ("), p["clock_edge"], F.lit(")"))),
        F.when(p["reset_signal"].isNotNull(), F.concat(F.lit("- Reset signal: "), p["reset_signal"], F.when(p["reset_active_low"], " (active-low)").otherwise(" (active-high)"))),
        F.when(F.size(others) > 0, F.concat(F.lit("- Other signals: "), F.array_join(others, ", "))),
        F.when(F.size(names) > 0, F.concat(F.lit("- Built-in functions used: "), F.array_join(names, ", "))),
    )


def prompt(template: str, **parts: Column) -> Column:
    """A template with {name} places filled from columns."""
    out = F.lit(template)
    for name, c in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out


# line-wise and nested text, which expressions can't walk: Arrow batches through plain Python


def _batch(fn, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))

    return run


def reindented(c: Column, indent: int = 4) -> Column:
    return _batch(lambda x: pure.reindent(x, indent))(c)


def without_comments(c: Column) -> Column:
    return _batch(pure.strip_comments)(c)


def reply_code(c: Column) -> Column:
    """The code in a model's reply: the first candidate that passes the syntax check, else the first that isn't empty."""
    return _batch(pure.reply_code)(c)


def nested_calls(c: Column) -> Column:
    """array(struct(name, arguments)): built-in calls up to the first closing parenthesis, arguments split outside parentheses."""
    return _batch(pure.nested_calls, "array<struct<name:string,arguments:array<string>>>")(c)


def past_registers(c: Column) -> Column:
    """Shift-register text for every signal that $past refers to, to the depth it needs."""
    return _batch(pure.past_registers)(c)
