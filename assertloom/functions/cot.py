"""Step-by-step explanations of an assertion, assembled from its parsed struct by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assertloom.functions.names import BUILTIN_MEANINGS, OPERATOR_MEANINGS
from assertloom.functions.parse import delays, strip

TITLES = ("Header", "Interface & Clock Domain Analysis", "Semantic Mapping", "Sequence Construction", "Property Assembly", "Final SVA Code")


def _lines(*parts: Column | str) -> Column:
    """Lines, without those that are null; a part may be an array of lines."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _code(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _meaning(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def header(p: Column) -> Column:
    kind = F.when(p["is_assumption"], "Assumption").when(p["is_cover"], "Cover").otherwise("Assertion")
    return _code("# SVA Generation Chain-of-Thought\n\n**Property:** ", F.coalesce(p["property_name"], F.lit("Unnamed Property")), "\n**Type:** ", kind)


def interface(p: Column) -> Column:
    design = F.transform(F.filter(p["signals"], lambda s: ~s["is_clock"] & ~s["is_reset"]), lambda s: _code("`", s["name"], "`"))
    clocks = F.size(F.filter(p["signals"], lambda s: s["is_clock"]))
    reset = F.when(p["reset_signal"].isNotNull(), _code("    * Reset Signal: `", p["reset_signal"], "` (", F.when(p["reset_active_low"], "Active Low").otherwise("Active High"), ")"))
    return _lines(
        "## Step 1: Interface & Clock Domain Analysis",
        "\n* **Signals:**",
        F.when(F.size(design) > 0, _code("    * Design Signals: ", F.array_join(design, ", "))),
        "\n* **Clocks & Resets:**",
        F.when(p["clock_signal"].isNotNull(), _code("    * Primary Clock: `", p["clock_signal"], "` (", p["clock_edge"], ")")).otherwise("    * Primary Clock: Not specified (synchronous design assumed)"),
        reset.when(_given(p["disable_condition"]), _code("    * Disable Condition: `", p["disable_condition"], "`")),
        "\n* **Cross-Domain Check:** ",
        F.when(clocks > 1, "    * Multiple clock domains detected - synchronization may be needed").otherwise("    * Single clock domain - no CDC concerns"),
    )


def semantics(p: Column) -> Column:
    calls = F.transform(p["builtin_functions"], lambda f: _code("    * `", f["name"], "(", F.array_join(f["arguments"], ", "), ")`: ", _meaning(BUILTIN_MEANINGS, f["name"], "Custom function")))
    past = F.filter(p["builtin_functions"], lambda f: f["name"] == "$past")
    ago = F.transform(
        past,
        lambda f: F.when(F.size(f["arguments"]) >= 2, _code("    * Reference to `", F.get(f["arguments"], 0), "` from ", F.get(f["arguments"], 1), " cycles ago")).when(
            F.size(f["arguments"]) > 0, _code("    * Reference to previous value of `", F.get(f["arguments"], 0), "`")
        ),
    )
    return _lines(
        "## Step 2: Semantic Mapping (Primitives & Built-ins)",
        "\n* **Boolean Conditions:**",
        F.when(_given(p["antecedent"]), _code("    * Trigger condition: `", p["antecedent"], "`")),
        F.when(_given(p["consequent"]), _code("    * Response condition: `", p["consequent"], "`")),
        F.when(F.size(calls) > 0, "\n* **Edge/Change Detection & Built-in Functions:**"),
        F.when(F.size(calls) > 0, F.array_join(calls, "\n")),
        F.when(F.size(past) > 0, "\n* **Past Values:**"),
        F.nullif(F.array_join(ago, "\n"), F.lit("")),
    )


def _timing(c: Column) -> Column:
    found = delays(c)
    words = F.transform(
        found,
        lambda d: F.when(d["unbounded"], _code(d["min"].cast("string"), " to unbounded cycles"))
        .when((d["max"] != 0) & (d["max"] != d["min"]), _code(d["min"].cast("string"), " to ", d["max"].cast("string"), " cycles"))
        .otherwise(_code(d["min"].cast("string"), " cycle(s)")),
    )
    return F.when(F.size(found) > 0, _code("    * Timing: ", F.array_join(words, ", ")))


def sequences(p: Column) -> Column:
    a, b = p["antecedent"], p["consequent"]
    nested = F.regexp_like(b, F.lit(r"\([^)]*\[\*|\([^)]*##|throughout|within|intersect"))
    used = F.transform(p["temporal_operators"], lambda o: _code("    * `", o, "`: ", _meaning(OPERATOR_MEANINGS, o, "Unknown operator")))
    return _lines(
        "## Step 3: Sequence Construction (Bottom-Up)",
        F.when(_given(a), _lines("\n* **Sequence A (Trigger/Antecedent):**", "    * Description: The triggering condition that initiates property evaluation", _code("    * Logic: `", a, "`"), _timing(a))),
        F.when(
            _given(b),
            _lines(
                "\n* **Sequence B (Response/Consequent):**",
                "    * Description: The expected behavior when trigger occurs",
                _code("    * Logic: `", b, "`"),
                _timing(b),
                F.when(nested, "    * **Handling Nesting:** Complex nested temporal logic detected"),
            ),
        ),
        F.when(F.size(used) > 0, "\n* **Temporal Operators Used:**"),
        F.when(F.size(used) > 0, F.array_join(used, "\n")),
    )


def assembly(p: Column) -> Column:
    op, clocked = p["implication_type"], p["clock_signal"].isNotNull()
    event = _code("    * `@(", p["clock_edge"], " ", p["clock_signal"], ") ")
    plain = F.when(_given(p["antecedent"]), p["antecedent"]).when(_given(p["consequent"]), p["consequent"]).otherwise("property_expression")
    return _lines(
        "## Step 4: Property Assembly",
        "\n* **Implication Type:**",
        F.when(op == "|->", "    * Overlapping (`|->`) - consequent evaluation starts in the same cycle as antecedent match")
        .when(op == "|=>", "    * Non-overlapping (`|=>`) - consequent evaluation starts one cycle after antecedent match")
        .otherwise("    * No implication - simple property expression"),
        "\n* **Disable Condition:**",
        F.when(_given(p["disable_condition"]), _code("    * `disable iff (", p["disable_condition"], ")`")).otherwise("    * None specified - property always active"),
        F.when(
            _given(p["disable_condition"]) & p["reset_signal"].isNotNull(),
            _code("    * Property is disabled when reset `", p["reset_signal"], "` is active ", F.when(p["reset_active_low"], "low").otherwise("high")),
        ),
        "\n* **Assertion Structure:**",
        F.when(clocked & op.isNotNull(), F.concat(event, p["antecedent"], F.lit(" "), op, F.lit(" "), p["consequent"], F.lit("`"))).when(clocked, F.concat(event, plain, F.lit("`"))),
    )


def final(p: Column, code: Column) -> Column:
    names = F.array_sort(F.array_distinct(F.transform(p["builtin_functions"], lambda f: f["name"])))
    summary = F.concat_ws(
        " ",
        F.when(p["property_name"].isNotNull(), _code("Property `", p["property_name"], "`")),
        F.when(p["implication_type"] == "|->", "uses overlapping implication").when(p["implication_type"] == "|=>", "uses non-overlapping implication"),
        F.when(p["clock_signal"].isNotNull(), _code("synchronized to `", p["clock_signal"], "`")),
        F.when(F.size(names) > 0, _code("using built-in functions: ", F.array_join(names, ", "))),
    )
    return _lines("## Step 5: Final SVA Code", "\n```systemverilog", strip(code), "```", "\n**Summary:**", F.when(summary != "", F.concat(summary, F.lit("."))))


def sections(p: Column, code: Column) -> Column:
    """array(struct(title, content)), in order; null for a null struct."""
    parts = [header(p), interface(p), semantics(p), sequences(p), assembly(p), final(p, code)]
    return F.when(p.isNotNull(), F.array(*[F.struct(F.lit(t).alias("title"), c.alias("content")) for t, c in zip(TITLES, parts)]))


def explanation(p: Column, code: Column) -> Column:
    """The six sections with a blank line between them."""
    return F.when(p.isNotNull(), F.concat_ws("\n\n", header(p), interface(p), semantics(p), sequences(p), assembly(p), final(p, code)))
