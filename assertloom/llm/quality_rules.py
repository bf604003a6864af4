"""Operator 7, quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assertloom.llm.common import WS, Table

#: Function words of the four languages of the corpus; running text has them, lists and junk don't.
STOP_WORDS = (
    "the of and to in is it that for with by on as at this be are from or an "
    "le la les de des du et un une en que qui dans pour par sur au est "
    "der die das und zu den mit nicht von auf ist sich ein eine "
    "el los las y por con para una del se no su"
).split()
#: Signs that prose has none or few of.
SYMBOLS = "#$%&*|@^~_=+<>{}[]\\/!"


class Rule(NamedTuple):
    """A document fails when `metric` lies outside [low, high]; None: no bound. Below `min_words` the rule doesn't apply."""

    name: str
    metric: str
    low: float | None
    high: float | None
    min_words: int = 0


#: The production table. Bounds on ratios are wide of what clean prose shows, in any of the languages.
RULES = (
    Rule("length", "words", 1, None),
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.10),
    Rule("stop_words", "stop_word_ratio", 0.03, None, 40),
    Rule("short_lines", "repeated_line_ratio", None, 0.50, 40),
    Rule("variety", "distinct_word_ratio", 0.15, None, 40),
    Rule("capitals", "capital_word_ratio", None, 0.60, 20),
)


def _metrics(text: Column) -> dict[str, tuple[str, Column]]:
    """Each metric as layers of the projection: helper columns (leading underscore) come first, ratios use them by name."""
    words = F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, r"\n"), lambda x: x != "")
    n = F.greatest(F.col("words"), F.lit(1))
    return {
        "_words": ("", words),
        "_lines": ("", lines),
        "words": ("1", F.size("_words").cast("long")),
        "lines": ("1", F.size("_lines").cast("long")),
        "_chars": ("1", F.length(text)),
        "_signs": ("1", F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
        "mean_word_chars": ("2", F.aggregate("_words", F.lit(0), lambda a, w: a + F.length(w)) / n),
        "symbol_ratio": ("2", F.col("_signs") / F.greatest(F.col("_chars"), F.lit(1))),
        "stop_word_ratio": ("2", F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))) / n),
        "distinct_word_ratio": ("2", F.size(F.array_distinct("_words")) / n),
        "capital_word_ratio": ("2", F.size(F.filter("_words", lambda w: (F.upper(w) == w) & (F.lower(w) != w))) / n),
        "repeated_line_ratio": ("2", 1 - F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1))),
    }


METRICS = ["words", "lines", "mean_word_chars", "symbol_ratio", "stop_word_ratio", "distinct_word_ratio", "capital_word_ratio", "repeated_line_ratio"]


def _layers(df: DataFrame, text: str) -> DataFrame:
    out = _metrics(F.coalesce(F.col(text), F.lit("")))
    for layer in ("", "1", "2"):
        df = df.withColumns({k: c for k, (at, c) in out.items() if at == layer})
    return df


def failed(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row with METRICS fails, in table order."""

    def breaks(r: Rule) -> Column:
        m = F.col(r.metric)
        out = F.lit(False)
        if r.low is not None:
            out = out | (m < r.low)
        if r.high is not None:
            out = out | (m > r.high)
        return out & (F.col("words") >= r.min_words) if r.min_words else out

    return F.concat_ws(",", *[F.when(breaks(r), F.lit(r.name)) for r in rules])


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, METRICS, failed, keep) for every row: `failed` names the broken rules with commas, `keep` is true if there is none.

    Null and empty texts, and such of white space alone, have 0 words and ratios of 0, so they fail "length" and "word_length". A null
    doc_id is carried. Repeated rows are judged each; other columns play no part, whatever their names; an empty table gives none.
    Texts of any length are read whole. A rule with `min_words` leaves shorter texts alone, whose ratios mean little.
    """
    df = _layers(Table(docs).pick(_id=doc_id, _text=text), "_text")
    return df.select(F.col("_id").alias("doc_id"), *[F.round(m, 6).alias(m) if m not in ("words", "lines") else F.col(m) for m in METRICS], failed(rules).alias("failed"), (failed(rules) == "").alias("keep"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that break no rule, with all their columns."""
    t = Table(docs)
    return t.back(_layers(t.df, t.inner(text)).where(failed(rules) == ""))


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_rule(r: Rule) -> str:
    parts = ([f"{r.metric} < {r.low}"] if r.low is not None else []) + ([f"{r.metric} > {r.high}"] if r.high is not None else [])
    return f"CASE WHEN ({' OR '.join(parts)}){f' AND words >= {r.min_words}' if r.min_words else ''} THEN '{r.name}' END"


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same over DuckDB; its split is by the same white space."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    signs = SYMBOLS.replace("\\", "\\\\").replace("]", "\\]").replace("[", "\\[").replace("^", "\\^")
    flags = ", ".join(_sql_rule(r) for r in rules)
    rounded = ", ".join(m if m in ("words", "lines") else f"round({m}, 6) AS {m}" for m in METRICS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM t),
m AS (SELECT doc_id, len(w)::BIGINT AS words, len(l)::BIGINT AS lines,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE / greatest(len(w), 1) AS mean_word_chars,
  (length(text) - length(regexp_replace(text, '[{signs}]', '', 'g')))::DOUBLE / greatest(length(text), 1) AS symbol_ratio,
  len(list_filter(w, lambda x: lower(x) IN ({stops})))::DOUBLE / greatest(len(w), 1) AS stop_word_ratio,
  len(list_distinct(w))::DOUBLE / greatest(len(w), 1) AS distinct_word_ratio,
  len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x))::DOUBLE / greatest(len(w), 1) AS capital_word_ratio,
  1 - len(list_distinct(l))::DOUBLE / greatest(len(l), 1) AS repeated_line_ratio FROM s)
SELECT doc_id, {rounded}, concat_ws(',', {flags}) AS failed, concat_ws(',', {flags}) = '' AS keep FROM m"""
