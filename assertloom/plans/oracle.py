"""DuckDB SQL for the queries of plans/catalogue.py, put together from pieces that mirror the column functions."""

from __future__ import annotations

from assertloom.functions import text as T
from assertloom.functions.names import BUILTINS
from assertloom.functions.parse import BLOCK, CLOCK, DISABLE, INLINE, KEYWORDS, NAME
from assertloom.operators.coverage import TABLE
from assertloom.plans.corpus import ASSERTIONS, CHECKS, ENTRIES, LOGS, RESULTS

NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip_end(x: str) -> str:
    return strip(f"regexp_replace({strip(x)}, '^;+|;+$', '', 'g')")


def replaced(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def found(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}), '')"


def names(x: str, words: list[str]) -> str:
    known = ", ".join(map(q, words))
    return f"list_sort(list_distinct(list_filter(regexp_extract_all({x}, {q(rf'\b({NAME})\b')}, 1), lambda n: lower(n) NOT IN ({known}))))"


def joined(x: str, by: str = ",") -> str:
    return f"coalesce(array_to_string({x}, {q(by)}), '')"


def present(tests: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {q(n)} END" for t, n in tests) + "], lambda x: x IS NOT NULL)"


BODY = f"CASE WHEN regexp_matches(sva, {q(BLOCK)}) THEN {strip(f'regexp_extract(sva, {q(BLOCK)}, 1)')} WHEN regexp_matches(sva, {q(INLINE)}) THEN {strip(f'regexp_extract(sva, {q(INLINE)}, 1)')} ELSE sva END"
_DISABLE_LEFT = r"disable\s+iff\s*\([^)]+\)"


def _calls() -> str:
    each = [
        f"list_transform(regexp_extract_all(b, {q(rf'(?i)\{n}\s*\(([^)]*)\)')}, 1), lambda a: concat({q(n)}, '(', array_to_string(list_filter(list_transform(string_split(a, ','), lambda p: {strip('p')}), lambda p: p <> ''), '|'), ')'))"
        for n in BUILTINS
    ]
    return "flatten([" + ", ".join(each) + "])"


def _signals(b: str) -> str:
    x = f"CASE WHEN {b} = '' THEN sva ELSE {b} END"
    for p in (r'"[^"]*"', r"(?m)//.*$", r"(?s)/\*.*?\*/"):
        x = replaced(x, p)
    return names(replaced(x, rf"\${NAME}\s*\(", "("), KEYWORDS)


_RANGE = r"##\[(\d+):(\d+|\$)\]"
#: Everything that the parse queries show, a row a property.
PARSE = f"""
WITH corpus AS ({ASSERTIONS}),
b AS (SELECT prop_id, sva, {BODY} AS b, lower(sva) AS low, {strip(found("sva", DISABLE))} AS cond, {found("sva", CLOCK, 2)} AS clk FROM corpus),
c AS (SELECT *, {found("cond", rf"[!~]?\s*({NAME})")} AS rst, CASE WHEN contains(b, '|=>') THEN '|=>' WHEN contains(b, '|->') THEN '|->' END AS op FROM b),
p AS (SELECT prop_id, sva, b AS body, {found("sva", rf"property\s+({NAME})")} AS property_name,
  contains(low, 'assert') OR NOT (contains(low, 'assume') OR contains(low, 'cover')) AS is_assertion, contains(low, 'assume') AS is_assumption, contains(low, 'cover') AS is_cover,
  clk AS clock_signal, coalesce({found("sva", CLOCK, 1)}, 'posedge') AS clock_edge, rst AS reset_signal,
  CASE WHEN cond IS NULL THEN true ELSE starts_with(cond, '!') OR starts_with(cond, '~') END AS reset_active_low, cond AS disable_condition, op AS implication_type,
  {strip_end(replaced(replaced("substr(b, 1, strpos(b, op) - 1)", r"@\s*\([^)]+\)"), _DISABLE_LEFT))} AS antecedent, {strip_end("substr(b, strpos(b, op) + 3)")} AS consequent,
  {joined(f"list_transform({_signals('b')}, lambda n: concat(n, ':', (regexp_matches(n, '(?i)^(clk|clock)') OR n IS NOT DISTINCT FROM clk)::VARCHAR, ':', (regexp_matches(n, '(?i)^(rst|reset)') OR n IS NOT DISTINCT FROM rst)::VARCHAR))")} AS signals,
  {joined(_calls())} AS builtin_functions,
  {joined(f"list_concat(list_transform(regexp_extract_all(b, '##([0-9]+)', 1), lambda n: concat(n::INT::VARCHAR, '-', n::INT::VARCHAR)), list_transform(regexp_extract_all(b, {q(_RANGE)}), lambda m: concat(regexp_extract(m, {q(_RANGE)}, 1)::INT::VARCHAR, '-', CASE WHEN contains(m, '$') THEN '$' ELSE regexp_extract(m, {q(_RANGE)}, 2)::INT::VARCHAR END)))")} AS delays,
  {joined(present([(f"contains(b, {q(s)})", s) for s in ("##", "[*", "[->", "[=")] + [(f"contains(lower(b), {q(s)})", s) for s in ("throughout", "within", "intersect")] + [(f"regexp_matches(b, {q(rf'(?i)\b{w}\b')})", w) for w in ("and", "or", "not")] + [("contains(lower(b), 'first_match')", "first_match")]))} AS temporal_operators
  FROM c)
"""

_TICKS = strip(replaced(strip("sva"), "^`+|`+$"))
_PLAIN_CLOCK = r"@\s*\(\s*(posedge|negedge)\s+\w+\s*\)"


def _bare(x: str) -> str:
    return strip_end(replaced(replaced(replaced(x, _PLAIN_CLOCK), _DISABLE_LEFT), r"\s+", " "))


_BLOCK2 = r"(?is)property\s+\w+\s*;?\s*(.*?)\s*endproperty"
_WRAP = r"(?is)(assert|assume|cover)\s+property\s*\(\s*(.*?)\s*\)\s*;?\s*$"
NORMAL = f"""
WITH corpus AS ({ASSERTIONS}),
c AS (SELECT prop_id, sva, {_TICKS} AS code FROM corpus),
r AS (SELECT *, {replaced(replaced("code", r"(?s)\s+else\s+\$\w+\s*\([^;]*\)\s*;?\s*$"), r"^\s*\w+\s*:\s*")} AS rest FROM c),
s AS (SELECT *, CASE WHEN regexp_matches(rest, {q(_WRAP)}) THEN {strip(f"regexp_extract(rest, {q(_WRAP)}, 2)")} ELSE rest END AS un FROM r),
n AS (SELECT prop_id, sva, code, CASE WHEN regexp_matches(code, {q(_BLOCK2)}) THEN {_bare(strip(f"regexp_extract(code, {q(_BLOCK2)}, 1)"))}
  ELSE {_bare(replaced(replaced("un", r"(?i)^\s*property\s+\w+\s*;?\s*"), r"(?i)\s*endproperty\s*$"))} END AS body FROM s)
"""


def _checker_signals(x: str) -> str:
    x = replaced(replaced(x, r'"[^"]*"'), r"\d+'[bBhHdDoO][0-9a-fA-FxXzZ_]+")
    for n in sorted(BUILTINS, key=len, reverse=True):
        x = replaced(x, rf"(?i)\{n}\s*\(", "(")
    return names(x, T.CHECKER_WORDS)


def _formal_signals(x: str) -> str:
    x = replaced(replaced(x, r'"[^"]*"'), r"\d+'[bBhHdDoO][0-9a-fA-FxXzZ_]+")
    return names(replaced(x, rf"\${NAME}\s*\(", "("), T.FORMAL_WORDS)


_CLOCK_SPEC = rf"(?i)@\s*\(\s*(posedge|negedge)\s+({NAME})\s*\)"
_PAST = rf"(?i)\$past\s*\(\s*({NAME})\s*(?:,\s*(\d+))?\s*\)"
_IF_ELSE = r"(?is)\bif\s*\([^)]+\)\s*[^|]*\|[-=]>.*\belse\b"
_OTHERS = sorted(set(BUILTINS) - set(T.PROVER_FUNCTIONS))

_COVER = f"""
WITH corpus AS ({ASSERTIONS}),
constructs(construct, description, category, ord) AS (VALUES {", ".join(f"({q(k)}, {q(d)}, {q(c)}, {i})" for k, d, c, i in TABLE)}),
each AS (SELECT construct, description, category, ord, (length(sva) - length(replace(sva, construct, ''))) // length(construct) AS n FROM corpus CROSS JOIN constructs),
covered AS (SELECT construct, description, category, ord::INT AS ord, sum((n > 0)::INT)::BIGINT AS properties_with_construct, sum(n)::BIGINT AS occurrences, count(*) AS total_properties,
  sum((n > 0)::INT) * 100.0::DOUBLE / count(*) AS coverage_pct FROM each GROUP BY ALL)
"""


def _category() -> str:
    def told(head: str, joint: str = ": ") -> str:
        return f"CASE WHEN d <> '' THEN concat({q(head + joint)}, d) ELSE {q(head)} END"

    def has(*words: str) -> str:
        return "(" + " OR ".join(f"contains(low, {q(w)})" for w in words) + ")"

    arms = [(has(w), "true", "false", q(f"EBMC internal error: {w}")) for w in T._INTERNAL]
    arms.append(("contains(low, 'refuted') OR (contains(low, 'violated') AND NOT contains(low, 'invariant'))", "false", "false", "''"))
    arms += [(has(w), "true", "true", told(m)) for w, m in T._SYNTAX]
    arms += [(f"{has(*T._GENERAL)} AND {has(*T._HINTS)}", "true", "true", told("SVA syntax error")), (has(*T._GENERAL), "true", "false", told("EBMC error"))]
    case = lambda k, other: "CASE " + " ".join(f"WHEN {a[0]} THEN {a[k]}" for a in arms) + f" ELSE {other} END"
    return f"{case(1, 'false')} AS is_error, {case(2, 'false')} AS is_syntax_error, {case(3, repr(''))} AS message"


_LINES = f"string_split(log, {NL})"
_DETAIL = f"coalesce(list_filter(list_transform(list_filter({_LINES}, lambda x: regexp_matches(lower(x), 'error|expected|unexpected')), lambda x: {strip('x')}), lambda x: x <> '' AND length(x) < 200)[1], '')"
_AT = f"list_position(list_transform({_LINES}, lambda x: regexp_matches(lower(x), 'counterexample|refuted|state|cycle')), true)"
_CLEAN = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_given = lambda x: f"coalesce(length({x}) > 0, false)"
_RATE = lambda a, b: f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"

_METRICS = f"""
WITH results AS ({RESULTS}),
counts AS (SELECT model_name, count(*) AS total_items, count_if(relationship = 'equivalent')::BIGINT AS equivalent_count, count_if(relationship = 'generated_implies_reference')::BIGINT AS generated_implies_reference_count,
  count_if(relationship = 'reference_implies_generated')::BIGINT AS reference_implies_generated_count, count_if(relationship = 'no_relationship')::BIGINT AS no_relationship_count,
  count_if(relationship IS NULL OR relationship NOT IN ('equivalent', 'generated_implies_reference', 'reference_implies_generated', 'no_relationship'))::BIGINT AS error_count,
  coalesce(round(avg(generation_time), 6), 0) AS avg_generation_time, coalesce(round(avg(verification_time), 6), 0) AS avg_verification_time FROM results GROUP BY model_name),
metrics AS (SELECT *, {_RATE("equivalent_count", "total_items")} AS equivalent_rate, {_RATE("equivalent_count + generated_implies_reference_count + reference_implies_generated_count", "total_items")} AS any_implication_rate,
  {_RATE("total_items - error_count", "total_items")} AS success_rate FROM counts)
"""
PAIRED = """
SELECT o_orderkey AS item_idx, 'model_a' AS model_name, CASE WHEN o_custkey % 6 < 3 THEN 'equivalent' ELSE 'error' END AS relationship FROM orders
UNION ALL SELECT o_orderkey, 'model_b', CASE WHEN (o_orderkey + o_custkey) % 5 < 2 THEN 'equivalent' ELSE 'no_relationship' END FROM orders"""
_CV = f"WITH checks AS ({CHECKS}), cv AS (SELECT id, result AS result_a, other AS result_b, coalesce(result = other, false) AS aligned FROM checks)"
_ERRORS = "failure IS NOT NULL"
_KEY = "md5(concat(sva, '|', 'm1'))"
_CACHE = f"""WITH corpus AS ({ASSERTIONS}), items AS (SELECT prop_id, {_KEY} AS key FROM corpus),
cache AS (SELECT {_KEY} AS key, min(concat('done:', {_CLEAN("sva")})) AS payload FROM corpus WHERE starts_with(sva, 'property') GROUP BY 1)"""

#: Cumulative normal by Abramowitz and Stegun 7.1.26, as functions over x = z / sqrt(2).
_T = "(1 / (1 + 0.3275911 * x))"
_ERFC = f"({_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429))))) * exp(-x * x)"

_FENCE = lambda tag: strip(f"regexp_extract(sva, {q(rf'(?is)```{tag}\s*\n(.*?)```')}, 1)")
_COUNT = lambda w: f"len(regexp_extract_all(sva, {q(rf'(?i)\b{w}\b')}))"
_SIGNS = lambda a, b: f"list_transform(string_split(regexp_replace(sva, '[^()\\[\\]]', '', 'g'), ''), lambda c: CASE WHEN c = {q(a)} THEN 1 WHEN c = {q(b)} THEN -1 ELSE 0 END)"
_NEG = lambda v: f"list_position(list_transform(range(1, len({v}) + 1), lambda i: list_sum({v}[1:i]) < 0), true)"

SQL = {
    "coverage_by_construct": _COVER + "SELECT * FROM covered",
    "coverage_summary": _COVER
    + "SELECT max(total_properties) AS total_properties, count(*) AS constructs_total, sum((properties_with_construct > 0)::INT)::BIGINT AS constructs_covered, sum((properties_with_construct > 0)::INT)::DOUBLE / count(*) * 100 AS coverage_pct FROM covered",
    "coverage_missing": _COVER + "SELECT construct, description, ord FROM covered WHERE properties_with_construct = 0",
    "coverage_by_category": _COVER
    + "SELECT category, construct, grouping(category, construct)::BIGINT AS level, sum(occurrences)::BIGINT AS occurrences, sum((properties_with_construct > 0)::INT)::BIGINT AS constructs_covered FROM covered GROUP BY ROLLUP (category, construct)",
    "coverage_topn_per_category": _COVER
    + "SELECT category, construct, coverage_pct, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY coverage_pct DESC, ord)::INT AS rank FROM covered) WHERE rank <= 3",
    "construct_ranking": _COVER + "SELECT construct, occurrences, coverage_pct, ord FROM covered WHERE occurrences > 0 ORDER BY occurrences DESC, ord LIMIT 20",
    "coverage_by_prefix_size": _COVER.replace("each AS", "ranked AS (SELECT *, row_number() OVER (ORDER BY prop_id) AS rank FROM corpus), each AS", 1)
    + "SELECT size::INT AS size, count(DISTINCT construct) AS constructs_covered FROM (VALUES (100), (500), (1000), (5000), (10000)) s(size) LEFT JOIN (SELECT construct, min(rank) AS rank FROM ranked CROSS JOIN constructs WHERE contains(sva, construct) GROUP BY construct) ON rank <= size GROUP BY size",
    "construct_counts": _COVER.replace("SELECT construct, description", "SELECT prop_id, construct, description", 1) + "SELECT prop_id, construct, n AS occurrences FROM each WHERE n > 0",
    "parse_body": PARSE + "SELECT prop_id, body FROM p",
    "parse_name": PARSE + "SELECT prop_id, property_name FROM p",
    "parse_kind": PARSE + "SELECT prop_id, is_assertion, is_assumption, is_cover FROM p",
    "parse_clock": PARSE + "SELECT prop_id, clock_signal, clock_edge FROM p",
    "parse_disable": PARSE + "SELECT prop_id, disable_condition, reset_signal, reset_active_low FROM p",
    "parse_implication": PARSE + "SELECT prop_id, implication_type, antecedent, consequent FROM p",
    "parse_delays": PARSE + "SELECT prop_id, delays FROM p",
    "parse_temporal_ops": PARSE + "SELECT prop_id, temporal_operators FROM p",
    "parse_signals": PARSE + "SELECT prop_id, signals FROM p",
    "parse_builtins": PARSE + "SELECT prop_id, builtin_functions FROM p",
    "parse_full": PARSE + "SELECT * EXCLUDE (body, sva) FROM p",
    "file_properties": f"""WITH corpus AS ({ASSERTIONS}),
files AS (SELECT concat('file_', o_custkey, '.sv') AS path, string_agg(sva, {NL} ORDER BY prop_id) AS text FROM corpus JOIN orders ON prop_id = o_orderkey GROUP BY o_custkey),
f AS (SELECT path, 0 AS pass, regexp_extract_all(text, {q(r"(?i)property\s+\w+\s*;[\s\S]*?endproperty")}) AS m FROM files UNION ALL SELECT path, 1, regexp_extract_all(text, {q(r"(?i)(?:assert|assume|cover)\s+property\s*\([^;]*\)\s*;")}) FROM files)
SELECT path, pass::INT AS pass, (i - 1)::INT AS pos, m[i] AS sva FROM (SELECT path, pass, m, unnest(range(1, len(m) + 1)) AS i FROM f)""",
    "normalize": NORMAL + "SELECT prop_id, body FROM n",
    "clock_spec": NORMAL + f"SELECT prop_id, coalesce(lower({found('code', _CLOCK_SPEC, 1)}), 'posedge') AS edge, coalesce({found('code', _CLOCK_SPEC, 2)}, 'clk') AS clock FROM n",
    "checker_signals": NORMAL + f"SELECT prop_id, {joined(_checker_signals('body'))} AS checker, {joined(_formal_signals('body'))} AS formal FROM n",
    "past_depth": NORMAL
    + f"""SELECT prop_id, signal, max(depth)::INT AS depth FROM (SELECT prop_id, regexp_extract(m, {q(_PAST)}, 1) AS signal, coalesce(nullif(regexp_extract(m, {q(_PAST)}, 2), '')::INT, 1) AS depth
  FROM (SELECT prop_id, unnest(regexp_extract_all(sva, {q(_PAST)})) AS m FROM n)) GROUP BY prop_id, signal""",
    "unsupported_functions": NORMAL
    + f"SELECT prop_id, {joined(present([(f'regexp_matches(sva, {q(rf"(?i)\{n}\s*\(")})', n) for n in _OTHERS]))} AS functions, regexp_matches(sva, {q(_IF_ELSE)}) AS has_if_else FROM n",
    "clean": f"SELECT doc_id, {_CLEAN('text')} AS text FROM documents",
    "markdown_extract": f"WITH corpus AS ({ASSERTIONS}) SELECT prop_id, coalesce(nullif({_FENCE('(?:systemverilog|verilog|sv)')}, ''), nullif({_FENCE('')}, '')) AS code FROM corpus",
    "wrap_module": f"WITH corpus AS ({ASSERTIONS}) SELECT prop_id, CASE WHEN contains(lower(sva), 'module') THEN sva ELSE concat('module sva_wrapper;', {NL}, sva, {NL}, 'endmodule') END AS text FROM corpus",
    "syntax_check": f"""WITH corpus AS (SELECT prop_id, sva FROM ({ASSERTIONS}) UNION ALL SELECT -prop_id, replace(replace(replace(sva, '(valid', 'valid'), 'ack)', 'ack]'), '(a', 'a)(') FROM ({ASSERTIONS})),
v AS (SELECT *, {_SIGNS("(", ")")} AS p, {_SIGNS("[", "]")} AS b FROM corpus),
w AS (SELECT *, coalesce({_NEG("p")}, 0) AS np, coalesce({_NEG("b")}, 0) AS nb, coalesce(list_sum(p), 0)::INT AS sp, coalesce(list_sum(b), 0)::INT AS sb, {_COUNT("property")} AS c1, {_COUNT("endproperty")} AS c2, {_COUNT("sequence")} AS c3, {_COUNT("endsequence")} AS c4 FROM v),
m AS (SELECT prop_id, CASE WHEN np > 0 AND (nb = 0 OR np < nb) THEN 'Unbalanced parentheses: extra '')''' WHEN nb > 0 THEN 'Unbalanced brackets: extra '']'''
  WHEN sp <> 0 THEN concat('Unbalanced parentheses: ', sp, ' unclosed ''(''') WHEN sb <> 0 THEN concat('Unbalanced brackets: ', sb, ' unclosed ''[''')
  WHEN c1 <> c2 THEN concat('Mismatched property/endproperty: ', c1, ' vs ', c2) WHEN c3 <> c4 THEN concat('Mismatched sequence/endsequence: ', c3, ' vs ', c4) END AS message FROM w)
SELECT prop_id, message IS NULL AS is_valid, message FROM m""",
    "delay_spec": f"""WITH d AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat('##', p_size) WHEN 1 THEN concat('##[', p_size, ':', p_size + 3, ']') WHEN 2 THEN concat('##[', p_size, ':$]') ELSE p_type END AS s FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(s, {q("^" + _RANGE)}) THEN 'range' ELSE 'exact' END AS type, coalesce({found("s", r"^##(\d+)")}, {found("s", "^" + _RANGE)}, '0')::INT AS min,
 CASE WHEN regexp_matches(s, {q("^" + _RANGE)}) THEN nullif({found("s", "^" + _RANGE, 2)}, '$')::INT ELSE coalesce({found("s", r"^##(\d+)")}, '0')::INT END AS max, regexp_matches(s, {q(r"^##\[\d+:\$\]")}) AS unbounded FROM d""",
    "declaration": "SELECT p_partkey, CASE WHEN p_size > 1 THEN concat('input wire [', p_size - 1, ':0] sig_', p_partkey) ELSE concat('input wire sig_', p_partkey) END AS text FROM part",
    "prover_log_category": f"WITH logs AS ({LOGS}), d AS (SELECT event_id, lower(log) AS low, {_DETAIL} AS d FROM logs) SELECT event_id, {_category()} FROM d",
    "error_detail": f"WITH logs AS ({LOGS}) SELECT event_id, {_DETAIL} AS detail FROM logs",
    "counterexample": f"WITH logs AS ({LOGS}) SELECT event_id, CASE WHEN {_AT} > 0 THEN array_to_string({_LINES}[{_AT}:{_AT} + 50], {NL}) END AS trace FROM logs",
    "formal_report": f"""WITH logs AS ({LOGS}), r AS (SELECT event_id, CASE WHEN contains(lower(log), 'error') AND NOT contains(lower(log), 'report_fv') THEN 'error|VCFormal error (see log)'
 WHEN regexp_matches(log, {q(r"(?i)assert_consequent.*\bproven\b")}) THEN 'implies|Antecedent implies consequent (VCFormal proven)' WHEN regexp_matches(log, {q(r"(?i)assert_consequent.*\bfalsif")}) THEN 'not_implies|Antecedent does not imply consequent (VCFormal falsified)'
 WHEN regexp_matches(log, {q(r"(?i)assert_consequent.*\bfail")}) THEN 'not_implies|Antecedent does not imply consequent (VCFormal failed)' WHEN regexp_matches(log, {q(r"(?i)assert_consequent.*\binconclusive\b")}) THEN 'error|VCFormal inconclusive on assertion'
 WHEN regexp_matches(log, {q(r"(?i)assert_consequent.*\bvacuous\b")}) THEN 'error|VCFormal vacuous proof on assertion' WHEN contains(lower(log), 'assert_consequent') AND NOT contains(lower(log), 'proven') AND NOT contains(lower(log), 'falsif')
 THEN 'error|VCFormal could not determine assertion status (see log)' ELSE 'error|VCFormal output did not include recognizable property status' END AS r FROM logs)
SELECT event_id, string_split(r, '|')[1] AS result, string_split(r, '|')[2] AS message FROM r""",
    "entry_hash": f"WITH corpus AS ({ASSERTIONS}) SELECT prop_id, {_KEY} AS key FROM corpus",
    "cache_pending": _CACHE + " SELECT prop_id, key FROM items WHERE key NOT IN (SELECT key FROM cache)",
    "cache_hits": _CACHE + " SELECT prop_id, key, payload, true AS from_cache FROM items JOIN cache USING (key)",
    "cache_stats": _CACHE + " SELECT count(*) AS entries, coalesce(sum(strlen(payload)), 0)::BIGINT AS bytes FROM cache",
    "merge_dedup": f"""WITH e AS (SELECT 0 AS src, doc_id AS pos, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
SELECT pos, text FROM (SELECT *, row_number() OVER (PARTITION BY {_CLEAN("text")} ORDER BY src, pos) AS n FROM e WHERE {_CLEAN("text")} <> '') WHERE n = 1""",
    "split_80_10_10": """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id::VARCHAR, '|42')), doc_id) AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN i <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM d""",
    "dataset_validate": f"WITH e AS ({ENTRIES}) SELECT count(*) AS total, count_if({_given('SVAD')})::BIGINT AS with_svad, count_if({_given('CoT')})::BIGINT AS with_cot, count_if({_ERRORS})::BIGINT AS with_errors, {_RATE(f'count_if({_given("SVAD")})', 'count(*)')} AS svad_coverage, {_RATE(f'count_if({_given("CoT")})', 'count(*)')} AS cot_coverage FROM e",
    "dataset_stats": f"WITH e AS ({ENTRIES}), s AS (SELECT count(*) AS total, count_if({_given('SVA')})::BIGINT AS has_sva, count_if({_given('SVAD')})::BIGINT AS has_svad, count_if({_given('SVA')} AND {_given('SVAD')})::BIGINT AS has_both, count_if({_given('CoT')})::BIGINT AS has_cot FROM e) SELECT *, "
    + ", ".join(f"{_RATE(f'has_{k} * 100', 'total')} AS pct_{k}" for k in ("sva", "svad", "both", "cot"))
    + " FROM s",
    "quality_filter": f"WITH e AS ({ENTRIES}) SELECT pos, SVA, SVAD, CoT FROM e WHERE NOT ({_ERRORS}) AND coalesce(length(SVAD), 0) >= 50 AND {_given('CoT')}",
    "benchmarkable": f"WITH e AS ({ENTRIES}) SELECT pos, SVA, SVAD FROM e WHERE length(SVA) > 0 AND length(SVAD) > 0",
    "entries_as_json": f"WITH e AS ({ENTRIES}) SELECT json_merge_patch('{{}}', to_json({{'SVA': coalesce(SVA, ''), 'SVAD': SVAD, 'CoT': CoT, 'metadata': CASE WHEN failure IS NOT NULL THEN MAP {{failure: 'failed'}} END}}))::VARCHAR AS value FROM e",
    "chat_samples": f"""WITH e AS ({ENTRIES}) SELECT to_json({{'messages': [{{'role': 'system', 'content': 'You write SystemVerilog assertions.'}}, {{'role': 'user', 'content': SVAD}}, {{'role': 'assistant', 'content': SVA}}]}})::VARCHAR AS value
FROM e WHERE length(SVA) > 0 AND length(SVAD) > 0 AND failure IS NULL""",
    "length_buckets": r"""WITH t AS (SELECT length(text) AS c, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM documents)
SELECT count(*) AS total, round(avg(c), 6) AS avg_chars, max(c)::BIGINT AS max_chars, round(avg(w), 6) AS avg_words, max(w)::BIGINT AS max_words, count_if(w < 15)::BIGINT AS short, count_if(w >= 15 AND w < 30)::BIGINT AS medium, count_if(w >= 30)::BIGINT AS long FROM t""",
    "model_metrics": _METRICS + "SELECT * FROM metrics",
    "model_compare": _METRICS
    + """, m AS (SELECT list(struct_pack(m := model_name, e := equivalent_rate, a := any_implication_rate, s := success_rate, g := avg_generation_time) ORDER BY model_name) AS m FROM metrics)
SELECT array_to_string(list_transform(m, lambda x: x.m), ',') AS models, array_to_string(list_transform(m, lambda x: round(x.e, 6)::VARCHAR), ',') AS equivalent_rates, list_max(list_transform(m, lambda x: x.e)) AS best_equivalent_rate,
 list_filter(m, lambda x: x.e = list_max(list_transform(m, lambda y: y.e)))[1].m AS best_equivalent_model, list_max(list_transform(m, lambda x: x.a)) AS best_any_implication_rate,
 list_filter(m, lambda x: x.a = list_max(list_transform(m, lambda y: y.a)))[1].m AS best_implication_model FROM m""",
    "pair_summary": f"WITH c AS ({CHECKS}), s AS (SELECT count(*) AS total, count_if(result = 'equivalent')::BIGINT AS equivalent, count_if(result = 'not_implies')::BIGINT AS not_equivalent, count_if(result = 'error')::BIGINT AS errors, count_if(result = 'timeout')::BIGINT AS timeouts, count_if(forward AND NOT backward)::BIGINT AS forward_only, count_if(NOT forward AND backward)::BIGINT AS backward_only FROM c) SELECT *, {_RATE('equivalent * 100', 'total')} AS equivalent_pct FROM s",
    "relationship_labels": f"WITH c AS ({CHECKS}) SELECT id, CASE WHEN forward IS NULL OR backward IS NULL OR result = 'error' THEN 'error' WHEN forward AND backward THEN 'equivalent' WHEN forward THEN 'generated_implies_reference' WHEN backward THEN 'reference_implies_generated' ELSE 'no_relationship' END AS relationship FROM c",
    "cross_validation": _CV + " SELECT * FROM cv",
    "cross_validation_mismatches": _CV + " SELECT * FROM cv WHERE result_b IS NOT NULL AND NOT aligned",
    "cross_validation_summary": _CV
    + """, counted AS (SELECT 'a' AS side, result_a AS k, count(*) AS n FROM cv GROUP BY 2 UNION ALL SELECT 'b', result_b, count(*) FROM cv WHERE result_b IS NOT NULL GROUP BY 2)
SELECT (SELECT count(*) FROM cv) AS total, (SELECT count_if(aligned)::BIGINT FROM cv) AS aligned, (SELECT count_if(result_b IS NOT NULL AND NOT aligned)::BIGINT FROM cv) AS mismatched, (SELECT count_if(result_b IS NULL)::BIGINT FROM cv) AS skipped,
 (SELECT string_agg(concat(k, '=', n), ',' ORDER BY k) FROM counted WHERE side = 'a') AS result_a_counts, (SELECT string_agg(concat(k, '=', n), ',' ORDER BY k) FROM counted WHERE side = 'b') AS result_b_counts""",
    "mcnemar_table": f"""WITH r AS ({PAIRED}), t AS (SELECT count_if(x.relationship = 'equivalent' AND y.relationship = 'equivalent')::BIGINT AS "both", count_if(x.relationship = 'equivalent' AND y.relationship <> 'equivalent')::BIGINT AS only_a,
 count_if(x.relationship <> 'equivalent' AND y.relationship = 'equivalent')::BIGINT AS only_b, count_if(x.relationship <> 'equivalent' AND y.relationship <> 'equivalent')::BIGINT AS neither FROM r x JOIN r y ON x.item_idx = y.item_idx AND x.model_name = 'model_a' AND y.model_name = 'model_b'),
z AS (SELECT *, only_a + only_b AS n, greatest(abs(only_a - only_b) - 1, 0)::DOUBLE / sqrt(greatest(only_a + only_b, 1)) / sqrt(2) AS x FROM t)
SELECT "both", only_a, only_b, neither, round(CASE WHEN n = 0 THEN 1.0 WHEN n <= 1000 THEN least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) ELSE least(1.0, {_ERFC}) END, 6) AS p_value FROM z""",
    "batch_tally": f"WITH g AS (SELECT l_orderkey AS batch, bool_or(l_returnflag <> 'R') AS ok, count(*) AS n, count_if(l_returnflag <> 'R') AS v FROM lineitem GROUP BY 1) SELECT count(*) AS batches, count_if(ok)::BIGINT AS valid_batches, sum(n)::BIGINT AS properties, sum(v)::BIGINT AS valid_properties, {_RATE('sum(v)', 'sum(n)')} AS property_rate FROM g",
    "health_summary": "SELECT count(*) AS total, count_if(s_acctbal >= 0)::BIGINT AS success, count_if(NOT s_acctbal >= 0)::BIGINT AS failed FROM supplier",
    "work_items": "SELECT model_name, item_id, md5(concat(text, '|', text, '|', model_name)) AS key FROM benchmark CROSS JOIN (VALUES ('model_0'), ('model_1'), ('model_2')) m(model_name)",
    "explanation_score": "SELECT doc_id, 0.25::DOUBLE * (contains(text, '# ')::INT + contains(text, '```systemverilog')::INT + (contains(text, 'Step 1') AND contains(text, 'Step 2') AND contains(text, 'Step 3') AND contains(text, 'Step 4') AND contains(text, 'Step 5'))::INT + (length(text) >= 200)::INT) AS score FROM documents",
    "signal_info": PARSE
    + f""", i AS (SELECT prop_id, clock_signal, clock_edge, reset_signal, reset_active_low, list_filter(list_transform(string_split(signals, ','), lambda s: string_split(s, ':')[1]), lambda n: n <> '' AND n IS DISTINCT FROM clock_signal AND n IS DISTINCT FROM reset_signal) AS o,
 list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(builtin_functions, '\\$[a-z0-9]+\\('), lambda f: rtrim(f, '(')), lambda f: f IN ({", ".join(map(q, BUILTINS))})))) AS f FROM p)
SELECT prop_id, concat_ws({NL}, 'The following signals are used in this assertion:', CASE WHEN clock_signal IS NOT NULL THEN concat('- Clock signal: ', clock_signal, ' (', clock_edge, ')') END,
 CASE WHEN reset_signal IS NOT NULL THEN concat('- Reset signal: ', reset_signal, CASE WHEN reset_active_low THEN ' (active-low)' ELSE ' (active-high)' END) END, CASE WHEN len(o) > 0 THEN concat('- Other signals: ', array_to_string(o, ', ')) END,
 CASE WHEN len(f) > 0 THEN concat('- Built-in functions used: ', array_to_string(f, ', ')) END) AS info FROM i""",
    "cot_header": PARSE + f"SELECT prop_id, concat('# SVA Generation Chain-of-Thought', {NL}, {NL}, '**Property:** ', coalesce(property_name, 'Unnamed Property'), {NL}, '**Type:** ', CASE WHEN is_assumption THEN 'Assumption' WHEN is_cover THEN 'Cover' ELSE 'Assertion' END) AS content FROM p",
    "cot_assembly": PARSE
    + f"""SELECT prop_id, concat_ws({NL}, '## Step 4: Property Assembly', concat({NL}, '* **Implication Type:**'),
 CASE implication_type WHEN '|->' THEN '    * Overlapping (`|->`) - consequent evaluation starts in the same cycle as antecedent match' WHEN '|=>' THEN '    * Non-overlapping (`|=>`) - consequent evaluation starts one cycle after antecedent match' ELSE '    * No implication - simple property expression' END,
 concat({NL}, '* **Disable Condition:**'), CASE WHEN disable_condition <> '' THEN concat('    * `disable iff (', disable_condition, ')`') ELSE '    * None specified - property always active' END,
 CASE WHEN disable_condition <> '' AND reset_signal IS NOT NULL THEN concat('    * Property is disabled when reset `', reset_signal, '` is active ', CASE WHEN reset_active_low THEN 'low' ELSE 'high' END) END,
 concat({NL}, '* **Assertion Structure:**'), CASE WHEN clock_signal IS NULL THEN NULL WHEN implication_type IS NOT NULL THEN concat('    * `@(', clock_edge, ' ', clock_signal, ') ', antecedent, ' ', implication_type, ' ', consequent, '`')
 ELSE concat('    * `@(', clock_edge, ' ', clock_signal, ') ', CASE WHEN antecedent <> '' THEN antecedent WHEN consequent <> '' THEN consequent ELSE 'property_expression' END, '`') END) AS content FROM p""",
    "trace_sampled_values": """WITH e AS (SELECT user_id, event_id, ts, value > 50 AS x, event_type = 'purchase' AS y FROM events),
l AS (SELECT *, coalesce(lag(x) OVER w, false) AS px, coalesce(lag(x, 2) OVER w, false) AS px2, coalesce(max((x)::INT) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) = 1 AS soon FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, x AND NOT px AS rose, NOT x AND px AS fell, x = px AS stable, x <> px AS changed, px2 AS past_2, NOT y OR soon AS purchase_then_high FROM l""",
    "implication_pairs": """WITH p AS (SELECT o_orderkey AS id, 1 + o_custkey % 5 AS n, 1 + o_orderkey % 5 AS m FROM orders)
SELECT id, concat('req |-> ##[1:', n, '] ack') AS sva1, concat('req |-> ##[1:', m, '] ack') AS sva2, CASE WHEN n <= m THEN 'implies' ELSE 'not_implies' END AS forward, CASE WHEN m <= n THEN 'implies' ELSE 'not_implies' END AS backward,
 CASE WHEN n = m THEN 'equivalent' ELSE 'not_implies' END AS result, CASE WHEN n = m THEN 'equivalent' WHEN n < m THEN 'generated_implies_reference' ELSE 'reference_implies_generated' END AS relationship FROM p""",
    "implication_pairs_late": """WITH p AS (SELECT o_orderkey AS id, 9 + o_custkey % 12 AS n, 9 + o_orderkey % 12 AS m FROM orders)
SELECT id, concat('req |-> ##[1:', n, '] ack') AS sva1, concat('req |-> ##[1:', m, '] ack') AS sva2, CASE WHEN n <= m THEN 'implies' ELSE 'not_implies' END AS forward, CASE WHEN m <= n THEN 'implies' ELSE 'not_implies' END AS backward,
 CASE WHEN n = m THEN 'equivalent' ELSE 'not_implies' END AS result, CASE WHEN n = m THEN 'equivalent' WHEN n < m THEN 'generated_implies_reference' ELSE 'reference_implies_generated' END AS relationship FROM p""",
    "enrich": f"WITH corpus AS ({ASSERTIONS}) SELECT prop_id AS pos, sva AS SVA, sva AS SVAD FROM corpus WHERE length(sva) > 0",
    "evaluate": f"""WITH p AS (SELECT 1 + p_size % 5 AS n, 1 + p_partkey % 5 AS m FROM part), c AS (SELECT model_name, count(*) AS total_items, count_if(n = m)::BIGINT AS equivalent_count, count_if(n < m)::BIGINT AS generated_implies_reference_count,
 count_if(n > m)::BIGINT AS reference_implies_generated_count, 0::BIGINT AS no_relationship_count, 0::BIGINT AS error_count FROM p CROSS JOIN (VALUES ('m1'), ('m2')) v(model_name) GROUP BY model_name)
SELECT *, {_RATE("equivalent_count", "total_items")} AS equivalent_rate, {_RATE("total_items", "total_items")} AS any_implication_rate, {_RATE("total_items", "total_items")} AS success_rate FROM c""",
}
