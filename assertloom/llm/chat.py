"""Operator 3, chat formatting: budgeted windows of whole turns, chosen on prefix sums of turn tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertloom.llm.common import WS, Table, stream_groups

#: Tokens of a window, tokens of repeated history in it, and tokens that a turn's markers count for.
BUDGET, HISTORY, MARKERS = 512, 128, 4
SCHEMA = "window int, first_turn int, last_turn int, history_from int, n_tokens long, n_target_tokens long, loss_mask string, text string"


def spans(tokens: np.ndarray, system: int, budget: int = BUDGET, history: int = HISTORY) -> list[tuple[int, int, int]]:
    """(history from, first new, last new) of each window over turns with these token counts, as positions from 0.

    total[i] is the tokens before turn i. A window repeats the most turns before its first new one that are within `history` tokens and leave
    room for it, and takes new turns while they fit; a turn that doesn't fit even alone has a window of its own.
    """
    total = np.concatenate([[0], np.cumsum(tokens)])
    out, s = [], 0
    while s < len(tokens):
        least = max(total[s] - history, system + total[s + 1] - budget)
        h = min(s, int(np.searchsorted(total, least, side="left"))) if s else 0
        e = max(s, int(np.searchsorted(total, budget - system + total[h], side="right")) - 2)
        out.append((h, s, min(e, len(tokens) - 1)))
        s = out[-1][2] + 1
    return out


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Windows of every conversation: (conv_id, window, first_turn, last_turn, history_from, n_tokens, n_target_tokens, loss_mask, text).

    Turns go by `turn`, then role and text, and count from 1 without the system turns, which stand at the head of every window. A window
    is history_from..last_turn; what comes before first_turn repeats the window before. `loss_mask` has a digit for each turn shown, system turns
    included: 1 for an assistant turn that is new, 0 for all others, so every assistant turn is a target once. A turn counts its words (by
    ASCII white space) and MARKERS; a window keeps to `budget` unless the system turns and one turn alone exceed it.

    Rows with a null conv_id take no part; ids can be of any type that has an order. A null turn number sorts first; a null role is "unknown", never a target; a null text is empty.
    Equal rows of a conversation are one turn. A conversation of system turns alone has no window. Turns of any length are whole.
    Other columns play no part, whatever their names; an empty table gives none.
    """
    base = Table(turns).pick(conv_id=conv_id, turn=turn, role=role, text=text).where("conv_id IS NOT NULL")
    base = base.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("n", (F.regexp_count("text", F.lit(f"[^{WS}]+")) + MARKERS).cast("long"))

    def cut(pdf: pd.DataFrame) -> Iterator[tuple]:
        rows, last = [], None
        for row in zip(pdf["turn"], pdf["role"], pdf["text"], pdf["n"]):
            key = (None if pd.isna(row[0]) else row[0], *row[1:3])
            if key != last:
                rows.append(row)
            last = key
        head = [r for r in rows if r[1] == "system"]
        body = [r for r in rows if r[1] != "system"]
        system = sum(int(r[3]) for r in head)
        shown = [f"<|{r[1]}|>\n{r[2]}\n<|end|>\n" for r in body]
        top = "".join(f"<|system|>\n{r[2]}\n<|end|>\n" for r in head)
        for w, (h, s, e) in enumerate(spans(np.array([int(r[3]) for r in body], dtype=np.int64), system, budget, history)):
            target = [int(i >= s and body[i][1] == "assistant") for i in range(h, e + 1)]
            goal = sum(int(body[i][3]) for i, t in zip(range(h, e + 1), target) if t)
            n = system + sum(int(body[i][3]) for i in range(h, e + 1))
            yield pdf["conv_id"].iloc[0], w, s + 1, e + 1, h + 1, n, goal, "0" * len(head) + "".join(map(str, target)), top + "".join(shown[h : e + 1])

    return stream_groups(base, ["conv_id"], cut, f"conv_id {dict(base.dtypes)['conv_id']}, {SCHEMA}", ["turn", "role", "text"])


def query(spark, sf_dir: str) -> DataFrame:
    return chat_windows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) + {MARKERS} AS n,
  concat('<|', role, '|>', chr(10), text, chr(10), '<|end|>', chr(10)) AS shown FROM d),
s AS (SELECT conv_id, sum(n)::BIGINT AS sys, string_agg(shown, '' ORDER BY turn NULLS FIRST, text) AS top, repeat('0', count(*)::INT) AS zeros FROM t WHERE role = 'system' GROUP BY conv_id),
b AS (SELECT t.conv_id, role, n, shown, coalesce(sys, 0) AS sys, coalesce(top, '') AS top, coalesce(zeros, '') AS zeros,
  row_number() OVER w AS i, sum(n) OVER w AS p FROM t LEFT JOIN s ON s.conv_id = t.conv_id WHERE role <> 'system' WINDOW w AS (PARTITION BY t.conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
h AS (SELECT a.conv_id, a.i, a.sys, CASE WHEN a.i = 1 THEN 1 ELSE coalesce(min(x.i), a.i) END AS h
  FROM b a LEFT JOIN b x ON x.conv_id = a.conv_id AND x.i <= a.i AND a.p - a.n - (x.p - x.n) <= {HISTORY} AND a.sys + a.p - (x.p - x.n) <= {BUDGET} GROUP BY a.conv_id, a.i, a.sys),
e AS (SELECT h.conv_id, h.i, h.h, coalesce(max(y.i), h.i) AS e
  FROM h JOIN b x ON x.conv_id = h.conv_id AND x.i = h.h LEFT JOIN b y ON y.conv_id = h.conv_id AND y.i >= h.i AND h.sys + y.p - (x.p - x.n) <= {BUDGET} GROUP BY h.conv_id, h.i, h.h),
r(conv_id, k, s, h, e) AS (SELECT conv_id, 0, i, h, e FROM e WHERE i = 1 UNION ALL SELECT e.conv_id, k + 1, e.i, e.h, e.e FROM r JOIN e ON e.conv_id = r.conv_id AND e.i = r.e + 1)
SELECT r.conv_id, k::INT AS "window", s::INT AS first_turn, r.e::INT AS last_turn, r.h::INT AS history_from, (any_value(sys) + sum(n))::BIGINT AS n_tokens,
  coalesce(sum(n) FILTER (WHERE i >= s AND role = 'assistant'), 0)::BIGINT AS n_target_tokens,
  any_value(zeros) || string_agg(CASE WHEN i >= s AND role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY i) AS loss_mask, any_value(top) || string_agg(shown, '' ORDER BY i) AS text
FROM r JOIN b ON b.conv_id = r.conv_id AND b.i BETWEEN r.h AND r.e GROUP BY r.conv_id, k, s, r.h, r.e"""
