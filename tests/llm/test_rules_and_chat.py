"""Quality rules and chat windows, against SQL and plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from assertloom.llm import chat, quality_rules


def test_queries(agree):
    agree(quality_rules.query, quality_rules.oracle())
    agree(chat.query, chat.ORACLE)


def test_rules_on_odd_texts(spark):
    prose = "the cat of the house and the dog in it is for that with by on as at this be are from or an old one more word here we go on and on for forty words or so until there is enough text to judge"
    rows = [(1, None), (2, ""), (3, " \n "), (4, prose), (5, "#$% " * 50), (None, prose), (7, "WORD " * 30), (8, "z " * 50000), (4, prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit("x"), "failed": F.lit(1), "_words": F.lit(2)})
    out = quality_rules.quality_rules(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 9 and got[None].keep and got[4].failed == ""
    assert got[1].failed == got[2].failed == got[3].failed == "length,word_length" and got[1].words == 0
    assert "symbols" in got[5].failed and "capitals" in got[7].failed and "variety" in got[8].failed and got[8].words == 50000
    kept = quality_rules.passing(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4]
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_rules_use_no_python(spark, sf):
    plan = quality_rules.query(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_spans(tokens, system, budget, history):
    out, s = [], 0
    while s < len(tokens):
        h = s
        while s and h > 0 and sum(tokens[h - 1 : s]) <= history and system + sum(tokens[h - 1 : s + 1]) <= budget:
            h -= 1
        e = s
        while e + 1 < len(tokens) and system + sum(tokens[h : e + 2]) <= budget:
            e += 1
        out.append((h, s, e))
        s = e + 1
    return out


def test_spans_against_brute_force():
    for seed in range(300):
        r = random.Random(seed)
        tokens = [r.randint(1, 30) for _ in range(r.randint(0, 40))]
        args = r.choice([0, 5, 60]), r.choice([10, 40, 100]), r.choice([0, 15, 200])
        assert chat.spans(np.array(tokens, dtype=np.int64), *args) == brute_spans(tokens, *args)


def test_every_assistant_turn_is_a_target_once(spark):
    r = random.Random(3)
    rows = [(1, -1, "system", "be brief")]
    for t in range(60):
        rows.append((1, t, ("user", "assistant")[t % 2], "w " * r.randint(0, 200)))
    rows += [(2, 0, "system", "alone"), (None, 0, "user", "x"), (3, None, None, None), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (4, 1, "assistant", "x " * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit("x"), "window": F.lit(1)})
    out = sorted(chat.chat_windows(df).collect(), key=lambda w: (w.conv_id, w.window))
    by = {c: [w for w in out if w.conv_id == c] for c in (1, 2, 3, 4)}
    assert not by[2] and len(by[4]) == 1 and by[4][0].n_tokens == 5004
    assert [w.loss_mask for w in by[3]] == ["01"] and "<|unknown|>" in by[3][0].text
    assert all(w.n_tokens <= 512 and w.text.startswith("<|system|>\nbe brief") for w in by[1])
    assert sum(w.loss_mask.count("1") for w in by[1]) == 30
    assert [w.first_turn for w in by[1]] == [1, *(w.last_turn + 1 for w in by[1][:-1])]
    assert chat.chat_windows(df.limit(0)).count() == 0
