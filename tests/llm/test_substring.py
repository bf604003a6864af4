"""Repeated passages against brute force over windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from assertloom.llm import recompression


def brute(rows, width):
    """(text, tokens cut) of every row, by a set of windows in order of (doc_id, hash, position)."""
    seen, out = {}, {}
    order = {}
    for key in sorted({(d, h, t) for d, h, t in rows if d is not None and t is not None}, key=lambda k: k[:2]):
        d, h, t = key
        pieces = re.findall(r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", t)
        words = [re.sub(r"[ \t\n\x0b\f\r]+", "", p) for p in pieces]
        cut = set()
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                cut |= set(range(i, i + width))
            seen.setdefault(w, (d, i))
        lead = re.match(r"[ \t\n\x0b\f\r]*", t)[0]
        order[key] = (t if not cut else lead + "".join(p for i, p in enumerate(pieces) if i not in cut), len(cut))
    for k in rows:
        out[k] = order.get(k, (k[2], 0))
    return out


def run(spark, rows, width, kind="long"):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    hashed = df.select("doc_id", F.xxhash64("text").alias("h"), "text")
    keys = [(r.doc_id, None if r.text is None else r.h, r.text) for r in hashed.collect()]
    want = brute(keys, width)
    got = recompression.substring_dedup(df, width)
    assert got.columns == ["doc_id", "text", "n_removed"]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted([(k[0], *want[k]) for k in keys], key=key)


@pytest.mark.parametrize("width, letters, seed", [(8, 2, 0), (8, 60, 1), (12, 3, 2), (50, 400, 3), (50, 3, 4)])
def test_against_brute_force(spark, width, letters, seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(letters)}"
    passages = [[word() for _ in range(width + r.randrange(3 * width))] for _ in range(4)]
    rows = []
    for i in range(60):
        body = []
        for _ in range(r.randrange(1, 4)):
            body += [word() for _ in range(r.randrange(3 * width))]
            if r.random() < 0.5:
                p = r.choice(passages)
                a = r.randrange(len(p))
                body += p[a:]
        rows.append((i, r.choice([" ", "\n", "  "]).join(body)))
    rows += [(3, rows[10][1]), (70, rows[11][1]), (70, rows[11][1]), (71, "x " * 300), (72, "a b " * 200), (73, " a b c " * 150), (None, rows[5][1]), (74, None), (75, ""), (76, " \n")]
    run(spark, rows, width)
    if seed == 1:
        run(spark, [(None if d is None else f"d{d % 7}-{d}", t) for d, t in rows], width, "string")


def test_isolated_passages_of_the_least_length_are_found(spark):
    """Each passage of exactly 50 tokens stands twice, in unrelated surroundings."""
    r = random.Random(9)
    word = lambda: f"v{r.randrange(30000)}"
    rows = []
    for i in range(300):
        p = [word() for _ in range(50)]
        for k in (0, 1):
            rows.append((2 * i + k, " ".join([word() for _ in range(60)] + p + [word() for _ in range(60)])))
    got = recompression.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_removed for r in got.orderBy("doc_id").collect()] == [0, 50] * 300


def test_a_passage_in_every_document(spark):
    """One passage in all of 3,000 texts, and a third of all rows equal to one."""
    r = random.Random(4)
    word = lambda: f"v{r.randrange(3000)}"
    p = [word() for _ in range(70)]
    rows = [(i, " ".join([word() for _ in range(r.randrange(20))] + p + [word() for _ in range(r.randrange(20))])) for i in range(3000)]
    run(spark, rows + [(5000 + i, rows[7][1]) for i in range(1500)], 50)


def test_all_columns_stay(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 5, "a"), (2, text, 6, "b")], "doc_id long, text string, n_chars long, n_removed string").withColumns({"_d": F.lit(1), "_r": F.lit("r"), "spans": F.lit(0)})
    got = recompression.substring_dedup(df).orderBy("doc_id").collect()
    assert got[0].asDict() == {"doc_id": 1, "text": text, "n_chars": 5, "_d": 1, "_r": "r", "spans": 0, "n_removed": 0}
    assert got[1].asDict() == {"doc_id": 2, "text": "", "n_chars": 0, "_d": 1, "_r": "r", "spans": 0, "n_removed": 60}


def test_query(agree):
    agree(recompression.query, recompression.ORACLE)


def test_empty(spark):
    assert recompression.substring_dedup(spark.createDataFrame([], "doc_id long, text string, n_chars long")).count() == 0
