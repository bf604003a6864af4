"""N-gram Jaccard join and groups against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from assertloom.llm import ngram_join
from assertloom.llm.components import components


def grams(text, n=3):
    words = re.sub(r"[^\w \t\n\x0b\f\r]|_", "", text.lower()).split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, threshold=0.5):
    sets = [(d, grams(t)) for d, t in sorted({(d, t) for d, t in rows if d is not None and t}) if grams(t)]
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a != b and len(x & y) / len(x | y) >= threshold:
                out.add((min(a, b), max(a, b), round(len(x & y) / len(x | y), 6)))
    return out


def corpus(seed, n=150):
    r = random.Random(seed)
    base = [[f"w{r.randrange(500)}" for _ in range(r.randrange(3, 60))] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            words[r.randrange(len(words))] = f"w{r.randrange(500)}"
        rows.append((i, " ".join(words)))
    return rows + [(None, rows[0][1]), (200, None), (201, ""), (202, " \n"), (203, "!!!"), (204, "One"), (205, "one."), (206, "one two"), (0, rows[0][1]), (5, rows[6][1])]


def told(rows, threshold=0.5):
    """(doc_id, class_id, n_copies, n_links) of every row with a doc_id, sorted."""
    return sorted((d, *x) for (d, _), x in classes_of(rows, threshold))


def classes_of(rows, threshold=0.5):
    """((doc_id, text), (class_id, n_copies, n_links)) of every row with a doc_id."""
    texts = [(d, t) for d, t in rows if d is not None]
    rows = [(d, t, frozenset(grams(t)) if t else frozenset()) for d, t in rows if d is not None]
    copies, least = {}, {}
    for d, _, s in rows:
        copies[s] = copies.get(s, 0) + 1
        least[s] = min(d, least.get(s, d))
    sets = [s for s in copies if s]
    near = {s: [x for x in sets if x is not s and len(s & x) / len(s | x) >= threshold] for s in sets}
    first = {}
    for s in sets:
        if s not in first:
            seen, todo = {s}, [s]
            while todo:
                for x in near[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            first |= dict.fromkeys(seen, min(least[x] for x in seen))
    return [(key, (first[s], copies[s], len(near[s])) if s else (d, 1, 0)) for key, (d, _, s) in zip(texts, rows)]


@pytest.mark.parametrize("seed, tile", [(0, 1000), (1, 1000), (2, 5)])
def test_pairs_are_nearly_all_and_nothing_else(spark, seed, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "bands": F.lit("x"), "k": F.lit(None).cast("int")})
    got = [tuple(r) for r in ngram_join.class_pairs(df).collect()]
    want = {p for p in brute(rows) if p[2] < 1}
    assert len(got) == len(set(got)) and set(got) <= want
    # of the copies of a text only the least has pairs
    assert len(got) >= 0.97 * len({p for p in want if {p[0], p[1]} <= least_copies(rows)})


def least_copies(rows):
    least = {}
    for d, t in rows:
        if d is not None and t and grams(t):
            s = frozenset(grams(t))
            least[s] = min(d, least.get(s, d))
    return set(least.values())


@pytest.mark.parametrize("seed, tile, kind", [(0, 1000, "long"), (1, 5, "long"), (2, 1000, "string")])
def test_join_tells_every_document(spark, seed, tile, kind, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = corpus(seed)
    if kind == "string":
        rows = [(None if d is None else f"id {d:05}", t) for d, t in rows]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumns({"fp": F.lit(1), "class_id": F.lit("x"), "k": F.lit(None).cast("int")})
    # at a threshold of 0.5 with recall 0.9999, no link of these is lost
    got = sorted(tuple(r) for r in ngram_join.ngram_jaccard_join(df, recall=0.99999).collect())
    assert got == told(rows)


def test_a_group_of_a_third_of_all_rows(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = [(i, " ".join(base[:55] + [f"v{i % 700}"] + base[56:])) for i in range(1400)] + [(5000 + i, f"only {i} here {i * 7} and there {i * 11}") for i in range(2800)]
    got = sorted(tuple(x) for x in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(i, 0, 2, 699) for i in range(1400)] + [(5000 + i, 5000 + i, 1, 0) for i in range(2800)]


def test_bands_reach_the_recall():
    for t, recall in ((0.5, 0.99), (0.8, 0.9), (0.7, 0.95)):
        b, r = ngram_join.choose_bands(t, recall)
        assert 1 - (1 - t**r) ** b >= recall and b * r <= 128
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.05, 0.999, 16)


def test_survivors(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {key: c for key, (c, *_) in classes_of(rows)}
    kept = ngram_join.one_of_each_group(df.withColumn("Node", F.lit(1)), recall=0.99999)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert kept.columns == ["doc_id", "text", "Node"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(((d, t) for d, t in rows if d is None or by[d, t] == d), key=key)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(None, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(1, 2), (2, 1), (3, 4), (4, 5), (9, 3)]])
def test_components(spark, edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        want[x] = min(seen)
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted(want.items())


def test_query(agree):
    agree(ngram_join.query, ngram_join.ORACLE)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_jaccard_join(df).count() == 0 and ngram_join.class_pairs(df).count() == 0 and ngram_join.one_of_each_group(df).count() == 0
