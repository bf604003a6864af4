"""The quality classifier: fitting, lookup tables and held-out accuracy."""

import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assertloom.llm import quality_gam, quality_rules

BIG = "/root/testdata/sf0.1"


def test_fits_shapes_and_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)) | (np.abs(x[:, 2]) > 1.5)
    model = quality_gam.fit_gam(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert {(i, j) for i, j, _ in model.pairs} >= {(0, 1)}


def test_scores_are_sums_of_bins():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(500, 3)), r.random(500) > 0.6
    model = quality_gam.fit_gam(x, y)
    for row in x[:20]:
        at = [int(np.searchsorted(e, v, side="right")) for e, v in zip(model.edges, row)]
        want = model.intercept + sum(t[b] for t, b in zip(model.tables, at)) + sum(t[at[i], at[j]] for i, j, t in model.pairs)
        assert abs(model.log_odds(row[None])[0] - want) < 1e-9


@pytest.mark.parametrize("y, p", [([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_one_class_or_none(y, p):
    model = quality_gam.fit_gam(np.zeros((len(y), 2)), np.array(y))
    assert abs(model.predict(np.ones((1, 2)))[0] - p) < 1e-6


@pytest.mark.skipif(not os.path.isdir(BIG), reason="needs the larger tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    out = quality_gam.quality_classifier(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.where(half == 0)).join(labels.where(half == 1), "doc_id").collect()
    bad, good = [r for r in out if r.quality == 0 or r.toxic == 1], [r for r in out if r.quality == 1 and r.toxic == 0]
    low = [r for r in out if r.quality == 0]
    assert sum(not r.keep for r in low) >= 0.95 * len(low) and sum(r.keep for r in good) >= 0.98 * len(good)
    assert sum(not r.keep for r in bad) >= 0.95 * len(bad)
    toxic = [r for r in out if r.toxic == 1]
    assert sum(r.p_toxic >= 0.5 for r in toxic) >= 0.9 * len(toxic)


@pytest.mark.skipif(not os.path.isdir(BIG), reason="needs the larger tables")
def test_toxic_documents_of_every_language(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    held = docs.join(labels.where(half == 1), "doc_id").select("doc_id", "lang", "toxic", F.col("quality").alias("good"))
    out = quality_gam.quality_classifier(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.where(half == 0)).join(held, "doc_id").collect()
    missed = {g: (sum(r.p_toxic < 0.5 for r in out if r.toxic == 1 and r.lang == g), sum(r.toxic == 1 and r.lang == g for r in out)) for g in ("de", "en", "es", "fr")}
    print(missed, sum(r.p_toxic >= 0.5 for r in out if r.toxic == 0), sum(not r.keep for r in out if r.toxic == 0 and r.good == 1), sum(r.toxic == 0 and r.good == 1 for r in out), sum(r.keep for r in out if r.good == 0), sum(r.good == 0 for r in out))
    assert all(a <= 0.2 * n and n for a, n in missed.values()) and sum(a for a, _ in missed.values()) <= 0.1 * sum(n for _, n in missed.values())


def test_a_word_is_marked_in_spite_of_stray_uses(spark):
    rows = [(i, f"a{i} badword b{i} badword c{i} badword tail", 1, i % 5) for i in range(20)] + [(100 + i, f"x{i} badword " + "plain text here " * 40, 0, i % 5) for i in range(20)]
    for marks in quality_gam._marks(spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int")):
        assert marks == quality_gam.parts("badword")


def brute_marks(rows, left):
    """Marks by plain counting over (text, toxic, fold) of all folds but one."""
    bad, good, contexts = Counter(), Counter(), {}
    n_bad = n_good = toxic_rows = 0
    for text, toxic, fold in rows:
        if fold == left:
            continue
        toxic_rows += toxic
        last = ""
        for t in text.split():
            w = "".join(c for c in t.lower() if c.isalnum())
            if w:
                n_bad, n_good = n_bad + toxic, n_good + 1 - toxic
                for p in quality_gam.parts(w):
                    (bad if toxic else good)[p] += 1
                    if toxic:
                        contexts.setdefault(p, set()).add((w, last, fold))
            last = w
    least = max(quality_gam.CONTEXTS, toxic_rows // quality_gam.PER_CONTEXT)
    return {p for p, c in contexts.items() if len(c) >= least and (bad[p] + 0.5) * (n_good + 1) >= quality_gam.RATIO * (good[p] + 0.5) * (n_bad + 1)}


def test_query_against_brute_force(spark):
    """Features, marks and scores of the query over the table of sf0.01, each computed in plain Python."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(quality_gam.FOLDS)).alias("f")).collect()}
    marked = [(r.doc_id, r.quality, r.toxic) for r in labels.collect() if r.doc_id in texts]
    rows = [(texts[d], t, fold[d]) for d, _, t in marked]
    marks = [brute_marks(rows, f) for f in (*range(quality_gam.FOLDS), None)]

    def features(text, marks):
        words, lines = re.split("[ \t\n\x0b\f\r]+", text), [x for x in text.split("\n") if x]
        words = [w for w in words if w]
        n, c = max(1, len(words)), max(1, len(text))
        hits = sum(not marks.isdisjoint(quality_gam.parts(w)) for w in ("".join(x for x in t.lower() if x.isalnum()) for t in text.split()) if w)
        return [
            len(words), len(lines), sum(map(len, words)) / n, sum(x in quality_rules.SYMBOLS for x in text) / c, sum(w.lower() in quality_rules.STOP_WORDS for w in words) / n,
            len(set(words)) / n, sum(w.upper() == w and w.lower() != w for w in words) / n, 1 - len(set(lines)) / max(1, len(lines)), sum(x in "0123456789" for x in text) / c, hits, hits / max(1, len(text.split())),
        ]

    x = sorted((str(d), q, t, *features(texts[d], marks[fold[d]])) for d, q, t in marked)
    f = np.array([r[3:] for r in x], dtype=float)
    models = [quality_gam.fit_gam(f, np.array([float(y) for y in ys])) for ys in ([r[1] == 0 for r in x], [r[2] == 1 for r in x])]

    def chance(model, row):
        at = [sum(v >= e for e in edges) for edges, v in zip(model.edges, row)]
        return 1 / (1 + math.exp(-(model.intercept + sum(t[b] for t, b in zip(model.tables, at)) + sum(t[at[i], at[j]] for i, j, t in model.pairs))))

    got = {r.doc_id: r for r in quality_gam.query(spark, sf).collect()}
    assert len(got) == len(texts)
    for d, text in texts.items():
        low, toxic = (chance(m, features(text, marks[-1])) for m in models)
        assert abs(got[d].p_low - low) < 1e-4 and abs(got[d].p_toxic - toxic) < 1e-4, d
        assert got[d].keep == (got[d].p_low < 0.5 and got[d].p_toxic < 0.5)


def test_odd_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    more = spark.createDataFrame([(None, "a b"), (9000, None), (9001, ""), (9002, "z " * 50000), (9003, "same"), (9003, "same")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more).withColumns({"words": F.lit("x"), "_p": F.lit(1), "quality": F.lit("q")})
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (9000, 0, 1), (123456, None, 1)], "doc_id long, quality int, toxic int"), allowMissingColumns=True)
    out = quality_gam.quality_classifier(df, odd)
    rows = out.collect()
    assert out.columns == ["doc_id", "p_low", "p_toxic", "keep"] and len(rows) == df.count()
    same = [tuple(r) for r in rows if r.doc_id == 9003]
    assert same[0] == same[1]
    kept = quality_gam.accepted(df, odd)
    assert kept.columns == df.columns and kept.count() == sum(r.keep for r in rows)
    assert quality_gam.quality_classifier(df.limit(0), odd).count() == 0
    assert all(r.keep for r in quality_gam.quality_classifier(df, odd.limit(0)).collect())
