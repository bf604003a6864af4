"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assertloom.llm import pivots


def brute(x, ids, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    return {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in zip(*np.nonzero(s >= threshold)) if ids[i] < ids[j]}


def told(ids, vectors, threshold):
    """(vec_id, class_id, n_copies, n_links) of every row, sorted; a vector that is None has no partner."""
    copies, least = {}, {}
    for i, v in zip(ids, vectors):
        if v is not None:
            copies[v] = copies.get(v, 0) + 1
            least[v] = min(i, least.get(v, i))
    near, first = {v: [] for v in copies}, {}
    for d in {len(v) for v in copies}:
        own = [v for v in copies if len(v) == d]
        u = np.array(own) / np.linalg.norm(np.array(own), axis=1, keepdims=True)
        for i, row in enumerate(u @ u.T >= threshold):
            near[own[i]] = [own[j] for j in np.flatnonzero(row) if j != i]
    for v in copies:
        if v not in first:
            seen, todo = {v}, [v]
            while todo:
                for x in near[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            first |= dict.fromkeys(seen, min(least[x] for x in seen))
    return sorted((i, i, 1, 0) if v is None else (i, first[v], copies[v], len(near[v])) for i, v in zip(ids, vectors))


def clustered(seed, n=1500, d=24):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 4, d))
    x = centres[r.integers(0, len(centres), n)] + r.normal(size=(n, d)) * r.choice([0.02, 0.1, 0.2], (n, 1))
    x[10:14] = x[9]
    return x


@pytest.mark.parametrize("seed, tile", [(0, 2000), (1, 2000), (2, 25)])
def test_recall_and_exactness(spark, seed, tile, monkeypatch):
    monkeypatch.setattr(pivots, "TILE", tile)
    x = clustered(seed)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "near": F.lit("n"), "pivot": F.lit(0)})
    rows = [tuple(r) for r in pivots.vector_pairs(df).collect()]
    got, want = {r[:2] for r in rows}, {p for p in brute(x, np.arange(len(x)), pivots.THRESHOLD) if not set(p) & set(range(10, 14))}
    assert len(got) == len(rows) and got <= want and len(got) >= 0.95 * len(want) and want


@pytest.mark.parametrize("groups, size, alike", [(1, 2000, 0.935), (5, 1000, 0.93), (1, 4000, 0.9)])
def test_recall_in_large_groups(spark, groups, size, alike):
    """Groups of thousands of jittered copies of one vector, whose pairs have a cosine of about `alike`."""
    r = np.random.default_rng(5)
    x = r.normal(size=(6000, 64))
    for i in range(0, groups * size, size):
        noise, centre = r.normal(size=(size, 64)), r.normal(size=64)
        x[i : i + size] = (alike / (1 - alike)) ** 0.5 * centre / np.linalg.norm(centre) + noise / np.linalg.norm(noise, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pivots.embedding_near_dedup(df).collect()}
    want = {i: (c, n, k) for i, c, n, k in told(range(len(x)), [tuple(v) for v in x.tolist()], pivots.THRESHOLD)}
    assert len(got) == len(x) and all(got[i].n_links <= k for i, (_, _, k) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(k for _, _, k in want.values()) > 200
    assert sum(got[i].class_id == c for i, (c, _, _) in want.items()) >= 0.99 * len(x)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_vectors(spark, kind):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [1.0, 0.01, 0.0])]
    rows = [(i if i is None or kind == "long" else f"{i:03}", v) for i, v in rows]
    df = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>").withColumns({"v": F.lit(1), "class_id": F.lit("x")})
    bad = (None, 3, 4, 5, 6, 7, 8, "003", "004", "005", "006", "007", "008")
    kept = [(i, None if i in bad else tuple(x + 0.0 for x in v)) for i, v in rows if i is not None]
    assert sorted(tuple(r) for r in pivots.embedding_near_dedup(df).collect()) == told(*zip(*kept), pivots.THRESHOLD)
    assert pivots.embedding_near_dedup(df.limit(0)).count() == 0 and pivots.vector_pairs(df.limit(0)).count() == 0
    assert pivots.vector_pairs(df.where("vec_id = 2")).count() == 0
    assert {tuple(r) for r in pivots.vector_pairs(df).collect()} == {(*(x if kind == "long" else f"{x:03}" for x in p), c) for p, c in (((1, 2), 1.0), ((9, 12), round(1 / 1.0001**0.5, 6)))}


def test_all_alike(spark):
    df = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert {tuple(r)[1:] for r in pivots.embedding_near_dedup(df).collect()} == {(0, 4000, 0)}


def test_query(agree):
    agree(pivots.query, pivots.ORACLE)


def test_query_against_brute_force(spark, sf, tmp_path):
    """The query over a table that has near vectors: the given one with jittered copies."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    r = np.random.default_rng(2)
    more = [(10_000 + i, [float(np.float32(v + r.normal() * 0.01)) for v in x.embedding]) for i, x in enumerate(rows[:200])]
    every = [(x.vec_id, list(x.embedding)) for x in rows] + more + [(20_000 + i, list(x.embedding)) for i, x in enumerate(rows[:30])]
    spark.createDataFrame(every, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = told([i for i, _ in every], [tuple(map(float, v)) for _, v in every], pivots.THRESHOLD)
    got = sorted(tuple(x) for x in pivots.query(spark, str(tmp_path)).collect())
    assert sum(k for *_, k in want) >= 400
    assert sum(a == b for a, b in zip(got, want)) >= 0.95 * len(want) and len(got) == len(want)


def test_recall_on_the_table(spark, sf):
    """A lower threshold, at which the table has pairs, if it has any."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    want = brute(x, ids, 0.5)
    got = {tuple(r)[:2] for r in pivots.vector_pairs(table, 0.5).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
