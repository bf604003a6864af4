"""Operator 6, embedding near-dedup by a pivot-permutation index: vectors are described by their nearest pivots in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertloom.llm.common import Links, Table, stream_groups
from assertloom.llm.components import components
from assertloom.session import written

THRESHOLD = 0.95
#: Pivots in a description at most; two near vectors must share one. Pivots are at least as far apart as twice the threshold's angle, but
#: need not be further apart than this cosine.
NEAREST, APART = 8, 0.5
#: Pairs of a tile that are looked up at once.
BLOCK = 100_000
#: Vectors of one inverted list that a task holds against each other; a longer list is cut into tiles of two such parts.
TILE = 2000
#: Cosines with pivots that a task holds at once.
DESCRIBED = 4_000_000


def pivot_count(rows: int) -> int:
    """Twice the square root of the number of vectors: lists then grow as slowly as the work of describing."""
    return max(2 * NEAREST, int(2 * rows**0.5))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(x: np.ndarray, cosine: float) -> np.ndarray:
    """The rows of x, in order, whose cosine with each row taken before is less than `cosine`: a group of near copies then brings few pivots."""
    taken = np.empty_like(x)
    n = 0
    for v in x:
        if not n or (taken[:n] @ v).max() < cosine - 1e-9:
            taken[n] = v
            n += 1
    return taken[:n]


def _near(threshold: float):
    """Blocks of the pairs of a tile that share its pivot as the least, and whose cosine reaches the threshold: (rows, rows, cosines)."""

    def blocks(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        pivot, ti, tj = pdf["pivot"].iloc[0], pdf["ti"].iloc[0], pdf["tj"].iloc[0]
        order, slot = np.arange(len(pdf)), pdf["slot"].to_numpy()
        x = np.stack(pdf["v"].to_list())
        keys = np.stack(pdf["keys"].to_list())
        x32 = x.astype(np.float32)
        for i in range(0, len(x), 512):
            j = slice(i, i + 512)
            ok = x32[j] @ x32.T >= threshold - 1e-4  # all of a list share its pivot
            ok &= order[j, None] < order[None, :] if ti == tj else (slot[j, None] == ti) & (slot[None, :] == tj)
            left, right = np.nonzero(ok)
            for k in range(0, len(left), BLOCK):
                a, b = left[k : k + BLOCK] + i, right[k : k + BLOCK]
                both = keys[a][:, :, None] == keys[b][:, None, :]
                first = np.where(both.any(2), keys[a], np.iinfo(np.int64).max).min(1)
                cos = np.einsum("ij,ij->i", x[a], x[b])
                mine = (first == pivot) & (cos >= threshold)  # a pair is made at the least pivot that lists both
                yield a[mine], b[mine], cos[mine]

    return blocks


def _pairs(threshold: float):
    near = _near(threshold)

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        ids = pdf["n"].tolist()
        for a, b, cos in near(pdf):
            yield from zip([ids[i] for i in a], [ids[i] for i in b], cos.round(6).tolist())

    return run


def _linked(threshold: float):
    near = _near(threshold)

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        ids, links = pdf["n"].tolist(), Links(len(pdf))
        for a, b, _ in near(pdf):
            links.add(a, b)
        for i, count, other in links.rows():
            yield ids[i], count, ids[other]

    return run


def _classes(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(n, name, d, v, vec_id, copies) of each different vector, vec_id the least that has it, written; (vec_id, name) of all rows."""
    base = Table(vectors).pick(vec_id=vec_id, v=embedding).where("vec_id IS NOT NULL").withColumn("v", F.col("v").cast("array<double>"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.withColumn("v", F.when((F.size("v") > 0) & usable, F.transform("v", lambda x: x + 0.0)))  # -0.0 is 0.0
    name = F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("x"), F.hash("v").alias("y")))  # 96 bits stand for a vector
    base = base.withColumn("name", name)
    found = base.where("v IS NOT NULL").groupBy("name").agg(F.first("v").alias("v"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    classes = written(found.select(F.monotonically_increasing_id().alias("n"), "name", F.size("v").alias("d"), "v", "vec_id", "copies"), "classes")
    return classes, base.select("vec_id", "name")


def _tiles(classes: DataFrame, threshold: float, pivots: int | None) -> DataFrame:
    """(pivot, ti, tj, n, v, keys, slot): vectors by the pivots that describe them, long lists in tiles in which every pair is once."""
    counts = {r.d: r.c for r in classes.groupBy("d").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row a dimension
    share = F.create_map(*[F.lit(x) for d, c in counts.items() for x in (d, 1.5 * (pivots or pivot_count(c)) / c + 16.0 / c)]) if counts else F.create_map(F.lit(0), F.lit(0.0))
    luck = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
    chosen = classes.where(luck < F.element_at(share, F.col("d"))).select("d", "v", luck.alias("luck")).collect()
    angle = 2 * np.arccos(np.clip(threshold, -1, 1))
    tables, first = {}, 0
    for d in sorted(counts):
        own = sorted((r.luck, r.v) for r in chosen if r.d == d)[: pivots or pivot_count(counts[d])]
        if own:
            x = _apart(_unit(np.array([v for _, v in own])), max(APART, np.cos(min(angle, np.pi))))
            tables[d] = (first, x)
            first += len(x)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby("d"):
                start, table = tables[d]
                nearest, step = min(NEAREST, len(table)), max(1, DESCRIBED // len(table))
                for at in range(0, len(part), step):
                    x = _unit(np.stack(part["v"].iloc[at : at + step].to_list()))
                    sims = (x @ table.T).round(9)
                    near = np.sort(np.argpartition(-sims, nearest - 1, axis=1)[:, :nearest], axis=1)
                    own = np.take_along_axis(sims, near, 1)
                    order = np.argsort(-own, axis=1, kind="stable")
                    near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
                    far = np.arccos(np.clip(own, -1, 1))
                    near = np.where(far <= far[:, :1] + angle + 1e-6, near, near[:, :1])  # the nearest again in place of one too far
                    near = np.pad(near, ((0, 0), (0, NEAREST - nearest)), mode="edge") + start
                    yield pd.DataFrame({"n": part["n"].iloc[at : at + step], "v": list(x), "keys": list(near.astype(np.int64))})

    described = written(classes.select("n", "d", "v").mapInPandas(describe, "n long, v array<double>, keys array<long>"), "described")
    pivot = F.explode(F.array_distinct("keys"))
    used = {r.p: r.n for r in described.select(pivot.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    parts = F.lit([-(-used.get(p, 1) // TILE) for p in range(max(1, first))])
    listed = described.withColumn("pivot", pivot).withColumn("parts", F.get(parts, F.col("pivot").cast("int")).cast("int"))
    listed = listed.withColumn("slot", F.pmod(F.xxhash64("n"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return listed.select("pivot", F.least("slot", "other").alias("ti"), F.greatest("slot", "other").alias("tj"), "n", "v", "keys", "slot")


def vector_pairs(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(vec_a, vec_b, cosine): the pairs of different vectors whose cosine is `threshold` or more, by the least vec_ids that have them.

    The search and the cases are those of embedding_near_dedup, which has the class of every row; each cosine is exact to 6 places. vec_a < vec_b
    unless one vec_id has both vectors.
    """
    classes, _ = _classes(vectors, vec_id, embedding)
    pairs = stream_groups(_tiles(classes, threshold, pivots), ["pivot", "ti", "tj"], _pairs(threshold), "x long, y long, cosine double")
    names = classes.select("n", "vec_id")
    pairs = pairs.join(names.toDF("x", "dx"), "x").join(names.toDF("y", "dy"), "y")
    return pairs.select(F.least("dx", "dy").alias("vec_a"), F.greatest("dx", "dy").alias("vec_b"), "cosine")


def embedding_near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(vec_id, class_id, n_copies, n_links) of every row: the near pairs, told vector by vector.

    Two vectors are linked if their cosine is `threshold` or more. `n_links` counts the different vectors that a row's vector is linked to, `n_copies` the rows
    with the very same vector, itself included, and class_id is the least vec_id that links and copies lead to: its own if there are none.
    The search is approximate, and every link is verified; vector_pairs has the links themselves.

    The pivots are vectors of the table, of those with the least hash, twice the square root of their number, the ones that are
    further from all before than twice the angle of `threshold` (or APART): a group of near copies has one pivot or few, however large it is.
    A vector is described by its NEAREST pivots, without those that are further from it than the nearest by more than twice that angle, as a
    near vector's nearest pivot can't be among them. Each pivot has an inverted list of the vectors it describes; pairs that share a list are
    verified. A long list is cut into tiles; nothing is capped. Vectors of another dimension have pivots and lists of their own.

    Vectors that are null, empty, of zero length, or hold a null, a NaN or an infinite element have a class of their own, 1 copy and no link; rows with a
    null vec_id take no part and aren't in the result. Rows that repeat a vec_id have a row each, with the class of their own vector. Ids can be of any type that has
    an order. Ties between pivots go by their order. Other columns play no part, whatever their names; an empty table gives no rows.
    """
    classes, rows = _classes(vectors, vec_id, embedding)
    links = written(stream_groups(_tiles(classes, threshold, pivots), ["pivot", "ti", "tj"], _linked(threshold), "n long, c long, other long"), "links")
    groups = components(links.select("n", "other"))
    counts = links.groupBy("n").agg(F.sum("c").alias("n_links"))
    known = classes.select("n", "name", "vec_id", "copies").join(groups.toDF("n", "root"), "n", "left").join(counts, "n", "left").withColumn("root", F.coalesce("root", "n"))
    firsts = known.groupBy("root").agg(F.min("vec_id").alias("class_id"))
    found = known.join(firsts, "root").select("name", "class_id", "copies", "n_links")
    every = rows.join(found, "name", "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return every.select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("copies", one).alias("n_copies"), F.coalesce("n_links", none).alias("n_links"))


def query(spark, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, min(vec_id) OVER (PARTITION BY embedding) AS rep, count(*) OVER (PARTITION BY embedding) AS n_copies FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.rep = a.vec_id AND b.rep = b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
x(a, b) AS (SELECT DISTINCT rep, rep FROM v UNION SELECT x.a, e.b FROM x JOIN e ON e.a = x.b),
y AS (SELECT a, min(b) AS class_id FROM x GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, class_id, n_copies, coalesce(n_links, 0)::BIGINT AS n_links FROM v JOIN y ON y.a = v.rep LEFT JOIN l ON l.a = v.rep"""
