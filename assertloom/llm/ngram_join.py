"""Operator 1, n-gram Jaccard join: MinHash banding, a shuffle on band hashes, and exact verification on full n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assertloom.llm.common import NOT_WORD, WS, Links, Table, Words, grams, mix, normal, stream_groups
from assertloom.llm.components import components
from assertloom.session import written

N, THRESHOLD, RECALL = 3, 0.5, 0.99
#: Members of a group that one task verifies against each other; a larger group is cut into tiles of two such parts.
TILE = 1000
NAMES = ["doc_id", "h", "k", "fp", "bands"]


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band (the fewest false candidates) with which pairs at the threshold meet with chance `recall`, in at most `hashes` hashes."""
    fits = [(math.ceil(math.log(1 - recall) / math.log1p(-(threshold**r))), r) for r in range(1, 17) if threshold**r < 1]
    fits = [(b, r) for b, r in fits if b * r <= hashes]
    if not fits:
        raise ValueError(f"{hashes} hashes can't reach recall {recall} at {threshold}")
    return max(fits, key=lambda x: x[1])


def _signer(n: int, bands: int, rows: int):
    """A function of Arrow batches (doc_id, h, norm): the set's fingerprint and its band hashes, nulls for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        words = Words()
        for batch in batches:
            at, size, ids, hs = 0, 0, batch.column(0), batch.column(1)
            sets: list[np.ndarray] = []
            rows_at: list[int] = []
            none: list[int] = []
            for i, text in enumerate(batch.column(2)):
                g = grams(words.hashes((text.as_py() or "").encode().split()), n)
                if len(g):
                    sets.append(g)
                    rows_at.append(i)
                    size += len(g)
                else:
                    none.append(i)
                at += 1
                if size > 400_000 or at == len(batch):
                    if sets:
                        yield _sign(sets, ids.take(pa.array(rows_at)), hs.take(pa.array(rows_at)), a, b, bands, rows)
                    sets, rows_at, size = [], [], 0
            if none:
                take = pa.array(none)
                empty = [pa.nulls(len(none), kind) for kind in (pa.int64(), pa.binary(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids.take(take), hs.take(take), *empty], NAMES)

    return run


def _sign(sets: list[np.ndarray], ids: pa.Array, hs: pa.Array, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> pa.RecordBatch:
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    fp = np.ascontiguousarray(np.stack([np.add.reduceat(flat, starts), np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5)), starts)], 1))
    out = np.empty((len(sets), bands), dtype=np.uint64)
    for band in range(bands):
        acc = np.full(len(sets), np.uint64(band))
        for k in range(band * rows, band * rows + rows):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * a[k] + b[k], starts))
        out[:, band] = acc
    flatfp = pa.Array.from_buffers(pa.binary(16), len(sets), [None, pa.py_buffer(fp.tobytes())])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)), pa.array(out.reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays([ids, hs, pa.array(fp[:, 0].view(np.int64)), flatfp.cast(pa.binary()), lists], NAMES)


def _near(n: int, threshold: float) -> Callable[[pd.DataFrame], Iterator[tuple]]:
    """The classes of a tile, and blocks of those pairs that meet in a band, at the least key that they share, and whose full sets reach the threshold."""
    words = Words()

    def blocks(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        key, ti, tj = pdf["key"].iloc[0], pdf["ti"].iloc[0], pdf["tj"].iloc[0]
        sets = [grams(words.hashes(t.encode().split()), n) for t in pdf["norm"]]
        size = np.array([len(s) for s in sets])
        slot, ks = pdf["slot"].to_numpy(), np.stack(pdf["ks"].to_list())
        order, m = np.arange(len(pdf)), len(pdf)
        for i0 in range(0, m, 128):
            i1 = min(m, i0 + 128)
            a = ks[i0:i1, None, :]
            shared = np.where(a == ks[None, :, :], a, np.iinfo(np.int64).max).min(axis=2)
            if ti == tj:
                ok = (shared == key) & (order[None, :] > order[i0:i1, None])
            else:
                ok = (shared == key) & (slot[i0:i1, None] == ti) & (slot[None, :] == tj)
            ok &= np.minimum(size[i0:i1, None], size[None, :]) >= threshold * np.maximum(size[i0:i1, None], size[None, :])
            x, y = np.nonzero(ok)
            if not len(x):
                continue
            if len(x) > 4 * (i1 - i0):
                inter = _overlaps(sets[i0:i1], sets)[x, y]
            else:
                inter = np.array([len(np.intersect1d(sets[i0 + p], sets[q], assume_unique=True)) for p, q in zip(x, y)])
            jaccard = inter / (size[i0 + x] + size[y] - inter)
            keep = jaccard >= threshold
            yield x[keep] + i0, y[keep], jaccard[keep]

    return blocks


def _one_each(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeated rows bring a class's text more than once."""
    return pdf.drop_duplicates("k") if pdf["k"].duplicated().any() else pdf


def _pairs(n: int, threshold: float):
    near = _near(n, threshold)

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        pdf = _one_each(pdf)
        k = pdf["k"].to_numpy()
        for x, y, jaccard in near(pdf):
            yield from zip(k[x].tolist(), k[y].tolist(), jaccard.tolist())

    return run


def _linked(n: int, threshold: float):
    near = _near(n, threshold)

    def run(pdf: pd.DataFrame) -> Iterator[tuple]:
        pdf = _one_each(pdf)
        k, links = pdf["k"].tolist(), Links(len(pdf))
        for x, y, _ in near(pdf):
            links.add(x, y)
        for i, count, other in links.rows():
            yield k[i], count, k[other]

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as matrix products over blocks of the grams that the left sets have."""
    names = np.unique(np.concatenate(left))
    at = [np.searchsorted(names, s) for s in right]
    at = [p[(p < len(names)) & (names[np.minimum(p, len(names) - 1)] == s)] for p, s in zip(at, right)]
    la = [np.searchsorted(names, s) for s in left]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, len(names), 4096):
        a, b = np.zeros((len(left), 4096), dtype=np.float32), np.zeros((len(right), 4096), dtype=np.float32)
        for m, lists in ((a, la), (b, at)):
            for i, p in enumerate(lists):
                lo, hi = np.searchsorted(p, (c, c + 4096))
                m[i, p[lo:hi] - c] = 1
        total += a @ b.T
    return total.astype(np.int64)


def _classes(docs: DataFrame, n: int, threshold: float, recall: float, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(class: fp, k, n_copies, rep, bands), (doc_id, h, k, fp, bands) of all documents, (doc_id, h, text).

    A class is all documents with one n-gram set, `k` the set's short name, `rep` its least document, which stands for it. Only counts and
    one document are gathered for a class, however many it has.
    """
    bands, rows = choose_bands(threshold, recall)
    base = Table(docs).pick(doc_id=doc_id, text=text).where("doc_id IS NOT NULL")
    base = base.select("doc_id", F.xxhash64("text").alias("h"), "text")
    kind = dict(base.dtypes)["doc_id"]
    signed = base.select("doc_id", "h", normal(F.col("text")).alias("norm")).mapInArrow(_signer(n, bands, rows), f"doc_id {kind}, h long, k long, fp binary, bands array<long>")
    signed = written(signed, "signatures")
    classes = signed.where("fp IS NOT NULL").groupBy("fp").agg(F.first("k").alias("k"), F.count(F.lit(1)).alias("n_copies"), F.min(F.struct("doc_id", "h")).alias("rep"), F.first("bands").alias("bands"))
    return classes, signed, base


def _tiles(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, ti, tj, k, ks, norm, slot): the classes that share a bucket with another, in tiles in which every pair of such classes is once.

    The key of a band's bucket is the least k in it: within a band, two classes share a key just if they share the bucket. A class
    goes once to each of its keys, with the keys of all its bands, and a pair is made only at the least key that it shares: no pair is
    made twice, and no pair is ever shuffled. A bucket of more than TILE classes is cut into parts, and each two parts are a task.
    """
    bucket = Window.partitionBy("band", "value")
    met = (
        classes.select("fp", "k", F.posexplode("bands").alias("band", "value"))
        .select("fp", "band", F.min("k").over(bucket).alias("key"), F.count(F.lit(1)).over(bucket).alias("n"))
        .where("n > 1")
        .select("fp", "band", "key")
    )
    own = met.groupBy("fp").agg(F.map_from_entries(F.collect_list(F.struct("band", "key"))).alias("m"))
    # where a class is alone in a band, it has a key there that no other class has
    member = classes.join(own, "fp").select(
        "k",
        F.col("rep.doc_id").alias("doc_id"),
        F.col("rep.h").alias("h"),
        F.transform("bands", lambda v, i: F.coalesce(F.get(F.map_values(F.map_filter("m", lambda b, _: b == i)), 0), F.xxhash64(F.col("fp"), i))).alias("ks"),
        F.array_distinct(F.map_values("m")).alias("keys"),
    )
    full = member.join(texts, ["doc_id", "h"]).select("k", "ks", normal(F.col("text")).alias("norm"), F.explode("keys").alias("key"))
    large = met.groupBy("key").agg(F.count_distinct("fp").alias("n")).where(F.col("n") > TILE)
    full = full.join(large, "key", "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / TILE).cast("int"))
    full = full.withColumn("slot", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return full.select("key", F.least("slot", "other").alias("ti"), F.greatest("slot", "other").alias("tj"), "k", "ks", "norm", "slot")


def class_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs of classes whose sets of word n-grams have a Jaccard similarity of `threshold` or more, by their least documents.

    A class is all documents with one set, so the copies of a document are not made into pairs; ngram_jaccard_join has the class of every
    document. doc_a < doc_b unless one doc_id has both texts. The cases are handled as there; the similarity is exact (rounded to 6 places).
    """
    classes, _, texts = _classes(docs, n, threshold, recall, doc_id, text)
    pairs = stream_groups(_tiles(classes, texts), ["key", "ti", "tj"], _pairs(n, threshold), "x long, y long, jaccard double")
    names = classes.select("k", F.col("rep.doc_id").alias("d"))
    pairs = pairs.join(names.toDF("x", "dx"), "x").join(names.toDF("y", "dy"), "y")
    return pairs.select(F.least("dx", "dy").alias("doc_a"), F.greatest("dx", "dy").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))


def _linked_documents(docs: DataFrame, threshold: float, n: int, recall: float, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, class_id, n_copies, n_links) of each row with a doc_id, h being its text's hash."""
    classes, signed, texts = _classes(docs, n, threshold, recall, doc_id, text)
    links = written(stream_groups(_tiles(classes, texts), ["key", "ti", "tj"], _linked(n, threshold), "k long, n long, other long"), "links")
    groups = components(links.select("k", "other"))
    counts = links.groupBy("k").agg(F.sum("n").alias("n_links"))
    known = classes.select("fp", "k", "n_copies", F.col("rep.doc_id").alias("least")).join(groups.toDF("k", "root"), "k", "left").join(counts, "k", "left")
    known = known.select("fp", "least", "n_copies", F.coalesce("root", "k").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    firsts = known.groupBy("root").agg(F.min("least").alias("class_id"))
    found = known.join(firsts, "root").select("fp", "class_id", "n_copies", "n_links")
    every = signed.select("doc_id", "h", "fp").join(found, "fp", "left")
    return every.select("doc_id", "h", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def ngram_jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) of every document: the join's pairs, told document by document.

    Two documents are linked if their sets of word n-grams have a Jaccard similarity of `threshold` or more; words are lower-case and
    without punctuation. `n_links` counts the different sets that a document's set is linked to, `n_copies` the rows with the same set, itself
    included, and class_id is the least doc_id that links and copies lead to: its own if there are none. Documents with equal sets are
    found by grouping, and only one of them is banded and compared. A link at the threshold is found with chance `recall`, and a more
    similar one with a higher chance; every link is verified on the full sets. class_pairs has the links themselves.

    A text of fewer than n words is one gram, all of it. Null, empty and wordless texts have no set, hence a class of their own, 1 copy and no
    link; a row with a null doc_id takes no part and isn't in the result. Rows that repeat a doc_id have a row each, with the class of their own text.
    Ids can be of any type that has an order. Very long texts are compared whole. Ties don't arise: every link counts. Other
    columns play no part, whatever their names; an empty table gives no rows.
    """
    return _linked_documents(docs, threshold, n, recall, doc_id, text).drop("h")


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the texts whose group has a document with a smaller doc_id; all columns stay.

    Rows that take no part in the join stay: those with a null doc_id, and null, empty and wordless texts. Equal rows stay or go together. Of a
    doc_id with several texts, each is judged by itself. Otherwise as ngram_jaccard_join; an empty table stays empty.
    """
    t = Table(docs)
    gone = _linked_documents(docs, threshold, n, recall, doc_id, text).where("class_id <> doc_id").select(F.col("doc_id").alias("_gone"), F.col("h").alias("_h")).distinct()
    return t.back(t.df.join(gone, (t.at(doc_id) == F.col("_gone")) & (F.xxhash64(t.at(text)) == F.col("_h")), "left_anti"))


def query(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '{NOT_WORD.replace(WS, " \\t\\n\\x0B\\f\\r")}', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {N - 1}], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N - 2}, 2))) AS i FROM t WHERE len(w) > 0)),
s AS (SELECT doc_id, count(*) AS n, string_agg(md5(gram), '' ORDER BY gram) AS s FROM g GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY md5(s)) AS rep, count(*) OVER (PARTITION BY md5(s)) AS n_copies FROM s),
r AS (SELECT g.doc_id, gram, n FROM g JOIN c ON c.doc_id = g.doc_id AND c.rep = g.doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= {THRESHOLD}),
x(a, b) AS (SELECT DISTINCT rep, rep FROM c UNION SELECT x.a, e.b FROM x JOIN e ON e.a = x.b),
y AS (SELECT a, min(b) AS class_id FROM x GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT t.doc_id, coalesce(y.class_id, t.doc_id) AS class_id, coalesce(c.n_copies, 1)::BIGINT AS n_copies, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM t LEFT JOIN c ON c.doc_id = t.doc_id LEFT JOIN y ON y.a = c.rep LEFT JOIN l ON l.a = c.rep"""
