"""Operator 9, quality classifier: a generalised additive model with pairwise interactions, scored by adding up bins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assertloom.llm.common import Table
from assertloom.llm.quality_rules import METRICS, _layers
from assertloom.session import release, written

PLAIN = [*METRICS, "digit_ratio"]
FEATURES = [*PLAIN, "marked_words", "marked_ratio"]
#: The labelled rows that a fit reads at most: those with the least hash of doc_id. All other steps read every row.
MAX_ROWS = 20_000
#: A part of PART letters of a word, its edges counting as letters, marks toxicity if it stands in CONTEXTS different pairs of a word and the one before it in
#: toxic documents, or in one for every PER_CONTEXT toxic labels if that is more, and is there RATIO times as frequent, by its share of all words,
#: as in other documents. Copies of a document add no context. A stray use elsewhere does no harm, as the trees see how often a document has marked words.
PART, CONTEXTS, PER_CONTEXT, RATIO = 5, 10, 50, 20.0
#: Parts of the sample for cross-fitting: each one's words are marked by what the others show.
FOLDS = 5
THRESHOLD = 0.5


@dataclass
class Gam:
    """Bin edges of each feature, a lookup table for each, tables for pairs of features, and an intercept: a sum gives the log odds."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(np.nan_to_num(x))
        out = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            out += t[b[i]]
        for i, j, t in self.pairs:
            out += t[b[i], b[j]]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def _edges(x: np.ndarray, most: int) -> np.ndarray:
    values = np.unique(x)
    if len(values) > most:
        values = np.unique(np.quantile(x, np.linspace(0, 1, most)))
    return (values[1:] + values[:-1]) / 2


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The best tree of up to 3 leaves over ordered bins, as a value for each bin; g and h are sums of gradients and curvatures."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-12, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gr, hr = g[a:b].sum() - gl, h[a:b].sum() - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
            gain[(hl < 0.5) | (hr < 0.5)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each of two features: its gain, and its value in each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)

    def four(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        top, left = c[:-1, -1:], c[-1:, :-1]
        return [a, top - a, left - a, c[-1, -1] - top - left + a]

    qg, qh = four(cg), four(ch)
    gain = sum(x**2 / (y + 1) for x, y in zip(qg, qh)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for (a, b), x, y in zip(((0, 0), (0, 1), (1, 0), (1, 1)), qg, qh):
        out[(slice(0, i + 1), slice(i + 1, None))[a], (slice(0, j + 1), slice(j + 1, None))[b]] = _leaf(x[i, j], y[i, j])
    return float(gain[i, j]), out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 48, n_pairs: int = 4, pair_bins: int = 12) -> Gam:
    """Cyclic boosting: in each round every feature's tree of up to 3 leaves is added to its table, then the same for the best pairs.

    No rows, or rows of one class only, give a model of the intercept alone: chance 0 without rows of class 1.
    """
    x = np.nan_to_num(np.asarray(x, dtype=float).reshape(len(y), -1)) if len(y) else np.zeros((0, x.shape[1] if x.ndim > 1 else 0))
    y = np.asarray(y, dtype=float)
    p = y.mean() if len(y) else 0.0
    if p in (0.0, 1.0):
        return Gam([np.array([])] * x.shape[1], [np.zeros(1)] * x.shape[1], 20.0 if p else -20.0)
    model = Gam([_edges(x[:, i], bins) for i in range(x.shape[1])], [], float(np.log(p / (1 - p))))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    f = np.full(len(y), model.intercept)

    def sums(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return np.bincount(index, y - q, size), np.bincount(index, q * (1 - q), size)

    for _ in range(rounds):
        for i, t in enumerate(model.tables):
            step = rate * _tree(*sums(b[i], len(t)))
            t += step
            f += step[b[i]]
    coarse = []
    for i, e in enumerate(model.edges):
        cut = np.unique(np.linspace(0, len(e), min(pair_bins, len(e) + 1)).astype(int))
        coarse.append(np.clip(np.searchsorted(cut, np.arange(len(e) + 1), side="right") - 1, 0, len(cut) - 1))
    gains = []
    for i, j in combinations(range(x.shape[1]), 2):
        shape = (coarse[i].max() + 1, coarse[j].max() + 1)
        g, h = (s.reshape(shape) for s in sums(coarse[i][b[i]] * shape[1] + coarse[j][b[j]], shape[0] * shape[1]))
        gains.append((_quadrants(g, h)[0], i, j))
    chosen = sorted(gains, reverse=True)[:n_pairs]
    small = [np.zeros((coarse[i].max() + 1, coarse[j].max() + 1)) for _, i, j in chosen]
    for _ in range(rounds // 3):
        for (_, i, j), t in zip(chosen, small):
            at = coarse[i][b[i]] * t.shape[1] + coarse[j][b[j]]
            step = rate * _quadrants(*(s.reshape(t.shape) for s in sums(at, t.size)))[1]
            t += step
            f += step.reshape(-1)[at]
    model.pairs = [(i, j, t[np.ix_(coarse[i], coarse[j])]) for (_, i, j), t in zip(chosen, small)]
    return model


def _plain(df: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return _layers(df, text).withColumn("digit_ratio", (F.length(body) - F.length(F.translate(body, "0123456789", ""))) / F.greatest(F.length(body), F.lit(1)))


def parts(word: str) -> set[str]:
    """The parts of a word between its edges: all its runs of PART signs, or the whole of a shorter one."""
    w = f"^{word}$"
    return {w[i : i + PART] for i in range(max(1, len(w) - PART + 1))}


class Marked(dict):
    """1 for each word that has a marked part, by the word as it stands in a text, else 0; remembered, and emptied when large."""

    def __init__(self, marks: frozenset[str]):
        self.marks = marks

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        word = "".join(c for c in token.lower() if c.isalnum())
        self[token] = n = int(bool(word) and not self.marks.isdisjoint(parts(word)))
        return n

    def count(self, text: str | None) -> tuple[int, int]:
        """(marked words, words) of a text."""
        tokens = (text or "").split()
        return sum(map(self.__getitem__, tokens)), len(tokens)


def _marks(sample: DataFrame, folds: int = FOLDS) -> list[frozenset[str]]:
    """The marks that all folds but one show, for each fold, and last those of the whole sample (doc_id, text, toxic, fold)."""
    toxic = F.col("toxic") == 1

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, bad, fold in zip(pdf["text"], pdf["toxic"], pdf["fold"]):
                w = ["".join(c for c in t.lower() if c.isalnum()) for t in text.split()]
                # the pairs of a text with their number: a long text gives each once
                pairs = Counter(zip(w, ["", *w]))
                yield pd.DataFrame([(x, y, bad, fold, n) for (x, y), n in pairs.items() if x], columns=["word", "before", "toxic", "fold", "n"])

    pairs = sample.select("text", "toxic", "fold").mapInPandas(words, "word string, before string, toxic int, fold int, n long")
    # in toxic documents a pair counts once for each fold; elsewhere only the word's number matters
    once = pairs.groupBy("word", F.when(toxic, F.col("before")).alias("before"), "toxic", "fold").agg(F.sum("n").alias("n"))
    each = once.groupBy("word", "fold").agg(F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("good"), F.count_if(toxic).alias("contexts"))
    found = written(each, "words")
    totals = {r.fold: (r.bad, r.good) for r in found.groupBy("fold").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()}
    labels = {r.fold: r.n for r in sample.where(toxic).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    edged = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(edged) - (PART - 1), F.lit(1))), lambda i: F.substring(edged, i, PART)))
    by = found.select("fold", "bad", "good", "contexts", F.explode(cut).alias("part")).groupBy("part", "fold").agg(*[F.sum(c).alias(c) for c in ("bad", "good", "contexts")])
    rows = by.groupBy("part").agg(F.collect_list(F.struct("fold", "bad", "good", "contexts")).alias("x")).where(F.aggregate("x.contexts", F.lit(0).cast("long"), lambda a, b: a + b) >= CONTEXTS).collect()
    release(found)
    out = []
    for left in (*range(folds), None):
        bad_all, good_all = (sum(v[i] for f, v in totals.items() if f != left) for i in (0, 1))
        least = max(CONTEXTS, sum(n for f, n in labels.items() if f != left) // PER_CONTEXT)
        marks = set()
        for r in rows:
            bad, good, contexts = (sum(x[i] for x in r.x if x.fold != left) for i in (1, 2, 3))
            if contexts >= least and (bad + 0.5) * (good_all + 1.0) >= RATIO * (good + 0.5) * (bad_all + 1.0):
                marks.add(r.part)
        out.append(frozenset(marks))
    return out


@dataclass
class Classifier:
    """Models of low quality and of toxicity over FEATURES, and the parts of words counted for marked_words."""

    marks: frozenset[str]
    low: Gam
    toxic: Gam

    def chances(self, text: str) -> Column:
        low, toxic, marks = self.low, self.toxic, self.marks

        @F.pandas_udf("struct<p_low:double,p_toxic:double>")
        def score(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
            known = Marked(marks)
            for f, texts in batches:
                x = with_marks(f.to_numpy(dtype=float), texts, known)
                yield pd.DataFrame({"p_low": np.round(low.predict(x), 6), "p_toxic": np.round(toxic.predict(x), 6)})

        return score(F.struct(*[F.col(c).cast("double").alias(c) for c in PLAIN]), F.col(text))


def with_marks(plain: np.ndarray, texts: Iterable[str | None], known: Marked) -> np.ndarray:
    """The features of rows: PLAIN, then the number and the share of marked words."""
    counts = np.array([known.count(t) for t in texts], dtype=float).reshape(-1, 2)
    return np.column_stack([plain, counts[:, 0], counts[:, 0] / np.maximum(counts[:, 1], 1)])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """A classifier from the labelled documents: at most `max_rows` labels, those with the least hash of doc_id.

    Labels that are null or have no document are passed over; a document with several labels counts with each. Without labelled
    documents every chance is 0. Ids can be of any type; empty and very long texts are read whole.
    """
    marks = Table(labels).pick(doc_id="doc_id", quality="quality", toxic="toxic").dropna()
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(max_rows)
    base = Table(docs).pick(doc_id=doc_id, text=text).where("doc_id IS NOT NULL AND text IS NOT NULL")
    joined = base.join(F.broadcast(marks), "doc_id")  # bounded by max_rows
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")  # equal texts are in one fold
    sample = written(joined.select("doc_id", "text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), fold), "labelled")
    by_fold = _marks(sample)

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [Marked(m) for m in by_fold[:-1]]
        for pdf in batches:
            counts = [known[f].count(t) for t, f in zip(pdf["text"], pdf["fold"])]
            yield pdf.drop(columns=["text", "fold"]).assign(marked_words=[float(n) for n, _ in counts], marked_ratio=[n / max(1, m) for n, m in counts])

    numbers = [F.col(c).cast("double").alias(c) for c in PLAIN]
    rows = _plain(sample, "text").select("text", "fold", "quality", "toxic", F.col("doc_id").cast("string").alias("doc_id"), *numbers)
    schema = "quality int, toxic int, doc_id string, " + ", ".join(f"{c} double" for c in FEATURES)
    rows = rows.mapInPandas(marked, schema).orderBy("doc_id", "quality", "toxic", *FEATURES).toPandas()
    release(sample)
    x = rows[FEATURES].to_numpy(dtype=float)
    return Classifier(by_fold[-1], fit_gam(x, (rows["quality"] == 0).to_numpy(float)), fit_gam(x, (rows["toxic"] == 1).to_numpy(float)))


def _scored(df: DataFrame, text: str, model: Classifier) -> DataFrame:
    return _plain(df, text).withColumn("_p", model.chances(text))


def quality_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_low, p_toxic, keep) for every row: chances of low quality and of toxicity, and whether both are under `threshold`.

    A null or empty text is scored as a text without words. Null doc_ids are carried, and repeated rows get equal scores. Texts of any
    length are read whole. Ties at the threshold are not kept. Other columns play no part; an empty table gives none.
    """
    model = fit(docs, labels, max_rows, doc_id, text)
    out = _scored(Table(docs).pick(_id=doc_id, _text=text), "_text", model)
    return out.select(F.col("_id").alias("doc_id"), "_p.p_low", "_p.p_toxic", ((F.col("_p.p_low") < threshold) & (F.col("_p.p_toxic") < threshold)).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns. All cases are those of quality_classifier."""
    model = fit(docs, labels, max_rows, doc_id, text)
    t = Table(docs)
    return t.back(_scored(t.df, t.inner(text), model).where((F.col("_p.p_low") < threshold) & (F.col("_p.p_toxic") < threshold)))


def query(spark, sf_dir: str) -> DataFrame:
    return quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
