"""Helpers that the training-data operators share: columns by position, word tables, streamed groups, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as bytes.split() has it; the same class in Java, RE2 and Python.
WS = r" \t\n\x0B\f\r"
#: What word n-grams don't see: all but letters, digits and white space.
NOT_WORD = rf"[^\p{{L}}\p{{N}}{WS}]+"

_U = np.uint64
_PHI, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


class Table:
    """A DataFrame with its columns renamed by position, so that no extra or repeated name can clash with a name used inside.

    `at(name)` is the column of that exact name (the first, if repeated), else the only one that differs in case.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"_{i}_" for i in range(len(self.names))])

    def at(self, name: str) -> Column:
        return F.col(self.inner(name))

    def inner(self, name: str) -> str:
        if name in self.names:
            return f"_{self.names.index(name)}_"
        alike = [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if len(alike) != 1:
            raise ValueError(f"no column {name} among {self.names}")
        return f"_{alike[0]}_"

    def pick(self, **columns: str) -> DataFrame:
        return self.df.select(*[self.at(n).alias(k) for k, n in columns.items()])

    def back(self, df: DataFrame) -> DataFrame:
        """`df` with only the columns of the input, under their own names."""
        return df.select(*[f"_{i}_" for i in range(len(self.names))]).toDF(*self.names)


def normal(text: Column) -> Column:
    """Lower case without punctuation: what word n-grams are made of."""
    return F.regexp_replace(F.lower(text), NOT_WORD, "")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs give unrelated outputs."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class Words(dict):
    """64-bit hashes of words, remembered; emptied when large, so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The set of the n-gram hashes of a text with these word hashes, sorted; a shorter text is one gram, an empty one has none."""
    if not len(h):
        return h
    n = min(n, len(h))
    acc = np.full(len(h) - n + 1, _U(n))
    for i in range(n):
        acc = acc * _PHI + h[i : len(h) - n + 1 + i]
    return np.unique(mix(acc))


class Links:
    """Links between m rows: how many each row has, and which rows they tie together, in the room of the rows."""

    def __init__(self, m: int):
        self.count, self.least = np.zeros(m, dtype=np.int64), np.arange(m)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Links between rows x and rows y, each given once."""
        m = len(self.count)
        self.count += np.bincount(x, minlength=m) + np.bincount(y, minlength=m)
        least = self.least
        while len(x):
            a, b = least[x], least[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
            while (least != (up := least[least])).any():
                least = up
        self.least = least

    def rows(self) -> list[tuple[int, int, int]]:
        """(row, links, a row of the same group) of each row that has a link."""
        at = np.flatnonzero(self.count)
        return list(zip(at.tolist(), self.count[at].tolist(), self.least[at].tolist()))


def stream_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], Iterable[tuple]], schema: str, sort: list[str] | None = None) -> DataFrame:
    """fn for each group of equal `keys`, over hash partitions sorted by the keys (and `sort`): a group is held whole, a partition never.

    fn takes the group's rows and gives tuples of `schema`. The keys must not be null.
    """
    names = [c.split()[0] for c in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held: list[pd.DataFrame] = []
        last: tuple | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            k = pdf[keys]
            new = np.flatnonzero((k != k.shift()).any(axis=1).to_numpy())
            edges = [*new.tolist(), len(pdf)]
            for a, b in zip(edges, edges[1:]):
                part, key = pdf.iloc[a:b], tuple(k.iloc[a])
                if last is not None and key != last:
                    for row in fn(pd.concat(held) if len(held) > 1 else held[0]):
                        out.append(row)
                        if len(out) >= 4000:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                    held = []
                held.append(part)
                last = key
        if held:
            for row in fn(pd.concat(held) if len(held) > 1 else held[0]):
                out.append(row)
                if len(out) >= 4000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *(sort or [])).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]
