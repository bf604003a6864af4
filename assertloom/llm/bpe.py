"""Operator 8, BPE encoding and decoding: long unsplit text is encoded in halves and joined by re-encoding growing windows."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from assertloom.llm.common import Table, stream_groups
from assertloom.llm.pieces import Decoder, Encoder
from assertloom.session import written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A piece that the pattern doesn't split is encoded in halves of halves, down to this many bytes.
LEAF = 1024


@lru_cache(maxsize=4)
def encoding(vocabulary: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file, once for each Python worker."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def piece(enc: tiktoken.Encoding, data: bytes) -> list[int]:
    """The tokens of bytes that nothing splits."""
    return enc._core_bpe.encode_single_piece(data) if data else []


def join(enc: tiktoken.Encoding, a: list[int], b: list[int]) -> list[int]:
    """The tokens of the bytes of a and b together: a window around the join is encoded anew and grows until both its ends agree.

    Tokens are what BPE gives for their bytes just if any two neighbours are; the window's own tokens are, and where its first two tokens
    are those of a, and its last two those of b, so are the neighbours at its edges.
    """
    w = 4
    while True:
        left, right = a[max(0, len(a) - w) :], b[:w]
        new = piece(enc, enc.decode_bytes(left + right))
        whole_a, whole_b = len(left) == len(a), len(right) == len(b)
        if (whole_a or new[:2] == left[:2]) and (whole_b or new[-2:] == right[-2:]) and len(new) >= 4 or (whole_a and whole_b):
            return a[: len(a) - len(left)] + new + b[len(right) :]
        w *= 2


def halves(data: bytes, leaf: int = LEAF) -> list[bytes]:
    """The leaves of the tree of halves, in order: as many as a power of two, none longer than `leaf`."""
    parts = [data]
    while max(map(len, parts)) > leaf:
        parts = [x for p in parts for x in (p[: len(p) // 2], p[len(p) // 2 :])]
    return parts


def tree(enc: tiktoken.Encoding, leaves: list[list[int]]) -> list[int]:
    """Joins neighbours, level by level."""
    while len(leaves) > 1:
        leaves = [join(enc, *leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else []


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """What a Python worker remembers of pieces serves all its tasks."""
    return Encoder(encoding(vocabulary))


@lru_cache(maxsize=4)
def decoder(vocabulary: str) -> Decoder:
    return Decoder(encoding(vocabulary))


def strings(data: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> pa.Array:
    """An Arrow array of the UTF-8 texts that lie in `data` one after the other; what is no UTF-8 is replaced."""
    valid = pa.py_buffer(np.packbits(~gone, bitorder="little").tobytes()) if gone.any() else None
    raw = pa.Array.from_buffers(pa.binary(), len(gone), [valid, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def lists(ids: np.ndarray, ends: np.ndarray, there: list[bool] | None = None) -> pa.ListArray:
    """An Arrow list array over ids in a row, null where `there` is false."""
    mask = None if there is None or all(there) else pa.array([not x for x in there])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)), mask=mask)


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def unsplit(texts: pa.Array, leaf: int) -> np.ndarray:
    """Which texts have more than `leaf` bytes in a row that are all white space, or all not: what the pattern may leave in one long piece."""
    out = np.zeros(len(texts), dtype=bool)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or int(np.diff(at).max()) <= leaf:
        return out
    white = _SPACES[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    # a long run holds a whole block of half its length; as a rule there is none
    block = max(1, leaf // 2)
    some = white[: len(white) // block * block].reshape(-1, block)
    if not (some.all(1) | ~some.any(1)).any():
        return out
    edges = np.union1d(np.flatnonzero(white[1:] != white[:-1]) + 1, at)
    out[np.searchsorted(at, edges[:-1][np.diff(edges) > leaf], side="right") - 1] = True
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts with up to `most` bytes of text, or one longer text."""
    texts = batch.column(column)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def encoded(df: DataFrame, vocabulary: str, finish: Callable[[list, np.ndarray, np.ndarray, list[bool]], pa.RecordBatch], schema: str, leaf: int = LEAF) -> DataFrame:
    """df, whose last column is a text, in Arrow batches of `schema`: finish(other columns, ids in a row, ends, which texts aren't null) makes each.

    Most texts go through the encoder in the task that reads them, null ones as no ids. One with more than `leaf` bytes that nothing splits is
    found by a first look at all texts, which writes only such: it is cut into rows, its short pieces and the leaves of its long ones; they
    are encoded wherever there is room, and meet again to be joined in order.
    """
    *keys, text = df.columns
    width, fields = len(keys), dict(df.dtypes)
    kinds = ", ".join(f"{k} {fields[k]}" for k in keys)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for part in (p for batch in batches for p in slices(batch, width)):
            found = np.flatnonzero(unsplit(part.column(width), leaf))
            if len(found):
                some = part.take(pa.array(found))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.arange(n, n + len(found)))], [*keys, text, "_rid"])
                n += len(found)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(vocabulary)
        for part in (p for batch in batches for p in slices(batch, width)):
            long = unsplit(part.column(width), leaf)
            if long.any():
                part = part.filter(pa.array(~long))
            texts = part.column(width).to_pylist()
            yield finish(part.columns[:width], *one.encode([x or "" for x in texts]), [x is not None for x in texts])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = regex.compile(PATTERN)
        for pdf in batches:
            for rid, body in zip(pdf["_rid"], pdf[text]):
                rows, run = [], []

                def flush() -> None:
                    if run:
                        rows.append((rid, len(rows), 0, "\0".join(map(str, map(len, run))).encode(), b"".join(run)))
                        run.clear()

                for p in (m.encode() for m in split.findall(body)):
                    if len(p) <= leaf:
                        run.append(p)
                        continue
                    flush()
                    seg = len(rows)
                    rows.extend((rid, seg, i, b"", x) for i, x in enumerate(halves(p, leaf)))
                flush()
                yield pd.DataFrame(rows, columns=["_rid", "seg", "leaf", "lens", "data"])

    def leaf_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for pdf in batches:
            ids = []
            for lens, data in zip(pdf["lens"], pdf["data"]):
                if not lens:
                    ids.append(piece(enc, data))
                    continue
                out, at = [], 0
                for k in map(int, lens.decode().split("\0")):
                    out += piece(enc, data[at : at + k])
                    at += k
                ids.append(out)
            yield pd.DataFrame({"_rid": pdf["_rid"], "seg": pdf["seg"], "leaf": pdf["leaf"], "ids": ids})

    def whole(pdf: pd.DataFrame) -> Iterator[tuple]:
        enc, out = encoding(vocabulary), []
        for _, part in pdf.groupby("seg", sort=True):
            out += tree(enc, [list(map(int, x)) for x in part["ids"]])
        yield pdf["_rid"].iloc[0], out

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                ids = batch.column(width).slice(at, 1).flatten().to_numpy()
                yield finish([c.slice(at, 1) for c in batch.columns[:width]], ids, np.array([0, len(ids)]), [True])

    short = df.mapInArrow(plain, schema)
    rare = written(df.mapInArrow(look, f"{kinds + ', ' if keys else ''}{text} string, _rid long"), "unsplit")
    if rare.isEmpty():
        return short
    rows = rare.select("_rid", text).mapInPandas(cut, "_rid long, seg int, leaf int, lens binary, data binary")
    leaves = rows.repartition("_rid", "seg", "leaf").mapInPandas(leaf_ids, "_rid long, seg int, leaf int, ids array<int>")
    met = stream_groups(leaves, ["_rid"], whole, "_rid long, ids array<int>", ["seg", "leaf"])
    return short.unionByName(rare.drop(text).join(met, "_rid").select(*keys, "ids").mapInArrow(last, schema))


def bpe_encode(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids, n_tokens): the byte-level BPE tokens of every text, whole, just as one encoder call over the text gives them.

    An empty text has no tokens, a null one null ids and null n_tokens. Null doc_ids are carried; repeated rows are encoded each. Text that
    looks like a special token is ordinary text. Other columns play no part, whatever their names; an empty table gives none.
    """
    base = Table(docs).pick(doc_id=doc_id, text=text)

    def finish(keys: list, ids: np.ndarray, ends: np.ndarray, there: list[bool]) -> pa.RecordBatch:
        n = pa.array(np.diff(ends).astype(np.int32), mask=~np.array(there, dtype=bool))
        return pa.RecordBatch.from_arrays([*keys, lists(ids, ends, there), n], ["doc_id", "ids", "n_tokens"])

    return encoded(base, vocabulary, finish, f"doc_id {dict(base.dtypes)['doc_id']}, ids array<int>, n_tokens int", leaf)


def bpe_decode(tokens: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): the text of token ids; bytes that are no UTF-8 become U+FFFD. Null ids give a null text, no ids an empty one.

    An id outside the vocabulary, or a null one, is an error in the data, and the row's text is null.
    """
    base = Table(tokens).pick(doc_id=doc_id, ids=ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            out = []
            for x in batch.column(1):
                try:
                    out.append(None if x.as_py() is None else enc.decode_bytes(x.as_py()).decode("utf-8", "replace"))
                except (KeyError, TypeError, OverflowError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, text string")


def bpe_round_trip(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids, n_tokens, text): bpe_encode and then the decoding of its ids, in one pass, side by side.

    Nulls, empty texts, repeated rows, clashing names and empty tables are as in bpe_encode; a null text comes back as null. A text that
    doesn't come back as UTF-8 has U+FFFD in place of what is none.
    """
    base = Table(docs).pick(doc_id=doc_id, text=text)

    def finish(keys: list, ids: np.ndarray, ends: np.ndarray, there: list[bool]) -> pa.RecordBatch:
        data, at = decoder(vocabulary).decode(ids, ends)
        gone = ~np.array(there, dtype=bool)
        n = pa.array(np.diff(ends).astype(np.int32), mask=gone)
        return pa.RecordBatch.from_arrays([*keys, lists(ids, ends, there), n, strings(data, at, gone)], ["doc_id", "ids", "n_tokens", "text"])

    return encoded(base, vocabulary, finish, f"doc_id {dict(base.dtypes)['doc_id']}, ids array<int>, n_tokens int, text string", leaf)


def query(spark, sf_dir: str) -> DataFrame:
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
