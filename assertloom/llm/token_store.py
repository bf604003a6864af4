"""Operator 5, token ids in binary: every document compressed by itself against one zstandard dictionary, with hash and offsets kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertloom.llm.bpe import TOKENIZERS, VOCABULARY, encoded
from assertloom.llm.common import Table, stream_groups
from assertloom.session import release, written

#: Bytes of the dictionary, bytes that a task trains one on, and bytes at which a task begins another shard.
DICTIONARY, TRAIN_BYTES, SHARD_BYTES = 65_536, 16_000_000, 256_000_000
LEVEL = 3


def serialize(ids) -> bytes:
    """Two bytes little-endian for each id, or four if an id needs them; the first byte of the array says which."""
    x = np.asarray(ids, dtype=np.int64)
    wide = len(x) and int(x.max()) > 0xFFFF
    return (b"\4" + x.astype("<u4").tobytes()) if wide else (b"\2" + x.astype("<u2").tobytes())


def deserialize(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4" if data[:1] == b"\4" else "<u2", offset=1).astype(np.int64)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of about `size` bytes; with too few samples to train on, their bytes serve as they are (empty without samples)."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, total // 4), samples, level=LEVEL, k=200, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def _trained(column: str, size: int, most: int):
    """Dictionaries, each trained on some `most` bytes of a task's rows: all rows are in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array([train_dictionary(held, size)], pa.binary())], [column])
        for batch in batches:
            for x in batch.column(0):
                data = x.as_py()
                # the trainer wants many samples, none of them large: rows go in parts
                held += [data[i : i + 8192] for i in range(0, len(data), 8192)]
                n += len(data)
                if n >= most:
                    yield give()
                    held, n = [], 0
        if n:
            yield give()

    return run


def corpus_dictionary(rows: DataFrame, column: str, size: int = DICTIONARY, train_bytes: int = TRAIN_BYTES) -> bytes:
    """One dictionary for a binary column, from all its rows: tasks train dictionaries, and then dictionaries are trained on dictionaries.

    A level has some `train_bytes` / `size` times fewer than the one below, until there is one. Nulls and empty values play no part; no rows
    give an empty dictionary.
    """
    fan = max(2, train_bytes // size)
    now = written(rows.where(F.length(column) > 0).select(column).mapInArrow(_trained(column, size, train_bytes), f"{column} binary"), "dictionaries")
    while (n := now.count()) > 1:
        after = written(now.repartition(-(-n // fan)).mapInArrow(_trained(column, size, 2 * train_bytes), f"{column} binary"), "dictionaries")
        release(now)
        now = after
    row = now.first()
    release(now)
    return bytes(row[0]) if row else b""


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind) if dictionary else None)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind) if dictionary else None)


def decode_frame(frame: bytes, dictionary: bytes, dict_hash: str) -> np.ndarray:
    """The ids of one document; a dictionary other than that of `dict_hash` is refused."""
    if dictionary_hash(dictionary) != dict_hash:
        raise ValueError("the frame was made with another dictionary")
    return deserialize(_decompressor(dictionary).decompress(frame))


def token_store(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, train_bytes: int = TRAIN_BYTES) -> tuple[DataFrame, bytes]:
    """(doc_id, shard, offset, n_bytes, n_tokens, dict_hash, frame) of every document, and the dictionary.

    A shard is its frames in the order of `offset`, one after the other; a document's frame is the `n_bytes` at `offset`. Each task that
    compresses lays its frames into shards of its own, some `shard_bytes` long, in the order in which it reads: no row is moved for it.
    The dictionary is trained on the serialized ids of all documents.

    An empty text has a frame of no ids; a null text has a frame of no ids and n_tokens null. Null doc_ids are carried; repeated rows have a
    frame each. Texts of any length are stored whole. Other columns play no part, whatever their names; an empty table gives none.
    """
    base = Table(docs).pick(doc_id=doc_id, text=text)
    kind = dict(base.dtypes)["doc_id"]

    def finish(keys: list, ids: np.ndarray, ends: np.ndarray, there: list[bool]) -> pa.RecordBatch:
        n = pa.array(np.diff(ends).astype(np.int32), mask=~np.array(there, dtype=bool))
        at = ends.tolist()
        return pa.RecordBatch.from_arrays([*keys, n, pa.array([serialize(ids[a:b]) for a, b in zip(at, at[1:])], pa.binary())], ["doc_id", "n_tokens", "data"])

    tokens = written(encoded(base, vocabulary, finish, f"doc_id {kind}, n_tokens int, data binary"), "tokens")
    dictionary = corpus_dictionary(tokens.where("n_tokens > 0"), "data", DICTIONARY, train_bytes)
    name = dictionary_hash(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, shard, at = _compressor(dictionary), TaskContext.get().partitionId() << 20, 0
        for batch in batches:
            frames = [press.compress(x.as_py()) for x in batch.column(2)]
            shards, offsets = [], []
            for f in frames:
                if at >= shard_bytes:
                    shard, at = shard + 1, 0
                shards.append(shard)
                offsets.append(at)
                at += len(f)
            sizes = pa.array([len(f) for f in frames], pa.int32())
            columns = [batch.column(0), pa.array(shards, pa.int64()), pa.array(offsets, pa.int64()), sizes, batch.column(1), pa.array([name] * len(frames), pa.string()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "offset", "n_bytes", "n_tokens", "dict_hash", "frame"])

    return tokens.mapInArrow(run, f"doc_id {kind}, shard long, offset long, n_bytes int, n_tokens int, dict_hash string, frame binary"), dictionary


def write_shards(store: DataFrame, dictionary: bytes, folder: str) -> DataFrame:
    """Writes `shard-N.bin` for every shard and `dictionary.zdict` into `folder` (a path or URI that all executors reach), and gives the index.

    A task writes under a name of its own and renames at the end, so a task that is run again replaces the file by an equal one. `store`
    should be a table that was written and read again: computed anew, tasks might lay its shards in another way. An empty store gives no shard.
    """
    root, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    root.create_dir(path, recursive=True)
    with root.open_output_stream(f"{path}/dictionary.zdict") as f:
        f.write(dictionary)

    def save(pdf: pd.DataFrame) -> Iterator[tuple]:
        import uuid

        there, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        shard = int(pdf["shard"].iloc[0])
        part = f"{base}/.shard-{shard}.{uuid.uuid4().hex}"
        with there.open_output_stream(part) as f:
            for frame in pdf["frame"]:
                f.write(frame)
        there.move(part, f"{base}/shard-{shard}.bin")
        for row in zip(pdf["doc_id"], pdf["shard"], pdf["offset"], pdf["n_bytes"], pdf["n_tokens"], pdf["dict_hash"]):
            yield tuple(None if pd.isna(v) else v for v in row)

    kind = dict(store.dtypes)["doc_id"]
    return stream_groups(store, ["shard"], save, f"doc_id {kind}, shard long, offset long, n_bytes int, n_tokens int, dict_hash string", ["offset"])


def query(spark, sf_dir: str) -> DataFrame:
    return token_store(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
