"""BPE and the token store: exact round trips."""

import random

import pyarrow.fs as fs
import pytest
import regex
from pyspark.sql import functions as F

from assertloom.llm import bpe, pieces, token_store

PATH = f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"


def odd_texts():
    r = random.Random(5)
    out = ["", " ", "a", "naïve café", "日本語" * 700, "x" * 5000, " " * 6000, "ab" * 3000 + " tail", "<|endoftext|>", "\n\n\n", "🙂" * 900, "".join(r.choice("abcxyz") for _ in range(9000))]
    return out + ["".join(r.choice("ab 1'ß\n") for _ in range(r.randrange(3000))) for _ in range(40)]


@pytest.mark.parametrize("leaf", [7, 64, 1024])
def test_tree_concatenation_is_exact(leaf):
    enc = bpe.encoding(PATH)
    for text in odd_texts():
        data = text.encode()
        if data:
            assert bpe.tree(enc, [bpe.piece(enc, x) for x in bpe.halves(data, leaf)]) == bpe.piece(enc, data)


@pytest.mark.parametrize("leaf", [16, 1024])
def test_encode_and_decode(spark, leaf):
    enc = bpe.encoding(PATH)
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "x" * 4000), (900, None), (5, "x" * 5000), (5, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "_rid": F.lit(2)})
    got = bpe.bpe_round_trip(df, leaf=leaf).collect()
    assert len(got) == len(rows)
    want = sorted((d or -1, t or "", None if t is None else enc.encode_ordinary(t)) for d, t in rows)
    assert sorted(((r.doc_id or -1, r.text or "", r.ids) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_tokens == (None if r.ids is None else len(r.ids)) for r in got)
    assert bpe.bpe_encode(df.limit(0)).count() == 0


def test_splitter_and_table_are_exact():
    """Every text with one encoder call; with characters of all classes, and names kept through a full memory."""
    enc, r = bpe.encoding(PATH), random.Random(1)
    alphabet = ["a", "B", "é", "ß", "1", "٣", "²", " ", " ", "\u00a0", "\n", "\t", "\u3000", "'", "'s", "'ll", "'re", "'d", "!", "日", "🙂", "\u180e", "\uffff", "\u0301", "word", "12"]
    texts = odd_texts() + ["".join(r.choice(alphabet) for _ in range(r.randrange(20))) for _ in range(4000)]
    encoder, decoder = pieces.Encoder(enc), pieces.Decoder(enc)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        ids, ends = encoder.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [enc.encode_ordinary(t) for t in part]
        data, size = decoder.decode(ids, ends)
        assert [bytes(data[a:b]).decode() for a, b in zip(size, size[1:])] == part
    assert encoder.encode([])[1].tolist() == [0]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 50)
    enc = bpe.encoding(PATH)
    encoder = pieces.Encoder(enc)
    for i in range(40):
        text = " ".join(f"w{i}x{k}" for k in range(20))
        assert encoder.encode([text])[0].tolist() == enc.encode_ordinary(text)
    assert encoder.n <= 300


def test_classes_are_those_of_the_pattern():
    kinds = pieces.classes()
    for pattern, kind in ((r"\p{L}", (pieces.LETTER,)), (r"\p{N}", (pieces.NUMBER,)), (r"\s", (pieces.SPACE, pieces.WHITE))):
        p = regex.compile(pattern)
        for c in (x for x in range(0x110000) if kinds[x] not in (pieces.UNSURE, pieces.END)):
            assert bool(p.match(chr(c))) == (kinds[c] in kind), hex(c)


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([(1, [64]), (2, None), (3, []), (4, [10**6]), (5, [None])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.bpe_decode(df).collect()} == {1: "a", 2: None, 3: "", 4: None, 5: None}


def test_query_is_a_round_trip(spark, sf):
    bad = bpe.query(spark, sf).alias("r").join(spark.read.parquet(f"{sf}/documents.parquet").alias("d"), "doc_id").where("NOT r.text <=> d.text")
    assert bad.count() == 0


def test_store(spark, sf, tmp_path):
    enc = bpe.encoding(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "x y"), (9001, None), (9002, ""), (9003, "z " * 60000), (9004, "same"), (9004, "same")], "doc_id long, text string")
    df = docs.unionByName(extra).withColumns({"frame": F.lit(1), "shard": F.lit("s")})
    store, dictionary = token_store.token_store(df, shard_bytes=5000, train_bytes=40_000)
    rows = store.collect()
    name = token_store.dictionary_hash(dictionary)
    texts = sorted(((r.doc_id or -1, r.text or "") for r in df.collect()))
    back = sorted((r.doc_id or -1, enc.decode(token_store.decode_frame(r.frame, dictionary, name).tolist())) for r in rows)
    assert back == texts and {r.dict_hash for r in rows} == {name}
    assert sorted(r.n_tokens is None for r in rows if r.doc_id == 9001) == [True]
    with pytest.raises(ValueError):
        token_store.decode_frame(rows[0].frame, dictionary, "0")
    index = token_store.write_shards(store, dictionary, f"file://{tmp_path}").collect()
    there = fs.LocalFileSystem()
    by = {}
    for r in index:
        with there.open_input_file(f"{tmp_path}/shard-{r.shard}.bin") as f:
            f.seek(r.offset)
            by.setdefault((r.doc_id or -1), []).append(enc.decode(token_store.decode_frame(f.read(r.n_bytes), dictionary, r.dict_hash).tolist()))
    assert sorted((d, t) for d, ts in by.items() for t in ts) == texts
    assert len({r.shard for r in rows}) > 3
    plain = sum(len(token_store.serialize(enc.encode_ordinary(t))) for _, t in texts)
    assert sum(r.n_bytes for r in rows) < plain


def test_store_of_nothing(spark):
    store, dictionary = token_store.token_store(spark.createDataFrame([], "doc_id long, text string"))
    assert store.count() == 0 and dictionary == b""
    assert token_store.deserialize(token_store.serialize([70000, 1])).tolist() == [70000, 1]
