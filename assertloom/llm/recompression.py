"""Operator 2, substring dedup by recompression: equal passages get equal interior symbols; shared symbols reveal them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assertloom.llm.common import WS, Table, Words, mix

#: A passage is repeated text of this many tokens or more.
MIN_TOKENS = 50
#: Rounds of naming, the length at which a symbol stops growing, and the least length of a symbol that can reveal a repeat.
ROUNDS, GROWN, LEAST = 8, 8, 4
#: Text that repeats itself with a period up to this has too few different tokens to be sure of longer symbols.
PERIOD = 8

_U = np.uint64
_PHI = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def recompress(sym: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS, grown: int = GROWN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, first token, tokens) of the text's high-level symbols, after `rounds` of naming runs and then pairs.

    A name is a hash of what it stands for, so all tasks of a round give equal runs and pairs the same name without a shared table, and
    whether two neighbours pair depends on them alone: inside equal passages the symbols are equal, but for some at the two ends.
    In each round a hash bit parts the alphabet in left and right symbols, and a left one pairs with a right one after it. A symbol of
    `grown` tokens stays as it is. A long run is named without its length: its ends needn't be those of the repeat within it.
    """
    start = np.arange(len(sym))
    size = np.ones(len(sym), dtype=np.int64)
    for r in range(rounds):
        if len(sym) < 2:
            break
        live = size < grown
        joins = (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1]) & live[1:] & live[:-1]
        if joins.any():
            head = np.flatnonzero(np.concatenate([[True], ~joins]))
            n = np.diff(np.append(head, len(sym)))
            total = np.add.reduceat(size, head)
            name = mix(sym[head] * _PHI + np.where(total >= grown, 0, n).astype(np.uint64) + _U(0x51))
            sym, start, doc, size = np.where(n > 1, name, sym[head]), start[head], doc[head], total
            live = size < grown
        right = (mix(sym + _U((r + 1) * int(_PHI) % 2**64)) & _U(1)).astype(bool)
        pair = np.flatnonzero((doc[1:] == doc[:-1]) & ~right[:-1] & right[1:] & live[1:] & live[:-1])
        sym = sym.copy()
        sym[pair] = mix(mix(sym[pair]) * _PHI + sym[pair + 1])
        size = size.copy()
        size[pair] += size[pair + 1]
        keep = np.ones(len(sym), dtype=bool)
        keep[pair + 1] = False
        sym, start, doc, size = sym[keep], start[keep], doc[keep], size[keep]
    return sym, start, size


def _chunks(batches: Iterator[pa.RecordBatch], text: int | str, most: int = 400_000):
    """Slices of batches with up to `most` tokens: (batch, row numbers, token hashes, row of each token)."""
    words = Words()
    for batch in batches:
        rows, parts, n = [], [], 0
        for i, t in enumerate(batch.column(text)):
            h = words.hashes(t.as_py().encode().split())
            rows.append(i)
            parts.append(h)
            n += len(h)
            if n > most or i == len(batch) - 1:
                yield batch, rows, np.concatenate(parts), np.repeat(np.arange(len(rows)), [len(p) for p in parts])
                rows, parts, n = [], [], 0


def periodic(h: np.ndarray, doc: np.ndarray, length: int, most: int = PERIOD) -> tuple[np.ndarray, np.ndarray]:
    """(first token, tokens) of stretches of at least `length` tokens beyond their first period, in which every token is as one period earlier."""
    starts, sizes = [], []
    for p in range(1, most + 1):
        same = (h[p:] == h[:-p]) & (doc[p:] == doc[:-p])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        a, b = edge[::2], edge[1::2]
        long = b - a >= length
        starts.append(a[long])
        sizes.append(b[long] - a[long] + p)
    return np.concatenate(starts), np.concatenate(sizes)


def _spread(name: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys for a shuffle: the name of each first row, and for the others, whose names the first stands for, numbers that spread them."""
    rows = np.arange(len(name), dtype=np.uint64)
    return np.where(first == rows, name, mix(name + (rows + _U(1)) * _PHI)).view(np.int64)


def _name(rounds: int, grown: int, least: int, width: int, text: str):
    """Symbols that can reveal a repeat: (key, known, _d, _r, start, size); `known` are those of which one chunk of texts has two or more.

    Of a symbol that is everywhere, only one row a chunk has its name as key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, h, doc in _chunks(batches, text):
            sym, start, size = recompress(h, doc, rounds, grown)
            if not len(sym):
                continue
            first = np.searchsorted(doc, np.arange(len(rows)))
            again, length = periodic(h, doc, width // 4)
            # a symbol longer than a window, or periodic text, repeats itself: it counts twice
            sym, start = np.concatenate([sym, mix(h[again] ^ length.astype(np.uint64)), mix(h[again] ^ length.astype(np.uint64))]), np.concatenate([start, again, again])
            size = np.concatenate([size, length, length])
            keep = np.repeat(np.arange(len(sym)), np.where(size >= least, 1 + (size >= width), 0))
            own = doc[start[keep]]
            take = pa.array(np.array(rows)[own])
            _, at, back, n = np.unique(sym[keep], return_index=True, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_spread(sym[keep], at[back])), pa.array(n[back] > 1), batch.column("_d").take(take), batch.column("_r").take(take), pa.array((start[keep] - first[own]).astype(np.int32)), pa.array(size[keep].astype(np.int32))],
                ["key", "known", "_d", "_r", "start", "size"],
            )

    return run


def windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of `width` tokens, from prefix sums of powers."""
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(len(h), _PHI)]))
    back = np.cumprod(np.concatenate([[_U(1)], np.full(len(h) - width, _INV)]))
    out = []
    for x in (h, mix(h ^ _U(0xA5A5A5A5A5A5A5A5))):
        total = np.concatenate([[_U(0)], np.cumsum(x * powers[:-1])])
        out.append(mix((total[width:] - total[:-width]) * back))
    return out[0], out[1]


def _candidates(width: int, text: str):
    """Windows at least a quarter of which is covered by symbols that occur again: (key, later, doc_id, r, at), `at` with 15 more hash bits above 32.

    `later` are those that stand earlier in the same chunk of texts; of a window that is everywhere, only one row a chunk has its name as key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, h, doc in _chunks(batches, text, 200_000):
            first = np.searchsorted(doc, np.arange(len(rows) + 1))
            spans, ids, ranks = batch.column("spans"), batch.column("_d"), batch.column("_r")
            out = []
            for j, i in enumerate(rows):
                a, b = first[j], first[j + 1]
                if b - a < width:
                    continue
                flat = spans[i].values
                mine = flat.field("_r").to_numpy() == ranks[i].as_py()
                starts = flat.field("start").to_numpy()[mine]
                steps = np.zeros(b - a + 1, dtype=np.int32)
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + flat.field("size").to_numpy()[mine], -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
                at = np.flatnonzero(covered[width:] - covered[:-width] >= width // 4)
                if len(at):
                    fp, check = windows(h[a:b], width)
                    out.append((i, at.astype(np.int64) | (check[at] >> _U(49)).astype(np.int64) << 32, fp[at]))
            if out:
                take = pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]))
                at, fp = (np.concatenate([o[k] for o in out]) for k in (1, 2))
                own, rank = ids.take(take), ranks.take(take)
                first = np.arange(len(fp))
                order = list(zip(ids.take(pa.array(rows)).to_pylist(), ranks.take(pa.array(rows)).to_pylist()))
                if all(a <= b for a, b in zip(order, order[1:])):  # as the join leaves them
                    _, some, back = np.unique(fp, return_index=True, return_inverse=True)
                    first = np.where(at >> 32 == at[some[back]] >> 32, some[back], first)
                yield pa.RecordBatch.from_arrays([pa.array(_spread(fp, first)), pa.array(first != np.arange(len(fp))), own, rank, pa.array(at)], ["key", "later", "doc_id", "r", "at"])

    return run


def _repeated(full: DataFrame, text: str, min_tokens: int) -> DataFrame:
    """(_d, marks): an array of rank << 32 | position, where a window begins that stands earlier, in the order (doc_id, rank, position); `full` has those as _d and _r.

    `full` goes whole into each Python stage, and all its joins are on _d alone, so that Spark shuffles the texts once.
    """
    least = min(LEAST, max(1, min_tokens // 12))
    grown = max(2, min(GROWN, min_tokens // 6))
    kind = dict(full.dtypes)["_d"]
    named = full.mapInArrow(_name(ROUNDS, grown, least, min_tokens, text), f"key long, known boolean, _d {kind}, _r int, start int, size int")
    shared = named.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("known OR n > 1")
    spans = shared.groupBy("_d").agg(F.collect_list(F.struct("_r", "start", "size")).alias("spans"))
    cut = full.join(spans, "_d").mapInArrow(_candidates(min_tokens, text), f"key long, later boolean, doc_id {kind}, r int, at long")
    # rows cross the shuffle flat; the structs that order them are made after it
    cut = cut.select("key", "later", "at", "doc_id", "r").repartition("key")
    place = F.struct("doc_id", "r", F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("at"), F.shiftright("at", 32).alias("check"))
    both = cut.select("later", place.alias("place"), F.min(place).over(Window.partitionBy("key")).alias("first"))
    later = both.where("later OR place > first AND place.check = first.check")
    mark = F.shiftleft(F.col("place.r").cast("long"), 32).bitwiseOR(F.col("place.at").cast("long"))
    return later.groupBy(F.col("place.doc_id").alias("_d")).agg(F.array_sort(F.collect_set(mark)).alias("marks"))


def substring_dedup(docs: DataFrame, min_tokens: int = MIN_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every repeated passage cut from all places but its first, and a new last column `n_removed`, the tokens cut.

    Tokens are what stands between ASCII white space. A window of `min_tokens` tokens is repeated if the same tokens stand earlier, in the
    order of doc_id (then of the text's hash, and of the position); each token of a repeated window goes, with the white space after
    it. So a passage of `min_tokens` tokens or more stays just once in the corpus, and a copy of a whole document becomes empty.
    Windows that overlap within one text count too: of a long run of one token, or of a few in turn, one period is left.

    A text that holds no repeat stays as it is to the byte. Rows with a null doc_id or a null text stay as they are (`n_removed` 0); so do
    texts of fewer tokens. Rows equal in doc_id and text are one document and get the same text. All other columns stay, whatever their
    names, but an input column called n_removed gives way; an `n_chars` column is set to the new length. An empty table stays empty.
    Very long texts are read whole. The reveal step needs a quarter of a repeated window to lie in symbols of 4 tokens or more that the copies
    share, or in text with a period of up to 8: of isolated repeats of exactly 50 random tokens some 1 in 3,000 has less and stays (of 20 words or fewer
    in turn, 2 in 3,000). Which windows are repeated is then decided on the windows' own 79-bit hashes. doc_id can be of any type that has an order.
    """
    t = Table(docs)
    body = t.at(text)
    known = t.at(doc_id).isNotNull() & body.isNotNull()
    full = t.df.where(known).withColumns({"_d": t.at(doc_id), "_h": F.xxhash64(body)})
    # texts of one doc_id are told apart by rank, which takes less room in each window's row than a hash: it is 0 as a rule
    full = full.withColumn("_r", F.dense_rank().over(Window.partitionBy("_d").orderBy("_h")) - 1)
    df = full.join(_repeated(full, t.inner(text), min_tokens), "_d", "left")
    own = F.transform(F.filter("marks", lambda m: F.shiftright(m, 32) == F.col("_r")), lambda m: m.bitwiseAND(0xFFFFFFFF).cast("int"))
    df = df.withColumn("starts", own).withColumn("_spans", F.when(F.size("starts") > 0, _spans(min_tokens)))
    keep = F.concat(
        F.array(F.struct(F.lit(0).alias("a"), F.element_at("_spans", 1)["a"].alias("b"))),
        F.zip_with("_spans", F.slice("_spans", 2, 1_000_000_000), lambda x, y: F.struct(x["b"].alias("a"), F.coalesce(y["a"], F.lit(2**31 - 1)).alias("b"))),
    )
    cut = F.col("_spans").isNotNull()
    df = df.withColumn("_pieces", F.when(cut, F.regexp_extract_all(body, F.lit(f"[^{WS}]+[{WS}]*"), F.lit(0))))
    left = F.flatten(F.transform(keep, lambda s: F.slice(F.col("_pieces"), s["a"] + 1, s["b"] - s["a"])))
    new = F.when(cut, F.concat(F.regexp_extract(body, f"^[{WS}]*", 0), F.array_join(left, ""))).otherwise(body)
    gone = F.when(cut, F.aggregate("_spans", F.lit(0), lambda a, s: a + s["b"] - s["a"])).otherwise(0).cast("long")
    df = df.withColumns({"_new": new, "_gone": gone}).unionByName(t.df.where(~known).withColumns({"_new": body, "_gone": F.lit(0).cast("long")}), allowMissingColumns=True)
    out, names = [], []
    for i, name in enumerate(t.names):
        if name.lower() == "n_removed":
            continue
        column = F.col(f"_{i}_")
        if f"_{i}_" == t.inner(text):
            column = F.col("_new")
        elif name == "n_chars":
            column = F.when(F.col("_gone") > 0, F.length("_new").cast(t.df.schema[i].dataType)).otherwise(column)
        out.append(column)
        names.append(name)
    return df.select(*out, "_gone").toDF(*names, "n_removed")


def _spans(width: int) -> Column:
    """Merged token spans [a, b) of sorted window starts: a span begins where the window before has ended, and ends where the next begins."""
    col = F.col("starts")
    firsts = F.filter(col, lambda s, i: (i == 0) | (F.get(col, i - 1) + width < s))
    lasts = F.filter(col, lambda s, i: (i == F.size(col) - 1) | (F.get(col, i + 1) > s + width))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("a"), (b + width).cast("int").alias("b")))


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CLASS = r"[ \t\n\x0B\f\r]"
ORACLE = f"""
WITH t AS (SELECT doc_id, text, lang, source, n_chars, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+[ \\t\\n\\x0B\\f\\r]*') AS p FROM documents),
w AS (SELECT doc_id, pos, array_to_string(list_transform(p[pos + 1:pos + {MIN_TOKENS}], lambda x: regexp_replace(x, '{_CLASS}+', '')), ' ') AS k
  FROM (SELECT doc_id, p, unnest(range(0, len(p) - {MIN_TOKENS - 1})) AS pos FROM t WHERE len(p) >= {MIN_TOKENS})),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM w) WHERE n > 1),
c AS (SELECT doc_id, list(DISTINCT x) AS gone FROM (SELECT doc_id, unnest(range(pos, pos + {MIN_TOKENS})) AS x FROM r) GROUP BY doc_id),
o AS (SELECT t.doc_id, text, lang, source, n_chars, p, gone FROM t LEFT JOIN c ON c.doc_id = t.doc_id),
k AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS kept FROM (SELECT o.doc_id, unnest(range(0, len(p))) AS i, unnest(p) AS piece FROM o WHERE gone IS NOT NULL) u
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS x FROM c) g WHERE g.doc_id = u.doc_id AND g.x = u.i) GROUP BY doc_id)
SELECT o.doc_id, CASE WHEN gone IS NULL THEN text ELSE concat(regexp_extract(text, '^{_CLASS}*'), coalesce(kept, '')) END AS text, lang, source,
  CASE WHEN gone IS NULL THEN n_chars ELSE length(concat(regexp_extract(text, '^{_CLASS}*'), coalesce(kept, ''))) END AS n_chars,
  coalesce(len(gone), 0)::BIGINT AS n_removed
FROM o LEFT JOIN k ON k.doc_id = o.doc_id"""
