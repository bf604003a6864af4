"""Operator 4, best-fit packing: best-fit decreasing over a length histogram; documents take the planned slots by rank within length."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assertloom.llm.common import WS, Table

CAPACITY = 2048
#: Documents of one length that are ranked together, on average: a frequent length is cut into as many parts as that takes.
PART_ROWS = 4_000


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first rank, documents, per bin, first bin, offset in the bin), and the number of bins.

    Best-fit decreasing as if each document were placed by itself, the fullest bin that has room first, but over counts: bins of equal
    room are one group, and a length goes to whole groups. The work follows the number of lengths, not of documents.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # the distinct rooms left, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first bin, bins)
    bins = 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, count))

    for length in sorted((x for x, n in histogram.items() if n and 0 < x <= capacity), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            each = room // length
            full = min(count, left // each)
            if full:
                slots.append((length, rank, full * each, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                slots.append((length, rank, left, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, count - full)
    return slots, bins


def pieces(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, n_tokens, text): each text, or if longer than `capacity` tokens its consecutive parts of that length and the rest."""
    word = f"[^{WS}]+[{WS}]*"
    base = Table(docs).pick(doc_id=doc_id, text=text).where("text IS NOT NULL").withColumn("n", F.regexp_count("text", F.lit(f"[^{WS}]+"))).where("n > 0")
    words = F.regexp_extract_all("text", F.lit(word), F.lit(0))
    lead = F.regexp_extract("text", f"^[{WS}]*", 0)
    long = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int")),
        lambda i: F.struct(
            i.alias("piece"),
            F.least(F.lit(capacity), F.col("n") - i * capacity).cast("int").alias("n_tokens"),
            F.concat(F.when(i == 0, lead).otherwise(""), F.array_join(F.slice("words", i * capacity + 1, capacity), "")).alias("text"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.col("n").cast("int").alias("n_tokens"), F.col("text").alias("text")))
    base = base.withColumn("words", F.when(F.col("n") > capacity, words))
    return base.select("doc_id", F.explode(F.when(F.col("n") > capacity, long).otherwise(whole)).alias("p")).select("doc_id", "p.*")


def lengths(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, n_tokens) of pieces(), without making any text."""
    base = Table(docs).pick(doc_id=doc_id, text=text).select("doc_id", F.regexp_count("text", F.lit(f"[^{WS}]+")).alias("n")).where("n > 0")
    base = base.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    return base.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("n_tokens"))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """Sequences of up to `capacity` tokens: (seq_id, n_tokens, doc_ids, pieces, lengths, texts), the arrays in the order of the sequence.

    A token is what stands between ASCII white space. A text longer than the capacity is cut at tokens into pieces that fill a sequence
    each, and a rest; joined in order, a document's pieces are its text to the byte. All other texts stay whole.

    Null and empty texts, and such of white space alone, have nothing to pack and appear in no sequence. A null doc_id is carried.
    Repeated rows are packed each. Documents of one length take their slots in the order of a hash part, then of doc_id, piece and text: ties
    are between equal rows only. Other columns play no part, whatever their names; an empty table gives no sequences.
    """
    spark = docs.sparkSession
    sizes = lengths(docs, capacity, doc_id, text)
    histogram = {r.n_tokens: r.n for r in sizes.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(histogram, capacity)
    parts = F.broadcast(spark.createDataFrame([(k, -(-n // part_rows)) for k, n in histogram.items()], "n_tokens int, parts long"))
    part = F.pmod(F.xxhash64("doc_id", "piece"), "parts").alias("part")
    counts = sizes.join(parts, "n_tokens").select("n_tokens", part).groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    cut = pieces(docs, capacity, doc_id, text).join(parts, "n_tokens").select("doc_id", "piece", "n_tokens", "text", part)
    table = spark.createDataFrame(slots, "n_tokens int, first long, n long, per long, bin long, off int")
    table = table.groupBy("n_tokens").agg(F.collect_list(F.struct("first", "n", "per", "bin", "off")).alias("slots"))
    before = F.sum("n").over(Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("n_tokens", "part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("n_tokens", "part").orderBy("doc_id", "piece", "text")) - 1
    ranked = cut.withColumn("inside", inside).join(starts, ["n_tokens", "part"]).withColumn("rank", F.col("start") + F.col("inside"))
    table = F.broadcast(table) if len(slots) <= 100_000 else table
    placed = ranked.join(table, "n_tokens").withColumn("s", F.get(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["n"])), 0))
    at = F.col("rank") - F.col("s.first")
    placed = placed.select(
        (F.col("s.bin") + F.floor(at / F.col("s.per"))).cast("long").alias("seq_id"),
        F.struct((F.col("s.off") + at % F.col("s.per") * F.col("n_tokens")).cast("int").alias("at"), "doc_id", "piece", "n_tokens", "text").alias("x"),
    )
    out = placed.groupBy("seq_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    total = F.aggregate("x.n_tokens", F.lit(0), lambda a, b: a + b)
    return out.select("seq_id", total.alias("n_tokens"), F.col("x.doc_id").alias("doc_ids"), F.col("x.piece").alias("pieces"), F.col("x.n_tokens").alias("lengths"), F.col("x.text").alias("texts"))


def query(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
