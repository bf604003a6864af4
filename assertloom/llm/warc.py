"""Operator 10, WARC: records and files of web pages, and a Merkle fixity audit of replicas."""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assertloom.llm.common import Table, stream_groups
from assertloom.session import release, written

#: Page numbers of a file, children of a tree node, and the date that records bear.
PER_FILE, FAN = 1000, 16
DATE = "1970-01-01T00:00:00Z"
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def record(url: Column, html: Column, page_id: Column, date: str = DATE) -> Column:
    """A page as the text of a WARC resource record; its bytes are the text's UTF-8."""
    body = F.coalesce(html, F.lit(""))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.coalesce(F.regexp_replace(url, "[\r\n]+", " "), F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def _placed(pages: DataFrame, per_file: int, page_id: str, url: str, html: str, keep: bool) -> tuple[DataFrame, bool]:
    """(page_id, n, digest, file, slot, bits[, record]), and whether ids are whole numbers; `bits` part the records of an overfull file."""
    base = Table(pages).pick(page_id=page_id, url=url, html=html)
    whole = dict(base.dtypes)["page_id"] in _INTEGERS
    if not whole:
        base = base.withColumn("page_id", F.col("page_id").cast("string"))
    base = base.select("page_id", record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))
    base = base.withColumns({"digest": F.sha2("record", 256), "n": F.octet_length("record").cast("long"), "bits": F.conv(F.substring(F.sha2("record", 256), 1, 8), 16, 10).cast("long")})
    base = base if keep else base.drop("record")
    number = F.col("page_id").cast("long") if whole else F.pmod(F.xxhash64("page_id"), F.lit(1 << 40))
    file = F.floor(number / per_file).cast("long") if whole else F.pmod(number, F.lit(per_file))
    slot = F.pmod(number, F.lit(per_file)) if whole else F.shiftright(number, 20) % per_file
    return base.withColumns({"file": F.coalesce(file, F.lit(-1)), "slot": F.coalesce(slot, F.lit(0)).cast("int")}), whole


def _crowded(*placed: DataFrame, per_file: int) -> DataFrame:
    """(file, parts) of the files with more than four times `per_file` different records in a table, cut so that parts have some `per_file`."""
    counts = [p.groupBy("file").agg(F.count(F.lit(1)).alias("c")) for p in placed]
    both = counts[0]
    for c in counts[1:]:
        both = both.unionByName(c)
    return both.groupBy("file").agg(F.max("c").alias("c")).where(F.col("c") > 4 * per_file).select("file", F.ceil(F.col("c") / per_file).alias("parts"))


def _laid(placed: DataFrame, crowded: DataFrame, keep: bool) -> DataFrame:
    """Equal records as one with their number, in the order of their part of the file: (file, part, slot, page_id, begin, end, copies, digest)."""
    own = ["record"] if keep else []
    part = F.coalesce((F.col("bits") * F.col("parts") / (1 << 32)).cast("int"), F.lit(0))
    df = placed.join(crowded, "file", "left").withColumn("part", part)
    df = df.groupBy("file", "part", "slot", "page_id", "digest", "n").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in own])
    order = Window.partitionBy("file", "part").orderBy("slot", "page_id", "digest")
    df = df.withColumn("end", F.sum(F.col("n") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.select("file", "part", "slot", "page_id", (F.col("end") - F.col("n") * F.col("copies")).alias("begin"), "end", "copies", "digest", *own)


def records(pages: DataFrame, per_file: int = PER_FILE, page_id: str = "page_id", url: str = "url", html: str = "html", keep: bool = False) -> DataFrame:
    """(file, part, slot, page_id, begin, end, copies, digest[, record]): the records of pages and their places.

    A page goes to file floor(page_id / per_file), at the slot page_id mod per_file; ids that aren't whole numbers go to one of `per_file`
    files by hash, a null one to file -1. A file with many more records than `per_file` is cut into parts by digest, so that no task has one page_id's rows
    all. In a part, records stand by slot, page_id and digest; equal records are one with their number of `copies`. `begin` and `end` are byte
    offsets in the part without compression. A null url or html is an empty one. Other columns play no part; an empty table gives none.
    """
    placed, _ = _placed(pages, per_file, page_id, url, html, keep)
    return _laid(placed, _crowded(placed, per_file=per_file), keep)


def _above(nodes: DataFrame, fan: int) -> DataFrame:
    """The parents of nodes (file, part, node, page_id, begin, end, copies, digest): each digests its children's offset ranges, counted from its own begin, and digests.

    As offsets are counted from the node's begin, a record that is longer, gone or new changes the nodes above it and no others.
    """
    up = ["file", "part", F.floor(F.col("node") / fan).cast("long").alias("node")]
    child = F.struct("node", F.coalesce(F.col("page_id"), F.lit("")).alias("page_id"), "begin", "end", "copies", "digest")
    grouped = nodes.groupBy(*up).agg(F.array_sort(F.collect_list(child)).alias("c"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    lines = F.transform("c", lambda x: F.concat_ws(" ", x["node"], x["page_id"], x["begin"] - F.col("begin"), x["end"] - F.col("begin"), x["copies"], x["digest"]))
    return grouped.select("file", "part", "node", F.lit(None).cast("string").alias("page_id"), "begin", "end", F.lit(1).cast("long").alias("copies"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def levels(per_file: int = PER_FILE, fan: int = FAN) -> int:
    """Levels above the slots until a file's part has one root."""
    n = 1
    while fan**n < per_file:
        n += 1
    return n


def tree(leaves: DataFrame, per_file: int = PER_FILE, fan: int = FAN) -> list[DataFrame]:
    """Levels of every part's tree over records(): first the records, each at its slot, then nodes up to one root; each level is written.

    An empty table gives empty levels. Nulls and ties don't arise but in page_id, whose records are told apart by digest.
    """
    out = [leaves]
    now = leaves.select("file", "part", F.col("slot").cast("long").alias("node"), F.col("page_id").cast("string").alias("page_id"), "begin", "end", "copies", "digest")
    for _ in range(levels(per_file, fan)):
        now = written(_above(now, fan), "merkle")
        out.append(now)
    return out


def audit_trees(left: list[DataFrame], right: list[DataFrame], fan: int = FAN) -> DataFrame:
    """(file, page_id, state, begin_a, end_a, copies_a, digest_a, begin_b, end_b, copies_b, digest_b): the records in which two replicas differ.

    Compares the roots, then at each level only the children of nodes that differ; below the last, records are matched by page_id and digest.
    state: `changed` (of one page_id, another digest), `copies` (the same record another number of times), `missing` (only in the first), `extra` (only in
    the second); what only lies elsewhere is intact and not named. Equal trees, also empty ones, give no rows.
    """
    differ: DataFrame | None = None
    for level in range(len(left) - 1, 0, -1):
        a, b = left[level], right[level]
        if differ is not None:
            a, b = (x.withColumn("up", F.floor(F.col("node") / fan).cast("long")).join(differ.withColumnRenamed("node", "up"), ["file", "part", "up"], "left_semi") for x in (a, b))
        a, b = (x.select("file", "part", "node", F.struct((F.col("end") - F.col("begin")).alias("size"), "digest").alias(k)) for x, k in ((a, "a"), (b, "b")))
        differ = written(a.join(b, ["file", "part", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "part", "node"), "differ")
    low = [x.withColumn("node", F.floor(F.col("slot") / fan).cast("long")).join(differ, ["file", "part", "node"], "left_semi") for x in (left[0], right[0])]
    # null ids meet too
    key = ["file", "part", "slot", "known", "id"]
    known, name = F.col("page_id").isNotNull().alias("known"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id")
    a, b = (x.select("file", "part", "slot", known, name, F.col("page_id").alias(f"id_{k}"), "digest", F.struct("begin", "end", "copies", "digest").alias(k)) for x, k in zip(low, "ab"))
    odd = a.join(b, [*key, "digest"], "full").where(~F.col("a.copies").eqNullSafe(F.col("b.copies")))
    # what only one replica has of a page_id is paired with what only the other has, in the order of digests
    side = F.when(F.col("a").isNull(), 2).when(F.col("b").isNull(), 1).otherwise(0)
    odd = odd.withColumn("side", side).withColumn("nth", F.row_number().over(Window.partitionBy(*key, "side").orderBy("digest")))
    turn = F.when(F.col("side") == 0, -F.col("nth")).otherwise(F.col("nth")).alias("nth")
    met = odd.groupBy(*key, turn).agg(F.first("a", True).alias("a"), F.first("b", True).alias("b"), F.coalesce(F.first("id_a", True), F.first("id_b", True)).alias("page_id"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a.digest") == F.col("b.digest"), "copies").otherwise("changed")
    return met.select("file", "page_id", state.alias("state"), *[F.col(f"{k}.{c}").alias(f"{c}_{k}") for k in "ab" for c in ("begin", "end", "copies", "digest")])


def fixity_audit(pages: DataFrame, replica: DataFrame, per_file: int = PER_FILE, fan: int = FAN) -> DataFrame:
    """audit_trees of the files that two tables of pages make; equal tables give no rows, and so do two empty ones.

    Nulls, repeated rows, clashing names and empty tables are as in records(); pages of any length are whole. Of a file that is cut into
    parts, a changed page may be told as missing and extra, as its two digests can be in two parts. page_id is text unless both have whole numbers.
    """
    (a, whole_a), (b, whole_b) = (_placed(x, per_file, "page_id", "url", "html", False) for x in (pages, replica))
    if whole_a != whole_b:
        raise ValueError("page_id is a whole number in one replica only")
    crowded = _crowded(a, b, per_file=per_file)
    a, b = (written(_laid(x, crowded, False), "records") for x in (a, b))
    trees = [tree(x, per_file, fan) for x in (a, b)]
    out = audit_trees(*trees, fan)
    for level in (*trees[0][1:], *trees[1][1:]):  # all but the records have been compared by now
        release(level)
    return out


def write_warc(pages: DataFrame, folder: str, per_file: int = PER_FILE) -> DataFrame:
    """Writes `pages-FILE-PART.warc.gz`, a gzip member a record, into `folder` (a path or URI that all executors reach); gives (path, n_records).

    A task writes under a name of its own and renames at the end: run again, it replaces the file by an equal one. Nulls and repeated rows are
    as in records(), whose copies are written each; an empty table gives no file.
    """

    def save(pdf: pd.DataFrame) -> Iterator[tuple]:
        there, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        there.create_dir(base, recursive=True)
        name = f"pages-{int(pdf['file'].iloc[0])}-{int(pdf['part'].iloc[0])}.warc.gz"
        part = f"{base}/.{name}.{uuid.uuid4().hex}"
        with there.open_output_stream(part) as out:
            for r, copies in zip(pdf["record"], pdf["copies"]):
                member = gzip.compress(r.encode(), 6, mtime=0)
                for _ in range(int(copies)):
                    out.write(member)
        there.move(part, f"{base}/{name}")
        yield f"{folder.rstrip('/')}/{name}", int(pdf["copies"].sum())

    return stream_groups(records(pages, per_file, keep=True), ["file", "part"], save, "path string, n_records long", ["begin"])


class Damaged(Exception):
    """The rest of a file can't be read."""


def _plain(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """A file's bytes in parts, inflated if it is gzip; Damaged where its last member ends early or isn't gzip."""
    first = read(1 << 16)
    if first[:2] != b"\x1f\x8b":
        while first:
            yield first
            first = read(1 << 20)
        return
    inflate, rest, inside = zlib.decompressobj(31), first, False
    while rest:
        while rest:
            if not inside:
                rest = rest.lstrip(b"\0")  # padding between members
                if not rest:
                    break
            inside = True
            try:
                out = inflate.decompress(rest, 1 << 20)
            except zlib.error as e:
                raise Damaged(str(e)) from e
            if out:
                yield out
            rest = inflate.unconsumed_tail
            if inflate.eof:
                rest, inflate, inside = inflate.unused_data, zlib.decompressobj(31), False
        rest = read(1 << 20)
    if inside:
        raise Damaged("the last member ends early")


def parse(source: bytes | Iterator[bytes]) -> Iterator[tuple[int, dict[str, str] | None, bytes]]:
    """(offset without compression, headers by lower-case name, content) of each record, holding no more than one of them.

    What stands between records is passed over. At the end of a file that is cut off or damaged comes (offset of what can't be read, None, b"").
    """
    parts = iter([source]) if isinstance(source, (bytes, bytearray)) else source
    held, base, over, broken = bytearray(), 0, False, False

    def more() -> None:
        nonlocal over, broken
        try:
            held.extend(next(parts))
        except StopIteration:
            over = True
        except Damaged:
            over = broken = True

    def drop(n: int) -> None:
        nonlocal base
        del held[:n]
        base += n

    while True:
        start = held.find(b"WARC/")
        if start < 0:
            if over:
                break
            drop(max(0, len(held) - 4))
            more()
            continue
        drop(start)
        stop = held.find(b"\r\n\r\n")
        while stop < 0 and not over:
            seen = len(held)
            more()
            stop = held.find(b"\r\n\r\n", max(0, seen - 3))
        if stop < 0:
            broken = True
            break
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in held[:stop].decode("utf-8", "replace").split("\r\n")[1:]))
        if not re.fullmatch(r"\d+", head.get("content-length", "")):
            drop(5)
            continue
        end = stop + 4 + int(head["content-length"])
        while len(held) < end and not over:
            more()
        if len(held) < end:
            broken = True
            break
        yield base, head, bytes(held[stop + 4 : end])
        drop(end)
    if broken:
        yield base, None, b""


def read_warc(spark, folder: str) -> DataFrame:
    """(path, begin, type, record_id, url, content) of every record in the .warc and .warc.gz files of a folder, `begin` an offset without compression.

    Files are read as streams, a task holding some records at a time. Of a file that is cut off or damaged, what comes before is read; then it has a row of type
    `damaged` with the offset of what isn't, and nulls. A header that a record lacks is null. Files without records, also empty ones, give no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(folder).select("path")
    names = ["path", "begin", "type", "record_id", "url", "content"]

    def opened(path: str) -> BinaryIO:
        there, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        return there.open_input_stream(at, compression=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows, size = [], 0
                with opened(path) as f:
                    for at, h, body in parse(_plain(f.read)):
                        rows.append((path, at, "damaged", None, None, None) if h is None else (path, at, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), body))
                        size += len(body)
                        if size > 16_000_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, "path string, begin long, type string, record_id string, url string, content binary")


def faulty(pages: DataFrame) -> DataFrame:
    """The replica of the query: by page_id, one page in 89 has a byte changed, one in 97 is longer, one in 101 is missing, and one in 103 is there once more under a new id."""
    p, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    changed = F.when(p % 89 == 5, F.concat(F.lit("~"), F.substring(html, 2, 2**31 - 1))).when(p % 97 == 7, F.concat(html, F.lit("<!-- longer -->"))).otherwise(F.col("html"))
    kept = pages.where((p % 101 != 11) | p.isNull()).select("page_id", "url", changed.alias("html"))
    more = pages.where(p % 103 == 13).select((-p - 1).alias("page_id"), "url", "html")
    return kept.unionByName(more)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return fixity_audit(pages, faulty(pages))


def _sql_records(name: str, source: str) -> str:
    text = f"""concat('WARC/1.1', rn, 'WARC-Type: resource', rn, 'WARC-Record-ID: <urn:page:', coalesce(page_id::VARCHAR, 'none'), '>', rn, 'WARC-Date: {DATE}', rn, 'WARC-Target-URI: ',
    coalesce(regexp_replace(url, '[\\r\\n]+', ' ', 'g'), ''), rn, 'Content-Type: text/html; charset=utf-8', rn, 'Content-Length: ', strlen(body), rn, rn, body, rn, rn)"""
    return f"""{name} AS (SELECT page_id, file, digest, copies, sum(n * copies) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) AS e, n * copies AS size FROM
  (SELECT page_id, coalesce(floor(page_id / {PER_FILE})::BIGINT, -1) AS file, strlen(r) AS n, sha256(r) AS digest, count(*) AS copies FROM
    (SELECT page_id, {text} AS r FROM (SELECT page_id, url, coalesce(html, '') AS body, chr(13) || chr(10) AS rn FROM {source})) GROUP BY ALL))"""


ORACLE = f"""
WITH replica AS (SELECT page_id, url, CASE WHEN page_id % 89 = 5 THEN '~' || substr(coalesce(html, ''), 2) WHEN page_id % 97 = 7 THEN coalesce(html, '') || '<!-- longer -->' ELSE html END AS html
    FROM pages WHERE page_id % 101 <> 11 OR page_id IS NULL
  UNION ALL SELECT -page_id - 1, url, html FROM pages WHERE page_id % 103 = 13),
{_sql_records("a", "pages")}, {_sql_records("b", "replica")},
only_a AS (SELECT *, row_number() OVER (PARTITION BY file, page_id ORDER BY digest) AS nth FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.file = a.file AND b.page_id IS NOT DISTINCT FROM a.page_id AND b.digest = a.digest)),
only_b AS (SELECT *, row_number() OVER (PARTITION BY file, page_id ORDER BY digest) AS nth FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.file = a.file AND b.page_id IS NOT DISTINCT FROM a.page_id AND b.digest = a.digest)),
d AS (SELECT a.file AS fa, a.page_id AS pa, a.e AS ea, a.size AS sa, a.copies AS ca, a.digest AS da, b.file AS fb, b.page_id AS pb, b.e AS eb, b.size AS sb, b.copies AS cb, b.digest AS db
    FROM only_a a FULL JOIN only_b b ON a.file = b.file AND a.page_id IS NOT DISTINCT FROM b.page_id AND a.nth = b.nth
  UNION ALL SELECT a.file, a.page_id, a.e, a.size, a.copies, a.digest, b.file, b.page_id, b.e, b.size, b.copies, b.digest
    FROM a JOIN b ON a.file = b.file AND a.page_id IS NOT DISTINCT FROM b.page_id AND a.digest = b.digest WHERE a.copies <> b.copies)
SELECT coalesce(fa, fb)::BIGINT AS file, coalesce(pa, pb) AS page_id, CASE WHEN db IS NULL THEN 'missing' WHEN da IS NULL THEN 'extra' WHEN da = db THEN 'copies' ELSE 'changed' END AS state,
  (ea - sa)::BIGINT AS begin_a, ea::BIGINT AS end_a, ca::BIGINT AS copies_a, da AS digest_a, (eb - sb)::BIGINT AS begin_b, eb::BIGINT AS end_b, cb::BIGINT AS copies_b, db AS digest_b FROM d"""
