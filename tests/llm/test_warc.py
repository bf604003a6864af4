"""WARC records, files and the Merkle audit."""

import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assertloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages(n=300, seed=0):
    r = random.Random(seed)
    return [(i, f"http://x/{i}", "<p>" + "é" * r.randrange(50) + "</p>") for i in range(n)]


def brute(a, b, per_file):
    """Records that differ, by plain comparison of both lists."""

    def lay(rows):
        files = {}
        for p, u, h in rows:
            body = (h or "").encode()
            head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'none' if p is None else p}>\r\nWARC-Date: {warc.DATE}\r\nWARC-Target-URI: {u or ''}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
            data = head.encode() + body + b"\r\n\r\n"
            files.setdefault(-1 if p is None else p // per_file, Counter())[p, hashlib.sha256(data).hexdigest(), len(data)] += 1
        out = {}
        for f, records in files.items():
            at = 0
            for (p, digest, n), copies in sorted(records.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1])):
                out.setdefault((f, p), {})[digest] = (at, at + n * copies, copies, digest)
                at += n * copies
        return out

    x, y, out = lay(a), lay(b), set()
    for k in set(x) | set(y):
        p, q = x.get(k, {}), y.get(k, {})
        for d in set(p) & set(q):
            if p[d][2] != q[d][2]:
                out.add((*k, "copies", *p[d], *q[d]))
        only = [sorted(set(m) - set(n)) for m, n in ((p, q), (q, p))]
        for i in range(max(map(len, only))):
            left = p[only[0][i]] if i < len(only[0]) else (None,) * 4
            right = q[only[1][i]] if i < len(only[1]) else (None,) * 4
            out.add((*k, "missing" if right[3] is None else "extra" if left[3] is None else "changed", *left, *right))
    return out


def damaged(a, change):
    b = list(a)
    if change in ("bytes", "all"):
        b[5], b[280] = (5, "http://y/5", b[5][2]), (280, "http://y/280", b[280][2])
    if change in ("longer", "all"):
        b[120] = (120, "http://x/120", "longer than before")
    if change in ("missing", "all"):
        b = b[:40] + b[41:]
    if change in ("extra", "all"):
        b.append((99, "new", "page"))
    if change in ("copies", "all"):
        b += [b[8]] * 3 + [(None, "u", "x")]
    return b


@pytest.mark.parametrize("fan, changes", [(2, ("all",)), (16, ("none", "longer", "missing", "copies", "all"))])
def test_audit_against_plain_comparison(spark, fan, changes):
    a = pages() + [(None, None, None), (None, "u", "x"), (7, "http://x/7", "again"), (8, "http://x/8", "<p></p>"), (8, "http://x/8", "<p></p>"), (-3, "m", "n")]
    for change in changes:
        b = damaged(a, change)
        df = [spark.createDataFrame(x, SCHEMA).withColumns({"digest": F.lit(1), "file": F.lit("f")}) for x in (a, b)]
        got = [tuple(r) for r in warc.fixity_audit(*df, per_file=100, fan=fan).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(a, b, 100), change


def test_a_shift_is_no_damage_and_leaves_other_branches_alone(spark):
    a = pages(64)
    b = [(i, u, h + "longer" if i == 3 else h) for i, u, h in a if i != 20]
    placed = [warc.records(spark.createDataFrame(x, SCHEMA), per_file=64) for x in (a, b)]
    low = [{r.node: r.digest for r in warc.tree(p, 64, 4)[1].collect()} for p in placed]
    assert {n for n in low[0] if low[0][n] != low[1][n]} == {0, 5}
    assert {(r.page_id, r.state) for r in warc.fixity_audit(*[spark.createDataFrame(x, SCHEMA) for x in (a, b)], 64, 4).collect()} == {(3, "changed"), (20, "missing")}


def test_ids_of_text_and_crowded_ids(spark):
    """Text ids, and one id, or no id, that has most rows: the same records are named."""
    a = [(f"p{i}", "u", f"text {i}") for i in range(80)] + [(None, "u", f"null {i}") for i in range(120)] + [("hot", "u", f"hot {i}") for i in range(150)] + [("copied", "u", "same")] * 90
    b = [x for i, x in enumerate(a) if i not in (3, 100, 250)] + [("hot", "u", "new"), ("q", "v", "w"), ("copied", "u", "same")]
    schema = "page_id string, url string, html string"
    got = warc.fixity_audit(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), per_file=10, fan=4).collect()
    assert sorted((r.page_id or "", r.state) for r in got) == [("", "missing"), ("copied", "copies"), ("hot", "extra"), ("hot", "missing"), ("p3", "missing"), ("q", "extra")]
    parts = warc.records(spark.createDataFrame(a, schema), per_file=10).groupBy("file", "part").count().collect()
    assert max(r["count"] for r in parts) <= 60
    with pytest.raises(ValueError):
        warc.fixity_audit(spark.createDataFrame(a, schema), spark.createDataFrame(pages(3), SCHEMA))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.fixity_audit(none, none).count() == 0
    assert [r.state for r in warc.fixity_audit(spark.createDataFrame(pages(1), SCHEMA), none).collect()] == ["missing"]


def test_query(agree, spark, sf):
    agree(warc.query, warc.ORACLE)
    assert {r.state for r in warc.query(spark, sf.replace("sf0.001", "sf0.01")).collect()} == {"changed", "missing", "extra"}


def test_query_against_plain_comparison(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    want = brute([tuple(r) for r in table.collect()], [tuple(r) for r in warc.faulty(table).collect()], warc.PER_FILE)
    assert {tuple(r) for r in warc.query(spark, sf).collect()} == want and want


def test_files_come_back(spark, tmp_path):
    rows = pages(50) + [(51, None, None), (52, "u\r\nv", "x\r\n\r\nWARC/1.1 y")]
    out = warc.write_warc(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}", per_file=20).collect()
    assert sum(r.n_records for r in out) == 52 and len(out) == 3
    got = {r.record_id: (r.url, bytes(r.content).decode()) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got["<urn:page:3>"] == ("http://x/3", rows[3][2]) and got["<urn:page:52>"] == ("u v", "x\r\n\r\nWARC/1.1 y") and len(got) == 52


def test_damaged_files(spark, tmp_path):
    cut = lambda data: [(at, h and h.get("content-length"), body) for at, h, body in warc.parse(data)]
    assert cut(b"") == [] and cut(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort") == [(0, None, b"")]
    assert cut(b"WARC/1.1\r\nContent-Length: x\r\n\r\n") == []
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for step in (1, 7, 1000):
        parts = (bytes(2 * good + b"WARC/1")[i : i + step] for i in range(0, 2 * len(good) + 6, step))
        assert cut(parts) == [(0, "3", b"abc"), (len(good), "3", b"abc"), (2 * len(good), None, b"")]
    member = gzip.compress(good, mtime=0)
    big = gzip.compress(b"WARC/1.1\r\nContent-Length: 3000000\r\n\r\n" + bytes(3_000_000), mtime=0)
    files = {"a.warc.gz": member * 3, "b.warc.gz": member + member[:-6], "c.warc.gz": member + b"junk", "d.warc": good * 2, "e.warc.gz": b"", "f.warc.gz": member + big + b"\0\0", "g.warc.gz": member[:9]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    by = {n: sorted((r.begin, r.type, r.content and len(r.content)) for r in rows if r.path.endswith(n)) for n in files}
    n = len(good)
    assert by["a.warc.gz"] == [(0, None, 3), (n, None, 3), (2 * n, None, 3)] and by["d.warc"] == [(0, None, 3), (n, None, 3)] and by["e.warc.gz"] == []
    assert by["b.warc.gz"][:1] == [(0, None, 3)] and by["b.warc.gz"][-1][1] == "damaged"
    assert [x[1] for x in by["c.warc.gz"]] == [None, "damaged"] and [x[1] for x in by["g.warc.gz"]] == ["damaged"]
    assert [x[2] for x in by["f.warc.gz"]] == [3, 3_000_000]
