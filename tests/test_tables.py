"""Files, caches, pipelines, quality figures and streams."""

import json

import pytest
from pyspark.sql import functions as F

from assertloom.operators import cache, quality, setops
from assertloom.operators.verification import check_pairs
from assertloom.plans import pipelines
from assertloom.services.models import Echo, health
from assertloom.sources import files
from assertloom.streaming import corpus as streaming
from assertloom.verify.engines import Bounded


def put(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


def test_datasets(spark, tmp_path):
    rows = [{"SVA": "a", "SVAD": "x"}, {"sva": "b"}, {"SVA": None, "sva": "c"}, {}]
    want = ["a", "b", None, None]
    for name, data in (("list.json", rows), ("dict.json", {"data": rows, "metadata": {"n": 1}})):
        got = files.read_dataset(spark, put(tmp_path / name, data)).orderBy("pos").collect()
        assert [r.SVA for r in got] == want
    assert files.entries_of(files.read_dataset(spark, str(tmp_path / "list.json"))).count() == 2
    with pytest.raises(Exception, match="neither a list"):
        files.read_dataset(spark, put(tmp_path / "bad.json", {"x": 1})).collect()


def test_round_trips(spark, tmp_path):
    df = files.read_dataset(spark, put(tmp_path / "d.json", [{"SVA": "é", "metadata": {"k": "v"}}, {"SVA": "b", "CoT": "c"}]))
    files.write_dataset(df, str(tmp_path / "out"), {"m": 1})
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ['{"SVA":"b","CoT":"c"}', '{"SVA":"é","metadata":{"k":"v"}}']
    files.export_json(df, str(tmp_path / "e.json"), {"m": 1})
    assert json.loads((tmp_path / "e.json").read_text()) == {"metadata": {"m": 1}, "data": [{"SVA": "é", "metadata": {"k": "v"}}, {"SVA": "b", "CoT": "c"}]}


def test_pairs_and_generated(spark, tmp_path):
    p = files.read_pairs(spark, put(tmp_path / "p.json", [{"id": "x", "sva1": "a", "sva2": "b"}, {"antecedent": "a", "consequent": "c"}, 3, {"sva1": "a"}])).collect()
    assert [tuple(r) for r in p] == [("x", "a", "b"), ("entry_1", "a", "c")]
    g = files.read_generated(spark, put(tmp_path / "g.json", {"properties": [{"name": "n", "sva": "a"}]})).first()
    assert (g.name, g.sva, g.translation) == ("n", "a", None)
    with pytest.raises(Exception, match="not a list"):
        files.read_pairs(spark, put(tmp_path / "q.json", {"a": 1})).collect()


def test_hdl_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    put(tmp_path / "a.sv", "property p;\n x;\nendproperty\nassert property (p);")
    put(tmp_path / "sub" / "b.sva", "cover property (q);")
    put(tmp_path / "c.txt", "assert property (z);")
    found = files.properties_of(files.read_hdl(spark, str(tmp_path))).collect()
    assert sorted((r["pass"], r.sva) for r in found) == [(0, "property p;\n x;\nendproperty"), (1, "assert property (p);"), (1, "cover property (q);")]
    assert files.read_hdl(spark, str(tmp_path), recursive=False).count() == 1


def test_merge_and_split(spark):
    a = spark.createDataFrame([(0, "x  y"), (1, ""), (2, None), (3, "z")], "pos int, SVA string")
    b = spark.createDataFrame([(0, " x y "), (1, "w")], "pos int, SVA string")
    assert sorted(r.SVA for r in setops.merge([a, b]).collect()) == ["w", "x  y", "z"]
    parts = setops.split(spark.range(100), "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"train": 80, "val": 10, "test": 10}
    assert setops.split(spark.range(0), "id").count() == 0
    assert setops.shuffled(spark.range(10), "id").count() == 10 and setops.hybrid(spark.range(1), spark.range(1)).count() == 2


def test_rates_and_empty_tables(spark):
    none = spark.createDataFrame([], "model_name string, relationship string, generation_time double, verification_time double")
    assert quality.model_metrics(none).count() == 0 and quality.model_comparison(quality.model_metrics(none)).count() == 0
    rows = [("b", "equivalent"), ("b", None), ("a", "equivalent"), ("a", "odd")]
    df = spark.createDataFrame(rows, "model_name string, relationship string").withColumns({"generation_time": F.lit(1.0), "verification_time": F.lit(None).cast("double")})
    m = {r.model_name: r for r in quality.model_metrics(df).collect()}
    assert (m["a"].equivalent_rate, m["a"].error_count, m["b"].error_count, m["b"].avg_verification_time) == (0.5, 1, 1, 0.0)
    assert quality.model_comparison(quality.model_metrics(df)).first().best_equivalent_model == "a"
    empty = spark.createDataFrame([], "SVA string, SVAD string, CoT string, metadata map<string,string>")
    assert tuple(quality.dataset_report(empty).first()) == (0, 0, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("b, c", [(0, 0), (3, 9), (10, 10), (0, 5), (1, 999)])
def test_sign_test(spark, b, c):
    from math import comb

    n, k = b + c, min(b, c)
    want = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)
    got = spark.range(1).select(quality._sign_test(F.lit(b).cast("long"), F.lit(c).cast("long")).alias("p")).first().p
    assert abs(got - want) < 2e-6


class Counting(Echo):
    pass


def test_a_second_run_calls_no_model(spark, tmp_path):
    lines = spark.createDataFrame([(0, "assert property (a);"), (1, ""), (2, None), (3, "assert property (a);")], "pos int, SVA string")
    store = str(tmp_path / "cache")
    first = pipelines.enrich(lines, Echo(), store=store).orderBy("pos").collect()
    assert [(r.pos, r.SVAD) for r in first] == [(0, "assert property (a);"), (3, "assert property (a);")] and "Step 5" in first[0].CoT
    assert cache.stats(cache.read(spark, store)).first().entries == 1

    class Broken(Echo):
        def generate(self, *a, **k):
            raise RuntimeError("no server")

    again = pipelines.enrich(lines, Broken(), store=store).orderBy("pos").collect()
    assert [(r.SVAD, r.metadata) for r in again] == [(r.SVAD, None) for r in first]
    other = pipelines.enrich(lines, Broken("other"), store=store).first()
    assert other.SVAD is None and other.metadata == {"svad_error": "RuntimeError: no server"}
    cache.clear(spark, store)
    assert cache.read(spark, store).count() == 0


@pytest.mark.parametrize("delay, other", [(9, 10), (10, 12), (19, 20)])
def test_late_consequents_are_told_apart(delay, other):
    for a, b in ((f"a |-> ##{delay} b", f"a |-> ##{other} c"), (f"a |-> ##{delay} b", f"a |-> ##{other} b"), (f"a |-> ##[1:{other}] b", f"a |-> ##[1:{delay}] b")):
        assert Bounded().check(a, b)[0] == "not_implies", (a, b)
    assert Bounded().check(f"a |-> ##[1:{delay}] b", f"a |-> ##[1:{other}] b")[0] == "implies"


def test_evaluate(spark):
    items = spark.createDataFrame([(0, "a |-> b", "a |-> b"), (1, "a |-> b && c", "a |-> b"), (2, "", "x"), (3, "a |-> b", None)], "item_idx int, SVAD string, SVA string")
    got = {r.item_idx: r.relationship for r in pipelines.evaluate(items, [Echo()]).collect()}
    assert got == {0: "equivalent", 1: "generated_implies_reference"}


def test_evaluate_asks_and_checks_alike_items_once(spark, tmp_path):
    class Logged(Echo):
        def generate(self, prompt, *a, **k):
            with open(tmp_path / "asked", "a") as f:
                f.write("x")
            return super().generate(prompt, *a, **k)

    same = [(i, "a |-> b", "a |-> b") for i in range(40)] + [(i, "a |-> b", "a |-> b || c") for i in range(40, 50)] + [(50, "a|b", "c"), (51, "a", "b|c"), (50, "a|b", "c")]  # the last ones share a cache key
    items = spark.createDataFrame(same, "item_idx int, SVAD string, SVA string")
    rows = pipelines.evaluate(items, [Logged("m1"), Logged("m2")])
    assert len(open(tmp_path / "asked").read()) == 6
    got = sorted((r.model_name, r.item_idx, r.reference_sva, r.relationship) for r in rows.collect())
    assert len(got) == 106 and [g[3] for g in got[:40]] == ["equivalent"] * 40 and [g[3] for g in got[40:50]] == ["generated_implies_reference"] * 10
    assert [g[1:3] for g in got[50:53]] == [(50, "c"), (50, "c"), (51, "b|c")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # replies were read before, once each, not for every item


def test_pairs_are_normalised_once_each(spark):
    rows = [(i, *p) for i, p in enumerate([("property p; a |-> b; endproperty", "a |-> b"), (None, "a"), ("a", None), (None, None), ("", "a"), ("a  |-> b", "a |-> b")] * 3)]
    got = {r.id: r for r in check_pairs(spark.createDataFrame(rows, "id int, sva1 string, sva2 string")).collect()}
    assert [got[i].result for i in range(18)] == ["equivalent", "error", "error", "error", "error", "equivalent"] * 3
    assert got[0].verification_time == got[5].verification_time == got[17].verification_time  # one check
    plan = check_pairs(spark.range(5).selectExpr("id", "concat('a', id) sva1", "concat('b', id) sva2"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("regexp_replace") < plan.rindex("Aggregate")  # patterns run on what differs, not on every row


def test_health():
    class Down(Echo):
        def generate(self, *a, **k):
            raise OSError("down")

    assert [x[:2] for x in health([Echo(), Down("d")])] == [("echo", True), ("d", False)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("2024-01-01T00:00:00", "a |-> b"), ("2024-01-01T00:10:00", " a  |->  b"), ("2024-01-01T01:10:00", "c ##1 d")]
    (src / "x.json").write_text("\n".join(json.dumps({"ts": t, "sva": s}) for t, s in rows))
    for name, make, mode in (("p", streaming.parsed, "append"), ("f", streaming.first_of_each, "append"), ("c", streaming.coverage, "complete")):
        q = make(streaming.read(spark, str(src))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("p").count() == 3 and spark.table("f").count() == 2
    assert {(r.construct, r.properties) for r in spark.table("c").collect()} >= {("|->", 2), ("##", 1)}
