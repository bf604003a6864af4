"""The commands, each once."""

import json

import pytest

from assertloom import cli


def lines(capsys, spark, *argv):
    capsys.readouterr()
    assert cli.main(list(argv), spark) == 0
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    for name, data in {
        "data.json": [{"SVA": "a |-> b", "SVAD": "a |-> b"}, {"SVA": "a |-> b", "SVAD": "a |-> b || c"}],
        "pairs.json": [{"id": "p", "sva1": "a |-> b", "sva2": "a |-> b"}, {"sva1": "a"}],
        "gen.json": {"properties": [{"name": "n", "sva": "a ##1 b"}, {"name": "m", "sva": "a ("}]},
    }.items():
        (d / name).write_text(json.dumps(data))
    (d / "f.sv").write_text("property p; a; endproperty\nassert property (p);")
    return d


CASES = [
    ("ast parse CODE", lambda r: r[0]["parsed"]["antecedent"] == "a"), ("ast signals CODE", lambda r: [x["name"] for x in r] == ["a", "b"]), ("ast parse-file f.sv", lambda r: len(r) == 2),
    ("implication check CODE CODE", lambda r: r[0]["forward"] == "implies"), ("implication equivalent CODE CODE", lambda r: r[0]["result"] == "equivalent"),
    ("implication relationship CODE CODE", lambda r: r == [{"relationship": "equivalent"}]), ("implication batch-equivalent pairs.json", lambda r: len(r) == 1 and r[0]["result"] == "equivalent"),
    ("implication cross-validate pairs.json", lambda r: r[0]["result_a"] == "equivalent"), ("cot build CODE", lambda r: "Step 5" in r[0]["cot"]), ("cot build-file f.sv", lambda r: len(r) == 2),
    ("cot sections CODE", lambda r: len(r) == 6), ("dataset build data.json", lambda r: len(r) == 2 and r[0]["SVAD"]), ("dataset build-cot-only data.json", lambda r: "SVAD" not in r[0] and r[0]["CoT"]),
    ("dataset generate-svad CODE", lambda r: r[0]["SVAD"] == "a |-> b"), ("dataset generate-cot CODE", lambda r: "CoT" in r[0]), ("dataset validate data.json", lambda r: r[0]["with_svad"] == 2),
    ("benchmark run data.json", lambda r: [x["relationship"] for x in sorted(r, key=lambda x: x["item_idx"])] == ["equivalent", "reference_implies_generated"]),
    ("benchmark run-multi data.json", lambda r: r[0]["equivalent_rate"] == 0.5), ("benchmark stats data.json", lambda r: r[0]["has_both"] == 2), ("gen generate --number 3", lambda r: len(r) == 3),
    ("gen generate --mode stratified --samples 1", lambda r: len(r) == 47), ("gen validate CODE", lambda r: r == [{"is_valid": True}]), ("gen validate-file gen.json", lambda r: [x["is_valid"] for x in r] == [True, False]),
    ("gen stress-test --number 20", lambda r: r[0]["batches"] == 2), ("gen list-presets", lambda r: len(r) == 4), ("gen coverage gen.json", lambda r: len(r) == 48), ("gen coverage gen.json --top-n 1", lambda r: len(r) == 7),
    ("describe translate gen.json", lambda r: "Evaluate the property: a ##1 b" in r[0]["translation"]), ("dataset clear-cache none", lambda r: r[0]["entries"] == 0),
]


@pytest.mark.parametrize("line, ok", CASES, ids=[c[0] for c in CASES])
def test_command(capsys, spark, paths, line, ok):
    argv = ["a |-> b" if w == "CODE" else str(paths / w) if "." in w or w == "none" else w for w in line.split()]
    assert ok(lines(capsys, spark, *argv))


def test_out_writes_a_table(spark, tmp_path):
    cli.main(["gen", "list-presets", "--out", str(tmp_path / "o")], spark)
    assert spark.read.json(str(tmp_path / "o")).count() == 4
