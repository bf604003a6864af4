"""The pipeline's stages against brute force, each on the rows that its predecessor kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from assertloom.llm import catalogue, packing, quality_gam, quality_rules
from tests.llm.test_ngram_join import brute as near_pairs
from tests.llm.test_packing import simulate
from tests.llm.test_substring import brute as repeated


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in catalogue.queries()
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in catalogue.queries() if n.startswith("op")}


def test_run_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}

    # 1: the table of scores decides
    keep = {r.doc_id for r in quality_gam.quality_classifier(docs, labels).collect() if r.keep}
    one = spark.createDataFrame([rows[i] for i in sorted(keep)], docs.schema)
    got = corpus_pipeline.classify(spark, docs, sf)
    assert got.columns == columns and {r.doc_id for r in got.collect()} == keep

    # 2: the rules, word by word
    def fails(text):
        words, lines = text.split(), [x for x in text.split("\n") if x]
        n = max(1, len(words))
        m = {
            "words": len(words), "mean_word_chars": sum(map(len, words)) / n, "symbol_ratio": sum(c in quality_rules.SYMBOLS for c in text) / max(1, len(text)),
            "stop_word_ratio": sum(w.lower() in quality_rules.STOP_WORDS for w in words) / n, "distinct_word_ratio": len(set(words)) / n,
            "capital_word_ratio": sum(w.upper() == w and w.lower() != w for w in words) / n, "repeated_line_ratio": 1 - len(set(lines)) / max(1, len(lines)),
        }
        return any((r.low is not None and m[r.metric] < r.low or r.high is not None and m[r.metric] > r.high) and len(words) >= r.min_words for r in quality_rules.RULES)

    passed = sorted(i for i in keep if not fails(rows[i].text or ""))
    two = corpus_pipeline.rules(spark, one, sf)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == passed

    # 3: one document of each group
    root = {i: i for i in passed}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b, _ in near_pairs([(i, rows[i].text) for i in passed]):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    left = [i for i in passed if find(i) == i]
    three = corpus_pipeline.near_duplicates(spark, two, sf)
    assert three.columns == columns and sorted(r.doc_id for r in three.collect()) == left

    # 4: passages once
    hashes = {r.doc_id: r.h for r in three.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    want = {k[0]: v for k, v in repeated([(i, hashes[i], rows[i].text) for i in left], 50).items()}
    four = corpus_pipeline.repeated_passages(spark, three, sf)
    assert four.columns == columns
    got = {r.doc_id: r for r in four.collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(r.n_chars == len(r.text) for i, r in got.items() if want[i][1])

    # 5: all of every text in sequences as full as best-fit makes them
    texts = {i: t for i, (t, _) in want.items() if t.split()}
    out = corpus_pipeline.run(spark, sf).collect()
    size = packing.CAPACITY
    lengths = [min(size, len(t.split()) - at) for t in texts.values() for at in range(0, len(t.split()), size)]
    assert sorted(size - r.n_tokens for r in out) == simulate(lengths, size)
    back = {}
    for r in out:
        for d, p, t in zip(r.doc_ids, r.pieces, r.texts):
            back.setdefault(d, {})[p] = t
    assert {d: "".join(x[p] for p in sorted(x)) for d, x in back.items()} == texts


def test_odd_rows_pass_through_every_stage(spark, sf, tmp_path):
    """Nulls, empty, blank and very long texts, repeated rows, extra columns with clashing names, and no rows at all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(f"the word{i % 977} of {i}" for i in range(60_000)) + "."
    odd = [(None, "a b", "en", "s", 3), (9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, " \n", "en", "s", 2), (9003, long, "en", "s", len(long)), (9004, long, "en", "s", len(long)), (9005, "same text", "en", "s", 9), (9005, "same text", "en", "s", 9)]
    clash = {"words": F.lit("x"), "_d": F.lit(1), "fp": F.lit("f"), "part": F.lit(2), "n_removed": F.lit("n"), "_p": F.lit(0)}
    for name, table in (("odd", docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns(clash)), ("none", docs.limit(0).withColumns(clash))):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        if name == "none":
            assert out == []
        else:
            packed = [d for r in out for d in r.doc_ids]
            assert 9003 in packed and not {9000, 9001, 9002, 9004} & set(packed)
            assert sum(r.n_tokens for r in out if 9003 in r.doc_ids) > 0


def test_near_duplicates_keep_what_has_no_group(spark, sf):
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "  "), (4, "x y z"), (4, "x y z"), (5, "x y z")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame(rows[:-1], "doc_id long, text string").collect()))
