"""Best-fit packing against a document-by-document simulation."""

import random

from pyspark.sql import functions as F

from assertloom.llm import packing


def simulate(sizes, capacity):
    """Best-fit decreasing, one document after the other: the rooms left."""
    rooms = []
    for n in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_fills_as_the_simulation_does():
    for seed in range(60):
        r = random.Random(seed)
        capacity = r.choice([5, 16, 64])
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 150))]
        histogram = {n: sizes.count(n) for n in set(sizes)}
        slots, bins = packing.plan(histogram, capacity)
        assert sum(s[2] for s in slots) == len(sizes)
        fill, taken = {}, set()
        for length, first, n, per, bin_, off in slots:
            for k in range(n):
                at = (bin_ + k // per, off + k % per * length)
                fill[at[0]] = fill.get(at[0], 0) + length
                cells = {(at[0], c) for c in range(at[1], at[1] + length)}
                assert not cells & taken
                taken |= cells
        assert bins == len(fill) and sorted(capacity - x for x in fill.values()) == simulate(sizes, capacity)


def test_documents_come_back_whole(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab \n\t") for _ in range(r.choice([0, 3, 40, 400])))) for i in range(300)]
    rows += [(None, "x y"), (None, "x y"), (7, None), (5, "q"), (5, "q"), (9, " \n"), (10, ""), (11, "w " * 1000), (12, "lone")]
    for part_rows in (3, 4000):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "part": F.lit(1), "seq_id": F.lit(2)})
        out = packing.best_fit_packing(df, capacity=32, part_rows=part_rows).collect()
        assert sorted(o.seq_id for o in out) == list(range(len(out)))
        got = {}
        for o in out:
            assert o.n_tokens == sum(o.lengths) <= 32 and all(len(t.split()) == n for t, n in zip(o.texts, o.lengths))
            for d, p, t in zip(o.doc_ids, o.pieces, o.texts):
                got.setdefault((d, p), []).append(t)
        want = sorted((d if d is not None else -1, t) for d, t in rows if t and t.split())
        whole = []
        for d in {k[0] for k in got}:
            copies = len(got[(d, 0)])
            if copies == 1:
                whole.append((d if d is not None else -1, "".join(got[(d, p)][0] for p in range(len([k for k in got if k[0] == d])))))
            else:
                whole += [(d if d is not None else -1, t) for t in got[(d, 0)]]
        many = {d for d, _ in want if sum(x == d for x, _ in want) > 1}
        assert sorted(x for x in whole if x[0] not in many) == [x for x in want if x[0] not in many]
        sizes = [min(32, n - p * 32) for n in (len(t.split()) for _, t in rows if t) for p in range(-(-n // 32))]
        assert sorted(32 - o.n_tokens for o in out) == simulate(sizes, 32)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.best_fit_packing(df).count() == 0
