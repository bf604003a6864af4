"""Implication and equivalence of pairs of assertions as tables."""

from __future__ import annotations

from collections.abc import Iterator
from time import perf_counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertloom.functions.text import clock_spec, normalized
from assertloom.operators.quality import relationship
from assertloom.session import spread
from assertloom.verify.engines import Bounded, Engine

_OUT = "forward string, forward_message string, forward_trace string, backward string, backward_message string, backward_trace string, verification_time double"
_KEY = ["_a", "_b", "_ca", "_cb"]


def check_pairs(pairs: DataFrame, engine: Engine = Bounded(), left: str = "sva1", right: str = "sva2") -> DataFrame:
    """pairs with forward, backward (results of either direction, with messages and counterexamples), result, relationship and the
    seconds that both directions took (verification_time).

    Each different pair of texts is normalised once, and each different pair of normalised expressions and clocks checked once, wherever
    there is room. A null or blank side gives `error`.
    Where the clocks differ in edge or signal, each direction runs on its antecedent's. An engine's failure is a result, never a failed job.
    """
    names = pairs.columns
    base = pairs.select(*[F.col(f"`{n}`").alias(f"_{i}_") for i, n in enumerate(names)])
    texts = base.select(F.col(f"_{names.index(left)}_").alias("_l"), F.col(f"_{names.index(right)}_").alias("_r"))
    texts = spread(texts.distinct())  # without a step between them, the optimizer would merge this distinct into the next one
    for c, side in (("a", F.col("_l")), ("b", F.col("_r"))):
        text = F.coalesce(side, F.lit(""))
        texts = texts.withColumns({f"_{c}": F.coalesce(normalized(side), F.lit("")), f"_c{c}": F.concat_ws(" ", clock_spec(text)["edge"], clock_spec(text)["clock"])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x, y, cx, cy in zip(pdf["_a"], pdf["_b"], pdf["_ca"], pdf["_cb"]):
                out, start = [], perf_counter()
                for p, q, at in ((x, y, cx), (y, x, cy)):
                    if not p or not q:
                        out += ["error", "a side is missing", None]
                        continue
                    try:
                        out += engine.check(p, q, at.split(" ")[1], at.split(" ")[0])
                    except Exception as e:  # an engine's trouble belongs to its row
                        out += ["error", f"{type(e).__name__}: {e}", None]
                rows.append((x, y, cx, cy, *out, perf_counter() - start))
            yield pd.DataFrame(rows, columns=[*_KEY, *[c.split()[0] for c in _OUT.split(", ")]])

    done = spread(texts.select(*_KEY).distinct()).mapInPandas(run, f"_a string, _b string, _ca string, _cb string, {_OUT}")
    told = texts.join(done, _KEY).drop(*_KEY)
    out = base.join(told, F.col(f"_{names.index(left)}_").eqNullSafe(F.col("_l")) & F.col(f"_{names.index(right)}_").eqNullSafe(F.col("_r")))
    fwd, back = F.col("forward"), F.col("backward")
    bad = F.when(fwd.isin("implies", "not_implies"), F.when(back.isin("implies", "not_implies"), F.lit(None)).otherwise(back)).otherwise(fwd)
    result = F.when(bad.isNotNull(), bad).when((fwd == "implies") & (back == "implies"), "equivalent").otherwise("not_implies")
    return out.select(
        *[F.col(f"_{i}_").alias(n) for i, n in enumerate(names)],
        fwd,
        back,
        result.alias("result"),
        relationship(fwd == "implies", back == "implies", bad).alias("relationship"),
        "forward_message",
        "backward_message",
        "forward_trace",
        "backward_trace",
        "verification_time",
    )
