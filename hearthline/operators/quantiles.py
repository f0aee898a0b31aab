"""Exact quantiles without a buffer of the column: brackets around the wanted ranks
are narrowed until one value is left.

A pass counts the values of each bracket in BINS bins of equal width and keeps their
least and greatest value; the bin that holds the rank is the next bracket. Bins are in
the order of their values, so ranks stay exact, and all that leaves the executors are
counts: BINS rows for each quantile, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024


def _ranks(n: int, share: float) -> tuple[int, int, float]:
    """The two places, from 0, that a quantile lies between, and how far it is from the first."""
    at = (n - 1) * share
    return math.floor(at), math.ceil(at), at - math.floor(at)


def _narrowed(rows: DataFrame, wanted: dict[tuple[str, int], tuple[float, float, int]]) -> dict[tuple[str, int], tuple[float, float, int]]:
    """Of each feature and rank the next bracket: its least and greatest value, and how many values lie below it."""
    spark = rows.sparkSession
    brackets = spark.createDataFrame([(f, r, lo, hi) for (f, r), (lo, hi, _) in wanted.items()], "feature string, rank long, lo double, hi double")
    near = rows.join(F.broadcast(brackets), "feature").where("x between lo and hi")  # a row for each quantile that is sought
    place = F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)
    counted = near.groupBy("feature", "rank", F.least(place, F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    out, below = {}, {key: b for key, (_, _, b) in wanted.items()}
    for r in sorted(counted.collect(), key=lambda r: r["bin"]):
        key = r["feature"], r["rank"]
        if key not in out:
            if below[key] + r["n"] > r["rank"]:
                out[key] = r["lo"], r["hi"], below[key]
            below[key] += r["n"]
    return out


def exact_quantiles(rows: DataFrame, shares: Sequence[float]) -> dict[str, list[float]]:
    """rows: feature and x. Of each feature the quantiles of its values that are not null, with
    linear interpolation between two ranks; features without values are left out."""
    known = rows.where("x is not null").select("feature", "x")
    edges = {r["feature"]: r for r in known.groupBy("feature").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    brackets = {(f, rank): (r["lo"], r["hi"], 0) for f, r in edges.items() for s in shares for rank in _ranks(r["n"], s)[:2]}
    while wide := {key: b for key, b in brackets.items() if b[0] < b[1]}:
        brackets |= _narrowed(known, wide)
    out = {}
    for f, r in edges.items():
        ranks = [_ranks(r["n"], s) for s in shares]
        out[f] = [(1 - part) * brackets[f, low][0] + part * brackets[f, high][0] for low, high, part in ranks]
    return out
