"""Places within strata where one stratum holds nearly all rows, and the search over folds."""

import itertools

import pytest
from pyspark.sql import functions as F

from hearthline.operators import learning
from hearthline.plans import training


def strata(spark, n):
    name = F.when(F.col("id") % 10 != 0, "large").when(F.col("id") % 20 == 0, F.concat(F.lit("s"), F.col("id") % 7)).when(F.col("id") % 70 == 10, "rare")
    return spark.range(-20, n - 20).select((F.col("id") * 3).alias("id"), name.alias("stratum"))


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["stratum"], []).append(r["id"])
    rest = lambda a: a * 2654435761 % 4294967296 if a >= 0 else -(-a * 2654435761 % 4294967296)
    return {i: (k + 1, len(g)) for g in groups.values() for k, i in enumerate(sorted(g, key=lambda i: (rest(i), i)))}


@pytest.mark.parametrize("size", [200_000, 50])
def test_places_in_strata(spark, monkeypatch, size):
    monkeypatch.setattr(learning, "RANGE_ROWS", size)
    rows = strata(spark, 4000)
    want = brute(rows.collect())
    got = learning.with_places(rows, "id", "stratum")
    assert got.columns == ["id", "stratum", "place", "n"]
    assert {r["id"]: (r["place"], r["n"]) for r in got.collect()} == want
    folds = {r["id"]: r["fold"] for r in learning.stratified_folds(rows, "id", "stratum", 4).collect()}
    assert folds == {i: (p - 1) % 4 for i, (p, _) in want.items()}
    parts = {r["id"]: r["part"] for r in learning.three_way_split(rows, "id", "stratum").collect()}
    for i, (p, n) in want.items():
        first, second = max(1, round(n * 0.7)), max(1, round(n * 0.15))
        first, second = (n - 2, 1) if first + second >= n else (first, second)
        assert parts[i] == ("train" if n < 3 or p <= first else "validation" if p <= first + second else "test")


def test_no_task_ranks_a_large_stratum(spark, monkeypatch):
    """Nine tenths of the rows in one stratum: every range that a window sorts is small."""
    monkeypatch.setattr(learning, "RANGE_ROWS", 500)
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 != 0, "large").otherwise("small").alias("stratum"))
    hashed, _ = learning.hash_order(F.col("id"))
    ranges = 2 * -(-20_000 // 500)
    sizes = rows.groupBy("stratum", F.expr("id * 2654435761 % 4294967296 + 4294967296").alias("h")).count().groupBy("stratum", F.expr(f"h * {ranges} div 8589934592").alias("r")).agg(F.sum("count").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] < 2 * 500
    plan = learning.with_places(rows, "id", "stratum")._jdf.queryExecution().optimizedPlan().toString()
    ranking = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert len(ranking) == 1 and "_range" in ranking[0].split("windowspecdefinition(")[1]
    assert learning.with_places(rows, "id", "stratum").count() == 20_000


def test_grids_are_the_fixed_ones():
    assert training.NEIGHBOURS == (2, 3, 4, 5, 7, 9, 12, 15, 25)
    assert (training.DEPTHS, training.LEAVES, training.TRIED) == ((8, 11, 14, 18, 0), (2, 4, 8, 16), (6, 8, 12, 16))
    assert (training.FOLDS, training.PATIENCE, training.MOST_TREES, learning.LEAST_GAIN, learning.WAIT) == (4, 10, 90, 0.002, 3)
    assert len(list(itertools.product(training.DEPTHS, training.LEAVES, training.TRIED))) == 80


def test_search_runs_over_folds_and_ends_early(spark, monkeypatch):
    """Errors made up for each configuration and fold: the mean over folds decides, gains
    under 0.002 don't count as such, patience ends the search, folds are held out once each."""
    asked = []
    errors = {2: 0.5, 3: 0.4, 4: 0.399, 5: 0.39, 6: 0.3895, 7: 0.3890, 8: 0.1}  # by depth

    def fit(rows, names, label, trees, depth, leaf, seed, tried):
        asked.append((depth, leaf, tried, seed, rows.count()))
        return depth, seed

    def prefixes(model, held, names, label):
        depth, seed = model
        base = errors[depth] + (seed - 44.5) / 100
        return spark.createDataFrame([(10, base + 0.1), (20, base), (30, base + 0.001), (40, base + 0.5), (50, base - 0.001)], "trees int, mape double")

    monkeypatch.setattr(learning, "fit_forest", fit)
    monkeypatch.setattr(learning, "prefix_errors", prefixes)
    rows = spark.range(40).select("id", F.col("id").cast("double").alias("y"), F.lit("s").alias("stratum"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    best = training.search_forest(rows, 2, depths=(2, 3, 4, 5, 6, 7, 8), leaves=(2,), tried=(6,), patience=2)
    assert [a[0] for a in asked[::4]] == [2, 3, 4, 5, 6, 7]  # 8 would be best, but patience ran out
    assert {a[3] for a in asked} == {43, 44, 45, 46} and all(a[4] == 30 for a in asked)
    assert best == {"mape": 0.389, "depth": 7, "leaf": 2, "tried": 6, "trees": 20}
