"""Trees and forests next to a plain loop in numpy over the same samples."""

import math

import numpy as np
from pyspark.sql import functions as F

from hearthline.operators import learning, trees

FEATURES = ["a", "b", "c"]


def rows_of(spark, n, same=0.0):
    """Ties, nulls, repeated values; a part of the rows has the same features."""
    i = F.col("id")
    a = F.when(F.col("id") % 100 < 100 * same, 3.0).otherwise(i * 37 % 41)
    return spark.range(n).select("id", a.alias("a"), F.when(i % 17 != 0, i * 13 % 7 / 3).alias("b"), F.lit(1.5).alias("c"), (100 + i * 37 % 41 * 5 + i * 13 % 7 + i * i % 11 / 10).alias("y"))


def chosen(tree, node, size, tried):
    h = [((tree * 1000003 + node) * 1009 + f) % 1048573 * 2654435761 % 4294967296 for f in range(size)]
    return sorted(range(size), key=lambda f: (h[f], f))[:tried]


def grown(x, y, tree, depth, leaf, tried):
    """node: (n, value, feature, threshold)"""
    out, todo = {}, [(1, np.arange(len(y)), 0)]
    while todo:
        node, at, level = todo.pop()
        best = None
        if level < depth and len(at) > 2 * leaf and y[at].min() < y[at].max():
            total = ((y[at] - y[at].mean()) ** 2).sum()
            for f in sorted(chosen(tree, node, x.shape[1], tried)):
                v = x[at, f]
                for t in np.unique(np.quantile(v[~np.isnan(v)], np.linspace(0.1, 0.9, 12))) if (~np.isnan(v)).any() else []:
                    left = v <= t
                    if min(left.sum(), (~left).sum()) >= leaf:
                        error = round(sum(((y[at][m] - y[at][m].mean()) ** 2).sum() for m in (left, ~left)) / total, 9)
                        if best is None or error < best[0]:
                            best = error, f, t, left
        out[node] = (len(at), y[at].mean(), best and best[1], best and best[2])
        if best:
            todo += [(2 * node, at[best[3]], level + 1), (2 * node + 1, at[~best[3]], level + 1)]
    return out


def walked(tree, x):
    node = 1
    while tree[node][2] is not None:
        node = 2 * node + (not x[tree[node][2]] <= tree[node][3])
    return tree[node][1]


def arrays(rows):
    x = np.array([[math.nan if r["xs"][i] is None else r["xs"][i] for i in range(3)] for r in rows])
    return x, np.array([r["y"] for r in rows])


def same_nodes(model, samples, depth, leaf, tried):
    got = {(r["tree"], r["node"]): r for r in model.collect()}
    expected = {(t, node): v for t, (x, y) in samples.items() for node, v in grown(x, y, t, depth, leaf, tried).items()}
    assert set(got) == set(expected)
    for k, (n, value, feature, threshold) in expected.items():
        assert (got[k]["n"], got[k]["feature"]) == (n, feature) and abs(got[k]["value"] - value) < 1e-9
        assert threshold is None or abs(got[k]["threshold"] - threshold) < 1e-9


def test_tree(spark):
    for n, same, leaf, tried in ((600, 0.0, 5, 3), (500, 0.9, 12, 2), (9, 0.0, 5, 3)):
        rows = rows_of(spark, n, same)
        sample = {0: arrays(trees.bagged(rows, FEATURES, "y", "id", range(1), False).collect())}
        same_nodes(trees.grow_trees(rows, FEATURES, "y", "id", depth=3, leaf=leaf, tried=tried, bootstrap=False), sample, 3, leaf, tried)


def test_no_rows_and_one_value(spark):
    none = rows_of(spark, 0)
    assert trees.grow_trees(none, FEATURES, "y", "id").count() == 0
    flat = rows_of(spark, 50).withColumn("y", F.when(F.col("id") > 3, 7.0))
    only = trees.grow_trees(flat, FEATURES, "y", "id", bootstrap=False).collect()
    assert [(r["n"], r["value"], r["feature"]) for r in only] == [(46, 7.0, None)]


def test_forest(spark):
    rows = rows_of(spark, 400)
    train, held = rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")
    model, errors = trees.grow_forest(train, held, FEATURES, "y", "id", trees=6, step=2, patience=2, least=0.0, depth=3, leaf=4, tried=2)
    logs = train.withColumn("_log", F.log1p("y"))
    bag = trees.bagged(logs, FEATURES, "_log", "id", range(6), True).collect()
    samples = {t: arrays([r for r in bag if r["tree"] == t]) for t in range(6)}
    assert 0.8 < sum(len(y) for _, y in samples.values()) / (6 * 320) < 1.2
    assert len({len(y) for _, y in samples.values()}) > 1
    forest = [grown(x, y, t, 3, 4, 2) for t, (x, y) in samples.items()]
    asked = held.orderBy("id").collect()
    says = np.array([[walked(t, [math.nan if r[c] is None else r[c] for c in FEATURES]) for t in forest] for r in asked])
    y = np.array([r["y"] for r in asked])
    expected = [(n, (np.abs(y - np.expm1(says[:, :n].mean(1))) / np.maximum(y, 1)).mean()) for n in (2, 4, 6)]
    assert [n for n, _ in errors] == [n for n, _ in expected][: len(errors)]
    assert np.allclose([e for _, e in errors], [e for _, e in expected][: len(errors)])
    kept = learning.stop_early(errors, 2, 0.0)
    same_nodes(model, {t: s for t, s in samples.items() if t < kept}, 3, 4, 2)
    _, again = trees.grow_forest(train, held.withColumn("id", F.lit(1)), FEATURES, "y", "id", trees=2, step=2, depth=3, leaf=4, tried=2)
    assert abs(again[0][1] - errors[0][1]) < 1e-9  # held rows of one key are rows still
    assert trees.grow_forest(train, held.limit(0), FEATURES, "y", "id", trees=2, step=2, depth=1)[1] == []


def test_rows_of_the_same_features_are_met_once(spark, monkeypatch):
    """After the first pass, the work follows the number of different features, not of rows."""
    sizes, real = {}, trees.staged

    def noted(df, name):
        rows = real(df, name)
        sizes.setdefault(name, []).append(rows.count())
        return rows

    monkeypatch.setattr(trees, "staged", noted)
    rows = rows_of(spark, 6000)
    model = trees.grow_trees(rows, FEATURES, "y", "id", trees=2, depth=2, leaf=12, tried=2)
    bag = trees.bagged(rows, FEATURES, "y", "id", range(2), True).collect()
    same_nodes(model, {t: arrays([r for r in bag if r["tree"] == t]) for t in range(2)}, 2, 12, 2)
    assert max(sizes["bag"]) <= 2 * 41 * 8 and max(sizes["values"]) <= 4 * (41 + 8)  # 41 values of a, 7 of b or none


def test_classes_keep_small_deviations(spark):
    """Labels that differ little next to what they are, and one far from all others."""
    rows = rows_of(spark, 900).withColumn("y", F.when(F.col("id") == 7, 1e9).otherwise(1e6 + F.col("y") / 1e3))
    one = {r["xs"][0]: r for r in trees.classes(trees.bagged(rows, ["a"], "y", "id", range(1), False), 1).collect()}
    told = {}
    for r in rows.collect():
        told.setdefault(float(r["a"]), []).append(r["y"])
    assert set(one) == set(told)
    for x, y in told.items():
        assert (one[x]["n"], one[x]["lo"], one[x]["hi"]) == (len(y), min(y), max(y))
        assert math.isclose(one[x]["q"], ((np.array(y) - np.mean(y)) ** 2).sum(), rel_tol=1e-6)


def test_many_values_and_classes(spark, monkeypatch):
    """Values are ranked in ranges and tables joined by shuffles, with the same trees and errors."""
    rows = rows_of(spark, 400)
    train, held = rows.where("id % 5 <> 0"), rows.where("id % 5 = 0").withColumn("a", F.when(F.col("id") % 15 == 0, -0.0).otherwise(F.col("a")))

    def found():
        model, errors = trees.grow_forest(train, held, FEATURES, "y", "id", trees=2, step=2, depth=2, leaf=4, tried=2)
        return sorted(model.select("tree", "node", "n", "feature", F.round("threshold", 9), F.round("value", 9)).collect(), key=lambda r: r[:2]), errors

    few, errors = found()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few values are in one range
    for name, most in (("RANGE_ROWS", 20), ("MOST_SENT", 0), ("MOST_VALUES", 0)):
        monkeypatch.setattr(trees, name, most)
    try:
        many, again = found()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert few == many and len(few) > 4 and np.allclose([e for _, e in errors], [e for _, e in again])
