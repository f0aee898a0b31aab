"""Regression trees by quantile thresholds, and forests of them, grown level by level.

A tree's sample is summed up once in classes of rows with the same features: their number,
mean label and squared deviations from it. All nodes of a level, of all trees that
grow together, are split by the same few aggregations of classes. A node chooses from some features (by a hash of tree, node and feature); its
thresholds are SHARES quantiles of the node's own values, interpolated between two
ranks. Values are counted before they are ranked, and ranked in ranges where they are many, so no
task holds a node or a feature, however many rows it has. The split with the least
squared error wins, as a share of the node's own and to nine digits, so that
the order of additions doesn't decide; then the lower feature, then the lower threshold.

Rows without a label are left out. Rows of the same key are drawn equally often. A row without a value goes right. Repeated rows count each.
No rows give no nodes. Nodes are numbered 1 for the root, and 2i and 2i + 1 for the children of i.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import staged
from .learning import LEAST_GAIN, RANGE_ROWS, WAIT, mape, stop_early

#: The quantiles that are thresholds, twelve from a tenth to nine tenths.
SHARES = tuple(np.linspace(0.1, 0.9, 12).tolist())
#: Rows of a table of nodes that are sent to all tasks at most, and values of a table of classes; more are joined by shuffles.
MOST_SENT, MOST_VALUES = 100_000, 2_000_000
NODE = ["tree", "node"]
#: What is known of labels: their number, sum and squared deviations, the least and the greatest.
LABELS = ["n", "s", "q", "lo", "hi"]


def _sent(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The rows, marked to be sent to all tasks if they are few; most: how many there can be, where that is known."""
    return F.broadcast(rows) if (rows.count() if most is None else most) <= MOST_SENT else rows


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Staged, with the number of rows."""
    seen = Observation()
    rows = staged(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return rows, seen.get["rows"]


def copies(key: Column, tree: Column) -> Column:
    """How often a tree's bootstrap sample has a row: a Poisson number of mean 1, by a hash of row and tree."""
    chance = F.pmod(F.xxhash64(key, tree), F.lit(1 << 30)) / float(1 << 30)
    below = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]
    return sum((chance >= b).cast("int") for b in below)


def bagged(rows: DataFrame, features: Sequence[str], label: str, key: str, trees: range, bootstrap: bool) -> DataFrame:
    """tree, node (the root), y and xs, the features: a row for each copy of a row in a tree's sample."""
    names = [f"x{i}" for i in range(len(features))]
    each = rows.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, names)])
    each = each.withColumn("tree", F.explode(F.array(*map(F.lit, trees))))
    if bootstrap:
        each = each.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies(F.col("key"), F.col("tree")))))
    return each.select("tree", F.lit(1).cast("long").alias("node"), "y", F.array(*names).alias("xs"))


def classes(bag: DataFrame, size: int) -> DataFrame:
    """tree, node, xs and LABELS: the rows of a bag with the same features are one."""
    names = [f"x{i}" for i in range(size)]
    known = F.count("*").alias("n"), F.sum("y").alias("s"), (F.var_pop("y") * F.count("*")).alias("q"), F.min("y").alias("lo"), F.max("y").alias("hi")
    return bag.groupBy(*NODE, *[F.get("xs", F.lit(i)).alias(x) for i, x in enumerate(names)]).agg(*known).select(*NODE, *LABELS, F.array(*names).alias("xs"))


def feature_hash(tree: Column, node: Column, feature: Column) -> Column:
    """What orders the features that a node chooses from; any engine can reproduce it."""
    return ((tree * 1000003 + node) * 1009 + feature) % 1048573 * 2654435761 % 4294967296


def node_values(bag: DataFrame, nodes: DataFrame, size: int, tried: int) -> DataFrame:
    """tree, node, f, x, n, y (the sum of labels), s and q (of labels less the node's, and of their squares), lo and hi:
    what nodes (tree, node, value) have of each value of the features they choose from."""
    order = F.array_sort(F.array(*[F.struct(feature_hash(F.col("tree"), F.col("node"), F.lit(i)).alias("h"), F.lit(i).alias("f")) for i in range(size)]))
    chosen = nodes.select(*NODE, "value", F.slice(order["f"], 1, tried or max(1, math.isqrt(size))).alias("fs"))
    away = F.col("s") / F.col("n") - F.col("value")
    long = bag.join(chosen, NODE).select(*NODE, *LABELS, away.alias("d"), "xs", F.explode("fs").alias("f")).withColumn("x", F.get("xs", F.col("f")))
    moved = F.sum(F.col("n") * F.col("d")).alias("s"), F.sum(F.col("q") + F.col("n") * F.col("d") * F.col("d")).alias("q")
    return long.groupBy(*NODE, "f", "x").agg(F.sum("n").alias("n"), F.sum("s").alias("y"), *moved, F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def thresholds(counted: DataFrame) -> DataFrame:
    """counted: tree, node, f, x, c (its rows), part. Of each node and feature ts, its quantiles in ascending order, each once.
    Parts are in the order of values, and hold so few that one task can rank what a feature has in one."""
    group = ["tree", "node", "f"]
    parts = counted.groupBy(*group, "part").agg(F.sum("c").alias("here"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(*group, "part", before.alias("before"), F.sum("here").over(w).alias("n"))
    upto = F.sum("c").over(Window.partitionBy(*group, "part").orderBy("x"))
    ranked = counted.withColumn("upto", upto).join(starts, [*group, "part"]).withColumn("hi", F.col("before") + F.col("upto")).withColumn("lo", F.col("hi") - F.col("c"))
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")

    def holds(at: Column) -> Column:
        return (at >= lo) & (at < hi)

    shares = F.filter(F.array(*map(F.lit, SHARES)), lambda s: holds(F.floor((n - 1) * s)) | holds(F.ceil((n - 1) * s)))
    found = ranked.select(*group, "x", "n", "lo", "hi", F.explode(shares).alias("share"))
    at = (n - 1) * F.col("share")
    two = found.withColumn("at", at).groupBy(*group, "share", "at").agg(F.max(F.when(holds(F.floor("at")), F.col("x"))).alias("a"), F.max(F.when(holds(F.ceil("at")), F.col("x"))).alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    return two.groupBy(*group).agg(F.array_sort(F.collect_set(value)).alias("ts"))


def best_splits(values: DataFrame, count: int, most: int, leaf: int) -> DataFrame:
    """tree, node, feature, threshold and l and r, the children (n, value, lo, hi), of those nodes that can be split with
    leaf rows on both sides. values: so many values (count) of nodes and their features (most at most)."""
    group = [*NODE, "f"]
    known = values.where("x is not null").select(*group, "x", F.col("n").alias("c"))
    if count > RANGE_ROWS:
        known = staged(known.repartitionByRange(*group, "x").withColumn("part", F.spark_partition_id()), "dealt")
    ts = thresholds(known if count > RANGE_ROWS else known.withColumn("part", F.lit(0)))
    ts = F.broadcast(ts) if most <= MOST_SENT else staged(ts, "thresholds")
    place = F.when(F.col("x").isNull(), F.size("ts")).otherwise(F.size(F.filter("ts", lambda t: t < F.col("x"))))
    added = {c: F.sum for c in "nysq"} | {"lo": F.min, "hi": F.max}
    bins = values.join(ts, group).groupBy(*group, "ts", place.alias("bin")).agg(*[f(c).alias(c) for c, f in added.items()])
    w = Window.partitionBy(*group).orderBy("bin")  # thirteen bins at most
    for c, f in added.items():
        bins = bins.withColumn(f"{c}_l", f(c).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(f"{c}_r", f(c).over(w.rowsBetween(1, Window.unboundedFollowing)))
    possible = bins.where((F.col("bin") < F.size("ts")) & (F.col("n_l") >= leaf) & (F.col("n_r") >= leaf))
    error = sum(F.col(f"q_{side}") - F.col(f"s_{side}") * F.col(f"s_{side}") / F.col(f"n_{side}") for side in "lr")
    children = [F.struct(F.col(f"n_{c}").alias("n"), (F.col(f"y_{c}") / F.col(f"n_{c}")).alias("value"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")).alias(c) for c in "lr"]
    scored = F.struct(F.round(error / (F.col("q_l") + F.col("q_r")), 9).alias("error"), F.col("f"), F.get("ts", F.col("bin")).alias("t"), *children)
    return possible.groupBy(*NODE).agg(F.min(scored).alias("b")).select(*NODE, F.col("b.f").alias("feature"), F.col("b.t").alias("threshold"), "b.l", "b.r")


def _child() -> Column:
    return F.col("node") * 2 + F.when(F.get("xs", F.col("feature")) <= F.col("threshold"), 0).otherwise(1)


def grow_trees(rows: DataFrame, features: Sequence[str], label: str, key: str, trees: int = 1, depth: int = 10, leaf: int = 12, tried: int = 0, bootstrap: bool = True, first: int = 0) -> DataFrame:
    """The nodes of trees numbered from first: tree, node, n, value (the mean label), feature
    and threshold (null in leaves). tried: features a node chooses from, 0 for the
    root of their number. Without bootstrap, all trees see all rows once."""
    bag = staged(classes(bagged(rows, features, label, key, range(first, first + trees), bootstrap), len(features)), "bag")
    nodes = staged(bag.groupBy(*NODE).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("value"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "nodes")
    found, most = None, trees  # nodes of a level, at most
    for level in range(depth):
        open_nodes = nodes.where((F.col("n") > 2 * leaf) & (F.col("lo") < F.col("hi")))
        values, count = _counted(node_values(bag, _sent(open_nodes, most), len(features), tried), "values")
        splits, split = _counted(best_splits(values, count, most * len(features), leaf), "splits")
        told = nodes.join(splits.select(*NODE, "feature", "threshold"), NODE, "left").select(*NODE, "n", "value", "feature", "threshold")
        found = told if found is None else found.unionByName(told)
        nodes, most = splits.select("tree", F.inline(F.array(*[F.struct((F.col("node") * 2 + i).alias("node"), f"{c}.*") for i, c in enumerate("lr")]))), 2 * split
        if not split:
            break
        if level + 1 < depth:
            bag = staged(bag.join(_sent(splits, split), NODE).select("tree", _child().alias("node"), *LABELS, "xs"), "bag")
    last = nodes.select(*NODE, "n", "value", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"))
    return staged(last if found is None else found.unionByName(last), "trees")


def tree_values(model: DataFrame, rows: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """key, tree and value: what each tree says of each row."""
    last, each = model.agg(F.max("node"), F.array_sort(F.collect_set("tree"))).first()  # as many as trees
    walk = rows.select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in features]).alias("xs"), F.explode(F.lit(each or [0])).alias("tree"), F.lit(1).cast("long").alias("node"))
    splits = _sent(model.where("feature is not null").select(*NODE, "feature", "threshold"))
    for _ in range((last or 1).bit_length() - 1):
        walk = walk.join(splits, NODE, "left").select("key", "xs", "tree", F.when(F.col("feature").isNull(), F.col("node")).otherwise(_child()).alias("node"))
    return walk.join(_sent(model.select(*NODE, "value")), NODE).select(F.col("key").alias(key), "tree", "value")


def grow_forest(train: DataFrame, held: DataFrame, features: Sequence[str], label: str, key: str, trees: int = 90, step: int = 10, patience: int = WAIT, least: float = LEAST_GAIN, **shape) -> tuple[DataFrame | None, list[tuple[int, float]]]:
    """The nodes of a forest on the logarithm of the label, and the error on held rows after
    every step of trees. Trees are grown a step at a time until patience runs out, so those that would be cut
    off are not grown; the forest is cut at the best error."""
    y = F.col(label).cast("double")
    logs = train.where(y.isNotNull()).select(*dict.fromkeys([key, *features]), F.log1p(y).alias("_log"))
    logs = staged(logs.sortWithinPartitions(F.xxhash64(*features)), "logs")  # rows of a class together, which are summed up in every step
    names = [f"x{i}" for i in range(len(features))]
    held = staged(held.select(y.alias("_actual"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, names)]), "held")
    alike, most = _counted(held.select(*names).distinct().withColumn("_class", F.monotonically_increasing_id()), "classes")
    same = reduce(operator.and_, [held[x].eqNullSafe(alike[x]) for x in names])
    truth = staged(held.join(F.broadcast(alike) if most * (len(names) + 1) <= MOST_VALUES else alike, same).select("_class", "_actual"), "truth")
    model, total, errors = None, None, []
    for first in range(0, trees, step):
        more = min(step, trees - first)
        grown = grow_trees(logs, features, "_log", key, more, first=first, **shape)
        model = grown if model is None else model.unionByName(grown)
        says = tree_values(grown, alike, names, "_class").groupBy("_class").agg(F.sum("value").alias("s"))
        total = staged(says if total is None else total.unionByName(says).groupBy("_class").agg(F.sum("s").alias("s")), "sums")
        error = truth.join(F.broadcast(total) if 2 * most <= MOST_VALUES else total, "_class").agg(mape(F.col("_actual"), F.expm1(F.col("s") / (first + more)))).first()[0]
        if error is None:
            return model, errors
        errors.append((first + more, error))
        best = stop_early(errors, patience, least)
        if sum(n > best for n, _ in errors) >= patience:
            break
    return model.where(F.col("tree") < stop_early(errors, patience, least)), errors
