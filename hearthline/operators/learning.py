"""Training: preprocessing, neighbours, forests, splits and scores as Spark jobs."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import staged
from .quantiles import exact_quantiles

#: Rows of a block of queries or of training rows.
BLOCK = 4096
#: Rows that are pivots, and rings of a pivot's cell, at most.
MOST_PIVOTS, RINGS = 512, 32
#: Rows of a stratum that are ranked together, about.
RANGE_ROWS = 200_000
EPSILON = 1e-6


def hash_order(key: Column) -> list[Column]:
    """An order that looks random and that any engine can reproduce."""
    return [(key.cast("long") * 2654435761) % 4294967296, key]


def numeric_statistics(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column: median, and mean and population deviation after
    nulls got the median. A column without values has a median of 0, a deviation of 0 counts as 1.
    The median is exact, and no task holds or ranks a column."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*")
    long = staged(long, "numbers")
    found = exact_quantiles(long, [0.5])
    medians = rows.sparkSession.createDataFrame([(c, found[c][0] if c in found else 0.0) for c in columns], "feature string, median double")
    filled = long.join(F.broadcast(medians), "feature").withColumn("y", F.coalesce("x", "median"))  # a row for each column
    spread = F.stddev_pop("y")
    return filled.groupBy("feature", "median").agg(F.avg("y").alias("mean"), F.when(spread == 0, 1.0).otherwise(spread).alias("std"))


def standardized(c: Column, median: Column, mean: Column, std: Column) -> Column:
    return (F.coalesce(c.cast("double"), median) - mean) / std


def category_codes(rows: DataFrame, column: str) -> DataFrame:
    """category and code: sorted labels (upper case, blanks off) from 1; whatever is missing or unseen is 0."""
    label = F.upper(F.trim(column))
    seen = rows.select(label.alias("category")).where("category <> ''").distinct()
    return seen.withColumn("code", F.row_number().over(Window.orderBy("category")).cast("int"))


def _meet(k: int):
    """For cogroups of queries (id, vec) and rows (row_id, vec, y): the k nearest rows of
    each query. A matrix product finds who can be among them, whose distances are then exact."""

    def meet(ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if ask.empty or rows.empty:
            return pd.DataFrame({"id": [], "row_id": [], "distance": [], "y": []})
        rows = rows.sort_values("row_id", kind="stable")
        x, q = np.array(rows["vec"].to_list(), np.float64), np.array(ask["vec"].to_list(), np.float64)
        ids, y, take = rows["row_id"].to_numpy(), rows["y"].to_numpy(), min(k, len(rows))
        asking, lengths, out = ask["id"].to_numpy(), (x * x).sum(1), []
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            rough = (part * part).sum(1)[:, None] + lengths - 2 * part @ x.T  # squares, up to rounding
            limit = np.partition(rough, take - 1, axis=1)[:, take - 1 : take] + 1e-9 * (1 + np.abs(lengths).max() + (part * part).sum(1).max())
            i, j = np.nonzero(rough <= limit)
            distance = np.sqrt(((x[j] - part[i]) ** 2).sum(1))
            order = np.lexsort((j, distance, i))
            i, j, distance = i[order], j[order], distance[order]
            first = np.searchsorted(i, i) + take > np.arange(len(i))  # the first so many of each query
            out.append(pd.DataFrame({"id": asking[at + i[first]], "row_id": ids[j[first]], "distance": distance[first], "y": y[j[first]]}))
        return pd.concat(out)

    return meet


def _from_pivots(vectors: Sequence, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors (rows) from all pivots."""
    x = np.array(list(vectors), np.float64)
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


@dataclasses.dataclass
class Blocks:
    """Rows in blocks of bounded size. Some rows are pivots, at most MOST_PIVOTS; each row is
    in the cell of the pivot nearest to it, cells are cut into rings by the distance from
    the pivot (RINGS at most, so that what tells where rings end is of bounded size),
    and what a ring has too many of is dealt by hash."""

    rows: DataFrame  # row_id, vec, y, cell, ring, salt
    pivots: np.ndarray
    edges: list[np.ndarray]  # of a cell: where its rings end, but for the last
    span: np.ndarray  # of a cell: the least and greatest distance from its pivot

    @classmethod
    def of(cls, train: DataFrame) -> Blocks | None:
        """None where there are no rows."""
        held = staged(train.select("row_id", "vec", F.col("y").cast("double").alias("y")), "rows")
        wanted = min(MOST_PIVOTS, math.ceil(held.count() / BLOCK))
        chosen = held.orderBy(F.xxhash64("row_id"), "row_id").limit(wanted).collect()  # MOST_PIVOTS at most
        if not chosen:
            return None
        pivots = np.array([r["vec"] for r in chosen], np.float64)

        def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                away = _from_pivots(part["vec"], pivots) if len(part) else np.zeros((0, len(pivots)))
                yield part.assign(cell=away.argmin(1).astype(np.int32), away=away.min(1, initial=np.inf))

        kind = held.schema["vec"].dataType.simpleString()
        placed = staged(held.mapInPandas(place, f"row_id long, vec {kind}, y double, cell int, away double"), "cells")
        shares = [i / RINGS for i in range(1, RINGS)]
        sized = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi"), F.percentile_approx("away", shares, 1000).alias("at"))
        edges, span = [np.zeros(0)] * len(pivots), np.full((len(pivots), 2), np.inf)
        for r in sized.collect():  # one for each pivot
            rings = min(RINGS, math.ceil(r["n"] / BLOCK))
            edges[r["cell"]] = np.unique([r["at"][i * RINGS // rings - 1] for i in range(1, rings)])
            span[r["cell"]] = r["lo"], r["hi"]

        def ring(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                at = [int(np.searchsorted(edges[c], d)) for c, d in zip(part["cell"], part["away"])]
                yield part.drop(columns="away").assign(ring=np.array(at, np.int32))

        ringed = staged(placed.mapInPandas(ring, f"row_id long, vec {kind}, y double, cell int, ring int"), "rings")
        deal = ringed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
        salt = F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int").alias("salt")
        dealt = ringed.join(F.broadcast(deal), ["cell", "ring"])  # MOST_PIVOTS * RINGS rows at most
        return cls(staged(dealt.select("row_id", "vec", "y", "cell", "ring", salt), "blocks"), pivots, edges, span)

    def own(self, queries: DataFrame) -> DataFrame:
        """id, vec, cell, ring and salt of the block that a query meets first: in the nearest pivot's cell, at its own distance."""
        pivots, edges = self.pivots, self.edges

        def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                away = _from_pivots(part["vec"], pivots) if len(part) else np.zeros((0, len(pivots)))
                cell, least = away.argmin(1), away.min(1, initial=np.inf)
                ring = [int(np.searchsorted(edges[c], d)) for c, d in zip(cell, least)]
                yield part.assign(cell=cell.astype(np.int32), ring=np.array(ring, np.int32), salt=np.zeros(len(part), np.int32))

        return queries.mapInPandas(place, f"id long, vec {queries.schema['vec'].dataType.simpleString()}, cell int, ring int, salt int")

    def within_reach(self, reached: DataFrame) -> DataFrame:
        """id, cell and ring of all rings that can hold a row as near as reach to a query (id,
        vec, reach): by the triangle inequality, its distance from their pivot differs
        from the query's by no more than that."""
        pivots, edges, span = self.pivots, self.edges, self.span

        def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if part.empty:
                    continue
                away, reach, ids = _from_pivots(part["vec"], pivots), part["reach"].to_numpy(), part["id"].to_numpy()
                slack = 1e-6 * (1 + np.abs(away))  # rounding of products and roots
                for cell in range(len(pivots)):
                    low, high = away[:, cell] - reach - slack[:, cell], away[:, cell] + reach + slack[:, cell]
                    at = np.flatnonzero((low <= span[cell, 1]) & (high >= span[cell, 0]))
                    first, last = np.searchsorted(edges[cell], low[at]), np.searchsorted(edges[cell], high[at])
                    count = last - first + 1
                    ring = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    yield pd.DataFrame({"id": np.repeat(ids[at], count), "cell": np.int32(cell), "ring": ring.astype(np.int32)})

        return reached.mapInPandas(visit, "id long, cell int, ring int")

    def met(self, asked: DataFrame, queries: int, k: int) -> DataFrame:
        """The k nearest rows in each block that a query (id, vec, cell, ring, salt) meets.
        Queries at a block are dealt too, so neither side of a meeting exceeds about BLOCK rows."""
        place = ["cell", "ring", "salt", "turn"]
        asked = asked.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(queries / BLOCK)))))
        held = self.rows.join(asked.select(*place).distinct(), ["cell", "ring", "salt"]).select("row_id", "vec", "y", *[F.col(c).alias(f"at_{c}") for c in place])
        met = asked.select("id", "vec", *place).groupBy(*place).cogroup(held.groupBy(*[f"at_{c}" for c in place]))
        return met.applyInPandas(_meet(k), "id long, row_id long, distance double, y double")


def block_visits(blocks: Blocks, queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """id, vec, cell, ring and salt of the further blocks that queries (with their own
    block) have to meet, once the first one gave the distances in first."""
    reach = first.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    reached = queries.join(reach, "id", "left").select("id", "vec", F.when(F.col("n") >= k, F.col("far")).otherwise(math.inf).alias("reach"))
    salts = blocks.rows.select("cell", "ring", "salt").distinct()
    rings = blocks.within_reach(reached).join(F.broadcast(salts.groupBy("cell", "ring").agg(F.max("salt").alias("salts"))), ["cell", "ring"])  # as many rows as rings
    every = rings.select("id", "cell", "ring", F.explode(F.sequence(F.lit(0), F.col("salts"))).alias("salt"))
    return every.join(queries.select("id", "vec", F.col("cell").alias("c"), F.col("ring").alias("r")), "id").where("not (cell = c and ring = r and salt = 0)").drop("c", "r")


def nearest_rows(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """queries: id, vec. train: row_id, vec, y. The k nearest rows of each query
    (id, row_id, distance, y, place), ties to the smaller row_id; exact. A query meets the
    block that it belongs to; how far the k-th row is there tells which other blocks can
    hold a nearer one, and only these are met."""
    blocks = Blocks.of(train)
    if blocks is None:
        return queries.sparkSession.createDataFrame([], "id long, row_id long, distance double, y double, place int")
    asked = staged(blocks.own(queries.select("id", "vec")), "asked")
    n = asked.count()
    first = staged(blocks.met(asked, n, k), "first")
    second = blocks.met(staged(block_visits(blocks, asked, first, k), "visits"), n, k)
    w = Window.partitionBy("id").orderBy("distance", "row_id")
    return first.unionByName(second).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def neighbour_means(neighbours: DataFrame) -> DataFrame:
    """id, prediction (weights 1 / (distance + EPSILON)) and spread of the neighbours' values."""
    w = 1.0 / (F.col("distance") + EPSILON)
    return neighbours.groupBy("id").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("prediction"), F.stddev_pop("y").alias("spread"))


def score_of_k(neighbours: DataFrame, truth: DataFrame, ks: Sequence[int], logarithms: bool = False) -> DataFrame:
    """k and mape for every k, from one ranking up to the largest. Neighbours' values may be logarithms of truth's."""
    each = neighbours.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("place <= k")
    w = 1.0 / (F.col("distance") + EPSILON)
    mean = F.sum(w * F.col("y")) / F.sum(w)
    predicted = each.groupBy("id", "k").agg((F.expm1(mean) if logarithms else mean).alias("prediction"))
    return predicted.join(truth.select("id", F.col("y").alias("actual")), "id").groupBy("k").agg(mape(F.col("actual"), F.col("prediction")).alias("mape"))


def mape(y: Column, prediction: Column) -> Column:
    return F.avg(F.abs(y - prediction) / F.greatest(y, F.lit(1.0)))


def regression_metrics(rows: DataFrame, y: str, prediction: str) -> DataFrame:
    a, p = F.col(y).cast("double"), F.col(prediction).cast("double")
    total = F.var_pop(a) * F.count(a)
    return rows.agg(
        F.avg(F.abs(a - p)).alias("mae"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        mape(a, p).alias("mape"),
        F.when(total > 0, 1.0 - F.sum((a - p) * (a - p)) / total).otherwise(0.0).alias("r2"),
    )


def with_places(rows: DataFrame, key: str, stratum: str) -> DataFrame:
    """The rows with place, from 1 in the order of hashes within their stratum, and n,
    the stratum's rows. Strata are cut into ranges of hashes of bounded size; a range
    counts its own rows and adds what the ranges before it hold, so that no task
    ranks a stratum, however large. Null is a stratum like any other."""
    ranges = 2 * max(1, math.ceil(rows.count() / RANGE_ROWS))  # hashes of negative keys are negative
    hashed, _ = hash_order(F.col(key))
    cut = rows.withColumn("_hash", hashed).withColumn("_range", F.expr(f"(_hash + 4294967296) * {ranges} div 8589934592"))
    counts = cut.groupBy(F.col(stratum).alias("_stratum"), F.col("_range").alias("_at")).agg(F.count("*").alias("_here"))
    earlier = F.coalesce(F.sum("_here").over(Window.partitionBy("_stratum").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_stratum", "_at", earlier.alias("_before"), F.sum("_here").over(Window.partitionBy("_stratum")).alias("n"))
    within = F.row_number().over(Window.partitionBy(stratum, "_range").orderBy("_hash", key))
    same = F.col(stratum).eqNullSafe(F.col("_stratum")) & F.col("_range").eqNullSafe(F.col("_at"))
    placed = cut.withColumn("_within", within).join(starts, same).withColumn("place", F.col("_before") + F.col("_within"))
    return placed.select(*rows.columns, "place", "n")


def three_way_split(rows: DataFrame, key: str, stratum: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """The rows with part: train, validation or test, by quota within each stratum;
    strata of fewer than three all train."""
    counted = with_places(rows, key, stratum)
    first = F.greatest(F.lit(1), F.bround(F.col("n") * train, 0).cast("int"))
    second = F.greatest(F.lit(1), F.bround(F.col("n") * validation, 0).cast("int"))
    over = first + second >= F.col("n")
    counted = counted.withColumn("first", F.when(over, F.col("n") - 2).otherwise(first)).withColumn("second", F.when(over, 1).otherwise(second))
    part = F.when((F.col("n") < 3) | (F.col("place") <= F.col("first")), "train").when(F.col("place") <= F.col("first") + F.col("second"), "validation").otherwise("test")
    return counted.withColumn("part", part).drop("place", "n", "first", "second")


def stratified_folds(rows: DataFrame, key: str, stratum: str, folds: int = 4) -> DataFrame:
    """The rows with fold, dealt in turn within each stratum."""
    dealt = with_places(rows, key, stratum)
    return dealt.withColumn("fold", ((F.col("place") - 1) % folds).cast("int")).drop("place", "n")


def stratified_sample(rows: DataFrame, key: str, stratum: str, most: int) -> DataFrame:
    """About most rows in all, each stratum by its share, one at least. Nothing goes where there are no more."""
    total = rows.count()
    if most <= 0 or total <= most:
        return rows
    counted = with_places(rows, key, stratum)
    quota = F.greatest(F.lit(1), F.bround(F.col("n") * most / total, 0).cast("int"))
    over = counted.withColumn("over", F.col("place") > quota)
    return over.orderBy("over", *hash_order(F.col(key))).limit(most).drop("place", "n", "over")


def weight_sweep(rows: DataFrame, y: str, knn: str, forest: str, steps: int = 10) -> DataFrame:
    """forest_weight and mape for each weight from 0 to 1."""
    weights = F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)]))
    mixed = rows.withColumn("forest_weight", weights).withColumn("p", (1.0 - F.col("forest_weight")) * F.col(knn) + F.col("forest_weight") * F.col(forest))
    return mixed.groupBy("forest_weight").agg(mape(F.col(y), F.col("p")).alias("mape"))


def best_weight(sweep: DataFrame) -> DataFrame:
    """The weight with the least error; the lowest wins ties."""
    return sweep.agg(F.min_by("forest_weight", F.struct("mape", "forest_weight")).alias("forest_weight"), F.min("mape").alias("mape"))


def fit_forest(train: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 8, leaf: int = 2, seed: int = 42, tried: int = 0):
    """A bagged forest on the logarithm of the label; a depth of 0 means the deepest there
    is. tried: features that a node chooses from, 0 for the usual share."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    ready = VectorAssembler(inputCols=list(features), outputCol="vec").transform(train).withColumn("log_label", F.log1p(label))
    return RandomForestRegressor(featuresCol="vec", labelCol="log_label", numTrees=trees, maxDepth=depth or 30, minInstancesPerNode=leaf, featureSubsetStrategy=str(tried) if tried else "auto", seed=seed).fit(ready)


def _with_trees(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows with vec and a column tree_i for each tree's value, a logarithm."""
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=list(features), outputCol="vec").transform(rows)
    for i, tree in enumerate(model.trees):
        ready = tree.setPredictionCol(f"tree_{i}").transform(ready)
    return ready


def predict_forest(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows with prediction, and spread: the deviation of the trees' logarithms, at the prediction's scale."""
    names = [f"tree_{i}" for i in range(len(model.trees))]
    each, n = F.array(*names), len(names)
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / n
    found = _with_trees(model, rows, features).withColumn("_mean", mean)
    square = F.aggregate(each, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
    prediction = F.expm1("_mean")
    return found.withColumn("prediction", prediction).withColumn("spread", F.greatest(F.lit(0.0), prediction * F.sqrt(square))).drop("vec", "_mean", *names)


def prefix_errors(model, rows: DataFrame, features: Sequence[str], label: str, step: int = 10) -> DataFrame:
    """trees and mape of the forest cut off after every step-th tree: one fit, one pass."""
    ready = _with_trees(model, rows.withColumn("y", F.col(label).cast("double")), features)
    sizes = list(range(step, len(model.trees) + 1, step)) or [len(model.trees)]
    each = F.array(*[F.struct(F.lit(n).alias("trees"), F.expm1(sum(F.col(f"tree_{i}") for i in range(n)) / n).alias("p")) for n in sizes])
    return ready.select("y", F.explode(each).alias("x")).groupBy("x.trees").agg(mape(F.col("y"), F.col("x.p")).alias("mape"))


#: What counts as an improvement of an error, and rounds to wait for one.
LEAST_GAIN, WAIT = 0.002, 3


def stop_early(errors: Sequence[tuple[int, float]], patience: int = WAIT, least: float = LEAST_GAIN) -> int:
    """The number of trees at the best error before patience ran out."""
    best, kept, waited = math.inf, 0, 0
    for trees, error in errors:
        if error < best - least:
            best, kept, waited = error, trees, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return kept or (errors[0][0] if errors else 0)
