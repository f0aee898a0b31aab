"""Training from the feature table: clean, sample, split, search, fit, weigh, save;
and predictions by what was saved.

Neighbours are ranked once for each fold up to the largest k; forests are grown
once for each fold and cut off where more trees stop helping; what is chosen is chosen
on folds of the training part, so that the validation part is new to the weights. Both models learn the logarithm of
the price. An artifact holds all that serving needs: the forest, the training rows
as vectors, the statistics and category codes, and what was found."""

from __future__ import annotations

import dataclasses
import itertools
import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import price_band, to_double
from ..operators import learning
from ..functions.numbers import whole
from ..operators.valuation import CATEGORICAL, NUMERIC, blended_models, confidence_label, feature_baseline, missing_features, model_confidence
from ..sources.readers import training_rows
from ..sources.tables import staged

#: Guards and grids of the search.
LEAST_ROWS, FOLDS = 500, 4
NEIGHBOURS = (2, 3, 4, 5, 7, 9, 12, 15, 25)
DEPTHS, LEAVES, TRIED = (8, 11, 14, 18, 0), (2, 4, 8, 16), (6, 8, 12, 16)
MOST_TREES, PATIENCE = 90, 10
TARGET = "indexed_last_sold_price"


def _inputs(rows: DataFrame, serve_like: bool = True) -> list:
    """Numbers finite or null, and categories upper case or null."""
    return [to_double(F.col(c)).alias(c) for c in NUMERIC] + [F.upper(T.clean_text(F.col(c))).alias(c) for c in CATEGORICAL]


def clean_rows(features: DataFrame, serve_like: bool = True, most_price: float = 50_000_000) -> DataFrame:
    """The inputs, the baseline among them (as in serving, unless asked otherwise), the target, and the stratum."""
    rows = training_rows(features, most_price).withColumn("base_estimator_prediction", feature_baseline(with_sales=not serve_like))
    y = F.col(TARGET).cast("double")
    return rows.select("id", *_inputs(rows), y.alias("y"), T.stratum(F.col("property_subtype"), F.col("postcode_sector"), price_band(y)).alias("stratum"))


@dataclasses.dataclass
class Preprocessor:
    """How rows become vectors: statistics of the numbers (a row for each), and codes
    of the categories (feature, category, code)."""

    statistics: dict[str, dict[str, float]]
    codes: DataFrame

    @classmethod
    def learn(cls, rows: DataFrame) -> Preprocessor:
        found = learning.numeric_statistics(rows, NUMERIC).collect()  # one row for each feature
        codes = [learning.category_codes(rows, c).select(F.lit(c).alias("feature"), "category", "code") for c in CATEGORICAL]
        both = codes[0]
        for c in codes[1:]:
            both = both.unionByName(c)
        return cls({r["feature"]: {n: r[n] for n in ("median", "mean", "std")} for r in found}, staged(both, "codes"))

    def vectors(self, rows: DataFrame, *keep: str) -> DataFrame:
        """The kept columns and vec: standardised numbers, then category codes, 0 for what was not seen."""
        s = self.statistics
        vector = [learning.standardized(F.col(c), *[F.lit(s[c][n]) for n in ("median", "mean", "std")]) for c in NUMERIC]
        for c in CATEGORICAL:
            own = self.codes.where(F.col("feature") == c).select(F.col("category").alias(c), F.col("code").alias(f"{c}_code"))
            rows = rows.join(own, c, "left")
            vector.append(F.coalesce(f"{c}_code", F.lit(0)).cast("double"))
        return rows.select(*keep, F.array(*vector).alias("vec"))


def vectorized(rows: DataFrame, learned_from: DataFrame) -> DataFrame:
    """id, y, stratum and vec, learned from some of the rows."""
    return Preprocessor.learn(learned_from).vectors(rows, "id", "y", "stratum")


def _neighbour_prices(asked: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """id, knn and knn_spread: the neighbours' mean logarithm as a price, and their spread at its scale."""
    logs = train.select(F.col("id").alias("row_id"), "vec", F.log1p("y").alias("y"))
    near = learning.neighbour_means(learning.nearest_rows(asked.select("id", "vec"), logs, k))
    price = F.expm1("prediction")
    return near.select("id", price.alias("knn"), F.greatest(F.lit(0.0), price * F.col("spread")).alias("knn_spread"))


def search_neighbours(train: DataFrame, ks: Sequence[int] = NEIGHBOURS, folds: int = FOLDS) -> DataFrame:
    """k and its mean error over the folds, best first."""
    dealt = staged(learning.stratified_folds(train, "id", "stratum", folds), "folds")
    found = None
    for fold in range(folds):
        asked, rest = dealt.where(F.col("fold") == fold), dealt.where(F.col("fold") != fold)
        near = learning.nearest_rows(asked.select("id", "vec"), rest.select(F.col("id").alias("row_id"), "vec", F.log1p("y").alias("y")), max(ks))
        scored = learning.score_of_k(near, asked, ks, logarithms=True)
        found = scored if found is None else found.unionByName(scored)
    return found.groupBy("k").agg(F.avg("mape").alias("mape")).orderBy("mape", "k")


def _wide(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    return rows.select("id", "y", *keep, *[F.col("vec")[i].alias(f"f{i}") for i in range(size)])


def forest_folds(train: DataFrame, size: int, folds: int = FOLDS) -> list[tuple[DataFrame, DataFrame]]:
    """The rows to learn from and those held out, of every fold of the training part."""
    dealt = staged(learning.stratified_folds(train, "id", "stratum", folds), "forest-folds")
    wide = staged(_wide(dealt, size, "fold"), "forest-rows")
    return [(wide.where(F.col("fold") != i), wide.where(F.col("fold") == i)) for i in range(folds)]


def search_forest(train: DataFrame, size: int, depths=DEPTHS, leaves=LEAVES, tried=TRIED, trees: int = MOST_TREES, patience: int = PATIENCE, folds: int = FOLDS) -> dict:
    """The depth, leaf size and number of features tried with the least mean error over
    folds of the training part, each fold's forest cut off where more trees stop helping;
    trees is the folds' mean. Configurations are taken in order until patience runs out
    without a gain; the first of equal ones wins."""
    names, found, best, waited = [f"f{i}" for i in range(size)], [], math.inf, 0
    parts = forest_folds(train, size, folds)
    for depth, leaf, some in itertools.product(depths, leaves, tried):
        scores, kept = [], []
        for fold, (learned, held) in enumerate(parts, 1):
            model = learning.fit_forest(learned, names, "y", trees, depth, leaf, 42 + fold, some)
            errors = sorted((r["trees"], r["mape"]) for r in learning.prefix_errors(model, held, names, "y").collect())
            kept.append(learning.stop_early(errors))
            scores.append(dict(errors)[kept[-1]])
        found.append({"mape": round(sum(scores) / len(scores), 4), "depth": depth, "leaf": leaf, "tried": some, "trees": max(1, round(sum(kept) / len(kept)))})
        if found[-1]["mape"] < best - learning.LEAST_GAIN:
            best, waited = found[-1]["mape"], 0
        else:
            waited += 1
        if waited >= patience:
            break
    return min(found, key=lambda c: c["mape"])


def train(spark: SparkSession, features: DataFrame, path: str, most_rows: int = 0, most_price: float = 50_000_000, **forest_search) -> dict:
    """Fits both models on features and saves them, with all that serving needs, under path."""
    cleaned = staged(learning.stratified_sample(clean_rows(features, most_price=most_price), "id", "stratum", most_rows), "cleaned")
    rows = cleaned.count()
    if rows < LEAST_ROWS:
        raise ValueError(f"{rows} rows are too few to learn from; {LEAST_ROWS} is the least")
    parts = staged(learning.three_way_split(cleaned, "id", "stratum"), "parts")
    part = lambda name: parts.where(F.col("part") == name).drop("part")
    prepared = Preprocessor.learn(part("train"))
    sets = {name: staged(prepared.vectors(part(name), "id", "y", "stratum"), name) for name in ("train", "validation", "test")}
    size = len(NUMERIC) + len(CATEGORICAL)
    k = search_neighbours(sets["train"]).first()["k"]
    chosen = search_forest(sets["train"], size, **forest_search)
    names = [f"f{i}" for i in range(size)]
    model = learning.fit_forest(_wide(sets["train"], size), names, "y", chosen["trees"], chosen["depth"], chosen["leaf"], tried=chosen["tried"])

    def both(name: str) -> DataFrame:
        forest = learning.predict_forest(model, _wide(sets[name], size), names)
        forest = forest.select("id", "y", F.col("prediction").alias("forest"), F.col("spread").alias("forest_spread"))
        return forest.join(_neighbour_prices(sets[name], sets["train"], k), "id")

    weight = learning.best_weight(learning.weight_sweep(both("validation"), "y", "knn", "forest")).first()["forest_weight"]
    mixed = blended_models(F.col("knn"), F.col("knn_spread"), F.col("forest"), F.col("forest_spread"), 1 - weight)
    scores = {name: learning.regression_metrics(both(name).withColumn("p", mixed["prediction"]), "y", "p").first().asDict() for name in ("validation", "test")}
    counts = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    artifact = {
        "k": k, "forest": chosen, "forest_weight": weight, "metrics": scores, "rows": rows, "parts": counts,
        "numeric": list(NUMERIC), "categorical": list(CATEGORICAL), "statistics": prepared.statistics, "target": "log1p",
    }
    model.write().overwrite().save(f"{path}/forest")
    prepared.codes.write.mode("overwrite").parquet(f"{path}/codes")
    sets["train"].select("id", "vec", "y").write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps(artifact),)], "artifact string").coalesce(1).write.mode("overwrite").text(f"{path}/artifact")
    return artifact


@dataclasses.dataclass
class Artifact:
    """What was saved: the forest, the training rows, the preprocessor, and what was found."""

    forest: object
    rows: DataFrame
    preprocessor: Preprocessor
    found: dict

    def predict(self, features: DataFrame) -> DataFrame:
        """id and both models' prices, their blend, its uncertainty and confidence, and the number of missing inputs."""
        served = features.withColumn("base_estimator_prediction", feature_baseline(with_sales=False))
        asked = staged(served.select("id", *_inputs(served), missing_features().alias("missing")), "asked")
        vectors = self.preprocessor.vectors(asked, "id")
        size = len(NUMERIC) + len(CATEGORICAL)
        wide = vectors.select("id", *[F.col("vec")[i].alias(f"f{i}") for i in range(size)])
        forest = learning.predict_forest(self.forest, wide, [f"f{i}" for i in range(size)]).select("id", F.col("prediction").alias("forest"), F.col("spread").alias("forest_spread"))
        both = forest.join(_neighbour_prices(vectors, self.rows, self.found["k"]), "id").join(asked.select("id", "missing"), "id")
        weight = self.found["forest_weight"]
        both = both.withColumn("x", blended_models(F.col("knn"), F.col("knn_spread"), F.col("forest"), F.col("forest_spread"), 1 - weight))
        sure = model_confidence(F.col("x.prediction"), F.col("x.uncertainty"), F.col("missing"), F.lit(self.found["metrics"]["validation"]["mape"]))
        return both.withColumn("sure", sure).select(
            "id",
            whole(F.col("knn")).alias("knn_prediction"),
            whole(F.col("forest")).alias("forest_prediction"),
            F.col("x.prediction").alias("prediction"),
            whole(F.col("x.uncertainty")).alias("uncertainty"),
            F.bround("sure", 3).alias("confidence"),
            confidence_label(F.col("sure")).alias("label"),
            "missing",
        )


def load(spark: SparkSession, path: str) -> Artifact | None:
    """What was saved under path, or None where nothing is."""
    from pyspark.errors import AnalysisException
    from pyspark.ml.regression import RandomForestRegressionModel

    try:
        found = json.loads(spark.read.text(f"{path}/artifact").first()[0])
    except AnalysisException:
        return None
    prepared = Preprocessor(found["statistics"], spark.read.parquet(f"{path}/codes"))
    return Artifact(RandomForestRegressionModel.load(f"{path}/forest"), spark.read.parquet(f"{path}/rows"), prepared, found)
