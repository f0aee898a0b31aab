"""The training run on generated features: a model that beats the mean, saved and loaded."""

import datetime
import json

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.operators.comparables import comparable_estimates
from hearthline.operators.valuation import estimates
from hearthline.plans import api, training
from hearthline.sources.tables import with_schema


def generated(spark, n):
    area, kind = 20.0 + F.col("id") * 37 % 200, F.col("id") % 3
    rows = spark.range(n).select(
        "id",
        area.alias("floor_area"),
        F.element_at(F.array(F.lit("Flat"), F.lit("House"), F.lit(" ")), (kind + 1).cast("int")).alias("property_subtype"),
        F.concat(F.lit("SW"), (F.col("id") % 4).cast("string"), F.lit(" 1")).alias("postcode_sector"),
        (5000.0 + F.col("id") % 4 * 1000).alias("postcode_average_per_sqm"),
        (area * (5000.0 + F.col("id") % 4 * 1000) * (1 + kind * 0.1)).alias("indexed_last_sold_price"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 30 / 10.0).alias("nearest_station_distance_km"),
    )
    return with_schema(rows, schemas.FEATURES)


def test_training(spark, tmp_path):
    path = str(tmp_path / "model")
    assert training.load(spark, path) is None
    with pytest.raises(ValueError):
        training.train(spark, generated(spark, 100), path)
    found = training.train(spark, generated(spark, 700), path, depths=(5,), leaves=(2,), trees=20)
    assert found["k"] in training.NEIGHBOURS and 0 <= found["forest_weight"] <= 1
    assert found["metrics"]["test"]["r2"] > 0.8
    saved = training.load(spark, path)
    assert saved.found == found and saved.forest.getNumTrees == found["forest"]["trees"]
    assert set(found["parts"]) == {"train", "validation", "test"} and sum(found["parts"].values()) == found["rows"] == 700
    served(spark, saved)


def served(spark, saved):
    """Predictions by what was saved, next to trees and neighbours walked by hand; and what the endpoint makes of them."""
    features = generated(spark, 700).where("id % 7 = 0")
    got = {r["id"]: r for r in saved.predict(features).collect()}
    assert len(got) == features.count()
    clean = features.withColumn("base_estimator_prediction", training.feature_baseline(with_sales=False))
    vectors = {r["id"]: np.array(r["vec"]) for r in saved.preprocessor.vectors(clean.select("id", *training._inputs(clean)), "id").collect()}
    rows = saved.rows.orderBy("id").collect()
    x, y = np.array([r["vec"] for r in rows]), np.log1p([r["y"] for r in rows])
    for i, v in list(vectors.items())[:20]:
        logs = np.array([t.predict(DenseVector(v)) for t in saved.forest.trees])
        forest, forest_spread = np.expm1(logs.mean()), np.expm1(logs.mean()) * logs.std()
        distance = np.sqrt(((x - v) ** 2).sum(1))
        near = np.argsort(distance, kind="stable")[: saved.found["k"]]
        w = 1 / (distance[near] + 1e-6)
        knn = np.expm1((w * y[near]).sum() / w.sum())
        knn_spread = knn * y[near].std()
        share = saved.found["forest_weight"]
        assert abs(got[i]["forest_prediction"] - forest) < 1 and abs(got[i]["knn_prediction"] - knn) < 1
        assert abs(got[i]["prediction"] - (share * forest + (1 - share) * knn)) < 1
        spread = (knn_spread + forest_spread + abs(knn - forest)) / 3
        assert abs(got[i]["uncertainty"] - spread) < 1
        price = got[i]["prediction"]
        sure = 1 - spread / price - (saved.found["metrics"]["validation"]["mape"] or 0.25) - min(0.25, 0.015 * got[i]["missing"])
        assert abs(got[i]["confidence"] - max(0.05, min(0.95, sure))) < 1e-3
    as_of = datetime.date(2024, 1, 1)
    sold = features.withColumn("last_sold_price", F.when(F.col("id") % 2 == 0, F.lit(900_000)).cast("long"))
    sold = sold.withColumn("postcode_average_per_sqm", F.when(F.col("id") != 7, F.col("postcode_average_per_sqm")))
    sold = sold.withColumn("indexed_last_sold_price", F.when(F.col("id") % 2 == 0, F.col("indexed_last_sold_price")))
    valued = estimates(sold, comparable_estimates(sold), as_of)
    told = {r["id"]: r for r in api.estimate(valued, as_of, [0, 7, 14, 21, 5000], saved).collect()}
    assert set(told) == {0, 7, 14, 21}
    assert told[7]["estimated_price"] is None and told[7]["ml_predictions"] is None and told[7]["mixed_prediction"] is None
    for i in (0, 14, 21):
        m = told[i]["ml_predictions"]
        assert m["available"] and abs(told[i]["mixed_prediction"] - (m["baseline_weight"] * told[i]["estimated_price"] + m["model_weight"] * m["prediction"])) < 0.006 * told[i]["mixed_prediction"]
        assert told[i]["explanations"][-1].startswith("Mixed, ") and f"{told[i]['mixed_prediction']:,}" in told[i]["explanations"][-1]
    plain = api.estimate(valued, as_of, [0, 7])
    absent = {r["id"]: r for r in plain.collect()}
    assert not absent[0]["ml_predictions"]["available"] and "trained" in absent[0]["ml_predictions"]["message"]
    answers = {r["id"]: json.loads(r["response"]) for r in api.responses(plain).collect()}
    assert answers[7]["price_range"] is None and answers[7]["features"]["crime_level"] is None and answers[7]["estimated_price"] is None
    assert answers[0]["price_range"] == {"min": absent[0]["price_min"], "max": absent[0]["price_max"]} and answers[0]["features"]["sale_price_source"] == "exact_matched_sale"
    asked = {r["id"]: json.loads(r["response"]) for r in api.responses(plain, [7, 5000, 7]).collect()}
    assert asked == {7: answers[7], 5000: {"error": "Property not found"}}
    full = json.loads(api.responses(api.estimate(valued, as_of, [14], saved)).first()["response"])
    assert full["prediction_summary"] == {"baseline_prediction": told[14]["estimated_price"], "ml_prediction": told[14]["ml_predictions"]["prediction"], "mixed_prediction": told[14]["mixed_prediction"]}


def test_cleaning(spark):
    rows = training.clean_rows(generated(spark, 30)).collect()
    assert {r["property_subtype"] for r in rows} <= {"FLAT", "HOUSE", None}
    assert all(r["base_estimator_prediction"] is not None for r in rows)
    assert all(len(r["stratum"].split("|")) == 3 for r in rows)
