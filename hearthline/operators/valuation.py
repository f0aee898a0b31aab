"""Valuation rules as column expressions over the feature table's columns."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import anchor_weight, sale_recency_weight
from ..functions.numbers import to_double, whole
from ..functions.text import format_distance, or_null

#: The share of its sale anchor below which a blend may not fall.
SALE_FLOOR = 0.9
#: The features that a model reads.
NUMERIC = (
    "base_estimator_prediction",
    "floor_area",
    "energy_efficiency",
    "latitude",
    "longitude",
    "postcode_average_price",
    "postcode_average_per_sqm",
    "nearest_station_distance_km",
    "nearest_school_distance_km",
    "nearest_primary_school_distance_km",
    "nearest_secondary_school_distance_km",
    "nearby_primary_schools_1km",
    "nearby_secondary_schools_2km",
    "crime_total_12m",
    "crime_avg_monthly_12m",
    "london_hpi_current_index",
    "london_hpi_annual_change_pct",
)
CATEGORICAL = (
    "epc_rating",
    "built_form",
    "property_subtype",
    "postcode_sector",
    "nearest_station_zone",
    "nearest_school_type",
    "crime_level",
)


def ratio(a: Column, b: Column) -> Column:
    """The larger by the smaller; null where the smaller is 0 or either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.try_divide(F.greatest(a, b), F.least(a, b)))


def area_baseline() -> Column:
    return F.when(F.col("floor_area") > 0, F.col("postcode_average_per_sqm") * F.col("floor_area"))


def sale_anchor() -> Column:
    """The indexed price, or the nominal one where that is missing or 0; an anchor of 0 is none."""
    indexed = F.nullif(F.col("indexed_last_sold_price").cast("double"), F.lit(0.0))
    return F.coalesce(indexed, F.nullif(F.col("last_sold_price").cast("double"), F.lit(0.0)))


def sale_weight(anchor: Column, baseline: Column, date: Column, as_of: datetime.date) -> Column:
    """Recency, raised where sale and area disagree."""
    apart, w = ratio(anchor, baseline), sale_recency_weight(date, as_of)
    return F.when((baseline > 0) & (apart >= 1.8), F.greatest(w, F.lit(0.85))).when((baseline > 0) & (apart >= 1.35), F.greatest(w, F.lit(0.8))).otherwise(w)


def area_component(baseline: Column, comparable: Column) -> Column:
    return F.when(comparable.isNotNull(), 0.7 * comparable + 0.3 * baseline).otherwise(baseline)


def blended(baseline: Column, comparable: Column, anchor: Column, weight: Column) -> Column:
    return F.greatest((1.0 - weight) * area_component(baseline, comparable) + weight * anchor, SALE_FLOOR * anchor)


def raw_estimate(baseline: Column, comparable: Column, anchor: Column, weight: Column, average: Column) -> Column:
    """The best evidence there is; null without any."""
    area_only = F.when(comparable.isNotNull(), 0.75 * comparable + 0.25 * baseline).otherwise(baseline)
    return (
        F.when(baseline.isNotNull() & anchor.isNotNull(), blended(baseline, comparable, anchor, weight))
        .when(anchor.isNotNull(), anchor)
        .when(baseline.isNotNull(), area_only)
        .otherwise(average.cast("double"))
    )


def rating_factor(rating: Column) -> Column:
    return F.when(rating.isin("A", "B"), 1.03).when(rating.isin("F", "G"), 0.97).otherwise(1.0)


def location_factors(crime: Column) -> list[Column]:
    km = F.col("nearest_station_distance_km")
    return [
        F.when(km <= 0.5, 1.02).when(km <= 1.0, 1.01).when(km >= 2.0, 0.99).otherwise(1.0),
        F.when(F.col("nearby_primary_schools_1km") >= 3, 1.01).otherwise(1.0),
        F.when(F.col("nearby_secondary_schools_2km") >= 2, 1.01).otherwise(1.0),
        F.when(crime == "LOW", 1.01).when(crime == "HIGH", 0.98).otherwise(1.0),
    ]


def adjusted(value: Column, rating: Column, crime: Column) -> Column:
    return reduce(lambda v, f: v * f, location_factors(crime), value * rating_factor(rating))


def feature_baseline(with_sales: bool) -> Column:
    """The estimate that a model gets as a feature; sales count only in training."""
    c = lambda name: to_double(F.col(name))
    sales = [c("indexed_last_sold_price"), c("last_sold_price")] if with_sales else []
    area = F.when(c("floor_area") > 0, c("floor_area") * c("postcode_average_per_sqm"))
    return adjusted(F.coalesce(area, *sales, c("postcode_average_price")), F.upper("epc_rating"), F.upper("crime_level"))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.45, "medium").otherwise("low")


def missing_features() -> Column:
    """How many of a model's features are null or blank."""
    blank = [F.col(n).isNull() for n in NUMERIC] + [F.col(n).isNull() | (F.trim(F.col(n)) == "") for n in CATEGORICAL]
    return reduce(lambda a, b: a + b, [b.cast("int") for b in blank])


def model_confidence(prediction: Column, uncertainty: Column, missing: Column, mape: Column) -> Column:
    error = F.coalesce(F.nullif(mape, F.lit(0.0)), F.lit(0.25))
    score = 1.0 - uncertainty / F.nullif(prediction, F.lit(0.0)) - error - F.least(F.lit(0.25), 0.015 * missing)
    return F.when(prediction <= 0, 0.0).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.05), score)))


def _or_default(confidence: Column) -> Column:
    return F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(0.35))


def anchored_prediction(prediction: Column, confidence: Column, sale: Column, date: Column, comparable: Column, same_postcode: Column, as_of: datetime.date) -> Column:
    """A model's value pulled towards market evidence: prediction, confidence, label,
    adjusted, weight and ratio."""
    has_sale = sale > 0
    anchor = F.when(has_sale, sale).otherwise(comparable)
    weight = F.when(has_sale, anchor_weight(date, as_of)).when(same_postcode, 0.65).otherwise(0.5)
    apart = ratio(prediction, anchor)
    pull = F.coalesce((prediction > 0) & (apart >= 1.35), F.lit(False))
    value = F.greatest(weight * anchor + (1.0 - weight) * prediction, anchor * 0.85)
    value = F.when(sale.isNotNull(), F.greatest(value, anchor * SALE_FLOOR)).otherwise(value)
    lowered = F.least(_or_default(confidence), F.lit(0.45))
    return F.struct(
        F.when(pull, whole(value)).otherwise(whole(prediction)).alias("prediction"),
        F.when(pull, F.bround(lowered, 3)).otherwise(confidence).alias("confidence"),
        F.when(pull, F.when(lowered >= 0.45, "medium").otherwise("low")).otherwise(confidence_label(confidence)).alias("label"),
        pull.alias("adjusted"),
        F.when(pull, F.bround(weight, 2)).alias("weight"),
        F.when(pull, F.bround(apart, 2)).alias("ratio"),
    )


def mixed_prediction(baseline: Column, prediction: Column, confidence: Column) -> Column:
    """Baseline and model together: mixed, model_weight, baseline_weight, ratio,
    confidence, label and warning."""
    safe = (baseline > 0) & (prediction > 0)
    apart, known = ratio(baseline.cast("double"), prediction.cast("double")), _or_default(confidence)
    by_ratio = lambda far, further, near, other: F.when(apart >= 2.5, far).when(apart >= 1.8, further).when(apart >= 1.35, near).otherwise(other)
    w = by_ratio(0.15, 0.25, 0.35, 0.5)
    w = F.when(known < 0.25, F.least(w, F.lit(0.15))).when(known < 0.45, F.least(w, F.lit(0.25))).otherwise(w)
    sure = F.least(known, by_ratio(0.25, 0.35, 0.5, 1.0))
    warning = by_ratio("very far apart", "substantial disagreement", "noticeable disagreement", F.lit(None))
    return F.struct(
        F.when(safe, whole((1.0 - w) * baseline + w * prediction)).otherwise(baseline.cast("long")).alias("mixed"),
        F.when(safe, F.bround(w, 2)).otherwise(0.0).alias("model_weight"),
        F.when(safe, F.bround(1.0 - w, 2)).otherwise(1.0).alias("baseline_weight"),
        F.when(safe, F.bround(apart, 2)).alias("ratio"),
        F.when(safe, F.bround(sure, 3)).otherwise(0.15).alias("confidence"),
        F.when(safe, confidence_label(sure)).otherwise("low").alias("label"),
        F.when(safe, warning).otherwise("not comparable").alias("warning"),
    )


def blended_models(knn: Column, knn_spread: Column, forest: Column, forest_spread: Column, knn_weight: float = 0.4) -> Column:
    """Two models' values together, and how unsure they are."""
    return F.struct((knn_weight * knn + (1 - knn_weight) * forest).alias("prediction"), ((knn_spread + forest_spread + F.abs(knn - forest)) / 3.0).alias("uncertainty"))


def _pounds(c: Column) -> Column:
    return F.concat(F.lit("£"), F.format_string("%,.0f", c.cast("double")))


def explanation(as_of: datetime.date) -> Column:
    """What a valuation rests on, in order: size and sector, comparables, sale,
    blend, ratings, places, index and crime. Needs the columns of `estimates`."""
    percent = lambda w: F.concat((w * 100).cast("int").cast("string"), F.lit("%"))
    say = lambda when, *parts: F.when(when, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    base, anchor, w, km = F.col("baseline"), F.col("anchor"), F.col("weight"), F.col("nearest_station_distance_km")
    both, comp = base.isNotNull() & anchor.isNotNull(), F.col("comparable")
    said = [
        say(base.isNotNull(), F.format_string("%.0f", "floor_area"), " sqm at the sector's average of ", _pounds(F.col("postcode_average_per_sqm")), " per sqm."),
        say(comp.isNotNull(), comp["count"].cast("string"), " comparable sale(s) in the ", comp["source"], " average ", _pounds(comp["average_per_sqm"]), " per sqm."),
        say(F.col("last_sold_price").isNotNull(), "Last sold for ", _pounds(F.col("last_sold_price")), F.coalesce(F.concat(F.lit(" on "), F.left("last_transfer_date", F.lit(10))), F.lit("")), "."),
        say(F.col("last_sold_price").isNull(), "No exact sale of this dwelling is known."),
        say(F.col("last_sold_price").isNotNull() & F.col("indexed_last_sold_price").isNotNull(), "By the price index that is about ", _pounds(F.col("indexed_last_sold_price")), " now."),
        say(both, "Weights: sale ", percent(w), ", area ", percent(1.0 - w), "."),
        say(both & (w >= 0.8), "The sale has a very strong influence."),
        say(both & (w >= 0.7) & (w < 0.8), "The sale has a strong influence."),
        say(both & (w >= 0.5) & (w < 0.7), "The sale has a moderate influence."),
        say(anchor.isNotNull() & base.isNull(), "The estimate rests on the sale."),
        say(anchor.isNull() & base.isNotNull(), "The estimate rests on size and area prices."),
        say(anchor.isNull() & base.isNull() & F.col("postcode_average_price").isNotNull(), "The estimate is the sector's average price."),
        say(F.col("estimated_price").isNull(), "There is not enough pricing data for this dwelling."),
        say(F.col("epc_rating").isin("A", "B"), "A good energy rating adds a little."),
        say(F.col("epc_rating").isin("F", "G"), "A poor energy rating takes a little."),
        say(km <= 1.0, "A station is near."),
        say(km >= 2.0, "The next station is far."),
        say(or_null(F.col("nearest_station_name")).isNotNull() & km.isNotNull(), "Station: ", F.col("nearest_station_name"), ", ", format_distance(km), "."),
        say(or_null(F.col("nearest_school_name")).isNotNull() & F.col("nearest_school_distance_km").isNotNull(), "School: ", F.col("nearest_school_name"), ", ", format_distance(F.col("nearest_school_distance_km")), "."),
        say(F.col("london_hpi_current_index").isNotNull(), "Price index: ", F.format_string("%.1f", "london_hpi_current_index"), "."),
        say(F.col("crime_avg_monthly_12m").isNotNull(), "Crime is ", F.lower(F.coalesce("crime_level", F.lit("AVERAGE"))), ": about ", F.format_string("%.1f", "crime_avg_monthly_12m"), " a month."),
    ]
    return F.array_compact(F.array(*said))


def estimates(features: DataFrame, comparables: DataFrame, as_of: datetime.date) -> DataFrame:
    """Every dwelling's estimate with what it rests on: baseline, anchor, weight,
    comparable, estimated_price, price_min, price_max and explanations."""
    comparable = F.struct("estimate", "average_per_sqm", "count", "source", "addresses").alias("comparable")
    rows = features.join(comparables.select("id", comparable), "id", "left")
    rows = rows.withColumn("baseline", area_baseline()).withColumn("anchor", sale_anchor())
    rows = rows.withColumn("weight", F.when(F.col("baseline").isNotNull() & F.col("anchor").isNotNull(), sale_weight(F.col("anchor"), F.col("baseline"), F.col("last_transfer_date"), as_of)))
    raw = raw_estimate(F.col("baseline"), F.col("comparable.estimate"), F.col("anchor"), F.col("weight"), F.col("postcode_average_price"))
    rows = rows.withColumn("estimated_price", whole(adjusted(raw, F.col("epc_rating"), F.col("crime_level"))))
    rows = rows.withColumn("price_min", whole(F.col("estimated_price") * 0.95)).withColumn("price_max", whole(F.col("estimated_price") * 1.05))
    return rows.withColumn("explanations", explanation(as_of))


#: Model values of a dwelling: what `without_model` and `with_model` give.
MODEL_PART = (
    "struct<available:boolean,message:string,knn_prediction:long,forest_prediction:long,raw_prediction:long,prediction:long,uncertainty:long,missing:int,"
    "raw_confidence:double,raw_label:string,confidence:double,label:string,adjusted:boolean,anchor_weight:double,anchor_ratio:double,"
    "baseline_weight:double,model_weight:double,ratio:double,warning:string>"
)
NO_MODEL = "No model has been trained yet."


def without_model(estimated: DataFrame) -> DataFrame:
    """Estimates that say that there is no model."""
    absent = F.from_json(F.lit('{"available": false, "message": "' + NO_MODEL + '"}'), MODEL_PART)
    return estimated.withColumn("ml_predictions", F.when(F.col("estimated_price").isNotNull(), absent)).withColumn("mixed_prediction", F.lit(None).cast("long"))


def with_model(estimated: DataFrame, predictions: DataFrame, as_of: datetime.date) -> DataFrame:
    """Estimates with a model's part: its prediction pulled towards the sale or the
    comparables, mixed with the baseline, and said in the explanations."""
    sale = F.col("last_sold_price").cast("double")
    date = F.when(sale.isNotNull(), F.col("last_transfer_date"))
    x = estimated.join(predictions.select("id", F.struct([c for c in predictions.columns if c != "id"]).alias("_p")), "id", "left")
    near = F.coalesce(F.col("comparable.source") == "same postcode", F.lit(False))
    x = x.withColumn("_a", anchored_prediction(F.col("_p.prediction"), F.col("_p.confidence"), sale, date, F.col("comparable.estimate"), near, as_of))
    x = x.withColumn("_m", mixed_prediction(F.col("estimated_price"), F.col("_a.prediction"), F.col("_a.confidence")))
    part = F.struct(
        F.lit(True).alias("available"),
        F.lit(None).cast("string").alias("message"),
        "_p.knn_prediction",
        "_p.forest_prediction",
        whole(F.col("_p.prediction")).alias("raw_prediction"),
        "_a.prediction",
        "_p.uncertainty",
        "_p.missing",
        F.col("_a.confidence").alias("raw_confidence"),
        F.col("_a.label").alias("raw_label"),
        "_m.confidence",
        "_m.label",
        "_a.adjusted",
        F.col("_a.weight").alias("anchor_weight"),
        F.col("_a.ratio").alias("anchor_ratio"),
        "_m.baseline_weight",
        "_m.model_weight",
        "_m.ratio",
        "_m.warning",
    ).cast(MODEL_PART)
    percent = lambda w: F.concat((w * 100).cast("int").cast("string"), F.lit("%"))
    m, a = F.col("_m"), F.col("_a")
    said = F.array_compact(
        F.array(
            F.concat(F.lit("The model joins neighbours and a forest, with "), m["label"], F.lit(" confidence ("), m["confidence"].cast("string"), F.lit(").")),
            F.when(a["adjusted"], F.concat(F.lit("Its first value, "), _pounds(F.col("_p.prediction")), F.lit(", was moved towards "), F.when(sale > 0, "the last sale.").otherwise("the comparables."))),
            F.when(m["warning"].isNotNull(), F.concat(F.lit("Baseline and model: "), m["warning"], F.lit("."))),
            F.concat(F.lit("Mixed, "), percent(m["baseline_weight"]), F.lit(" baseline and "), percent(m["model_weight"]), F.lit(" model: "), _pounds(m["mixed"]), F.lit(".")),
        )
    )
    priced = F.col("estimated_price").isNotNull() & F.col("_p").isNotNull()
    x = x.withColumn("ml_predictions", F.when(priced, part)).withColumn("mixed_prediction", F.when(priced, m["mixed"]))
    return x.withColumn("explanations", F.when(priced, F.concat("explanations", said)).otherwise(F.col("explanations"))).drop("_p", "_a", "_m")


#: Features of an answer; without a price only the first ones are told.
REDUCED = ("postcode", "postcode_sector", "house_number", "epc_rating", "floor_area", "last_sold_price", "last_transfer_date", "postcode_average_price", "postcode_average_per_sqm")
FULL = REDUCED + (
    "energy_efficiency", "built_form", "property_subtype", "indexed_last_sold_price", "latitude", "longitude",
    "nearest_station_name", "nearest_station_zone", "nearest_station_distance_km", "nearest_school_name", "nearest_school_type", "nearest_school_distance_km",
    "nearest_primary_school_distance_km", "nearest_secondary_school_distance_km", "nearby_primary_schools_1km", "nearby_secondary_schools_2km",
    "nearest_hospital_name", "nearest_hospital_distance_km", "crime_lsoa_code", "crime_lsoa_name", "crime_total_12m", "crime_avg_monthly_12m", "crime_level",
    "london_hpi_current_index", "london_hpi_at_last_sale", "london_hpi_annual_change_pct",
)


def response(columns: list[str]) -> Column:
    """A dwelling's answer as a struct. Where there is no price, the range, the model
    and all features but the first ones are null."""
    priced = F.col("estimated_price").isNotNull()
    told = lambda name: F.col(name) if name in columns else F.lit(None)
    source = F.when(F.col("last_sold_price").isNotNull(), "exact_matched_sale").otherwise("area_fallback")
    features = [told(n).alias(n) for n in REDUCED] + [F.when(priced, told(n)).alias(n) for n in FULL[len(REDUCED) :]]
    features += [F.when(priced, source).alias("sale_price_source"), F.when(priced, F.col("comparable")).alias("local_comparable_estimate")]
    summary = F.struct(F.col("estimated_price").alias("baseline_prediction"), F.col("ml_predictions.prediction").alias("ml_prediction"), "mixed_prediction")
    return F.struct(
        F.col("id").alias("property_id"),
        told("full_address").alias("full_address"),
        "estimated_price",
        F.col("estimated_price").alias("base_estimator_prediction"),
        F.when(priced, F.struct(F.col("price_min").alias("min"), F.col("price_max").alias("max"))).alias("price_range"),
        "explanations",
        F.struct(*features).alias("features"),
        "ml_predictions",
        "mixed_prediction",
        F.when(F.col("ml_predictions.available"), summary).alias("prediction_summary"),
    )
