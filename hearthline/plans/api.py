"""The query surface: lookups and suggestions over the engine's tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import spatial, valuation


def _postcode(text: str) -> Column:
    return T.clean_postcode(F.lit(text))


def _first(df: DataFrame, n: int) -> DataFrame:
    """The first rows by id, so that a limit is the same every time."""
    if n < 0:
        raise ValueError("a limit is 0 or more")
    return df.orderBy("id").limit(n)


def _of_postcode(df: DataFrame, postcode: str) -> DataFrame:
    return df.where(F.col("postcode_clean") == _postcode(postcode))


def check_postcode(postcodes: DataFrame, postcode: str) -> DataFrame:
    return _of_postcode(postcodes, postcode).limit(1)


def address_suggestions(sales: DataFrame, postcode: str, door: str = "") -> DataFrame:
    return _first(_of_postcode(sales, postcode).where(T.contains_text(F.col("house_number"), door)), 20)


def certificate_suggestions(certificates: DataFrame, postcode: str, text: str = "") -> DataFrame:
    found = T.contains_text(F.col("full_address"), text) | T.contains_text(F.col("house_number"), text)
    return _first(_of_postcode(certificates, postcode).where(found), 20)


def property_search(features: DataFrame, postcode: str, text: str = "", limit: int = 20) -> DataFrame:
    found = T.contains_text(F.col("full_address"), text) | T.contains_text(F.col("house_number"), text)
    source = F.when(F.col("last_sold_price").isNotNull(), "exact_matched_sale").otherwise("area_fallback").alias("sale_price_source")
    return _first(_of_postcode(features, postcode).where(found).select("*", source), max(1, min(limit, 50)))


def postcode_suggestions(postcodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Sorted distinct postcodes that start with the text; none for a blank one."""
    typed = text.upper().replace(" ", "").strip()
    found = postcodes.where(T.starts_with_text(F.col("postcode_clean"), typed) if typed else F.lit(False))
    return found.select("postcode_clean").distinct().orderBy("postcode_clean").limit(max(1, min(limit, 10)))


def data_coverage(postcodes: DataFrame) -> DataFrame:
    """One row: distinct postcodes (null is one), rows, and the sorted outward codes."""
    p = F.col("postcode_clean")
    outward = F.when(F.length(p) > 3, F.left(p, F.length(p) - 3))
    distinct = F.count_distinct(p) + F.max(p.isNull().cast("int"))
    return postcodes.agg(distinct.alias("postcodes"), F.count("*").alias("rows"), F.array_sort(F.collect_set(outward)).alias("prefixes"))


def debug_certificates(certificates: DataFrame, postcode: str) -> DataFrame:
    return _first(_of_postcode(certificates, postcode), 20)


def features_preview(features: DataFrame, limit: int) -> DataFrame:
    return _first(features, limit)


def estimate(valued: DataFrame, as_of: datetime.date, ids: list[int] | None = None, artifact=None) -> DataFrame:
    """Valuations of the given dwellings, or of all; unknown ids have no row. With a
    trained artifact (plans.training) each has ml_predictions (available), a mixed
    value and what explains them; without one ml_predictions says so. Dwellings
    without any price keep to that: they have no model part."""
    asked = valued if ids is None else valued.where(F.col("id").isin(*ids))
    return valuation.without_model(asked) if artifact is None else valuation.with_model(asked, artifact.predict(asked), as_of)


#: Fixed value: what an unknown id is told.
NOT_FOUND = '{"error":"Property not found"}'


def responses(estimated: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """id and response (JSON): the estimate, its range, explanations and features;
    where there is no price, the reduced answer. With ids there is a row for each of
    them, an error for those that are unknown."""
    told = estimated.select("id", F.to_json(valuation.response(estimated.columns), {"ignoreNullFields": "false"}).alias("response"))
    if ids is None:
        return told
    asked = estimated.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id long")
    return asked.join(told, "id", "left").select("id", F.coalesce("response", F.lit(NOT_FOUND)).alias("response"))


def map_amenities(points: DataFrame, stations: DataFrame, schools: DataFrame) -> DataFrame:
    """id and amenities: the nearest station and school with their places, distances and
    labels, as a map shows them. Empty for points without finite coordinates."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c)
    here = points.select("id", *[finite(c) for c in ("latitude", "longitude")])
    found = here.select("id")
    for kind, places, label, detail in (
        ("station", stations, "Closest station", F.concat(F.lit("Zone "), T.or_null(F.col("detail")))),
        ("school", schools, "Closest school", F.col("detail")),
    ):
        named = places.select("*", F.col("latitude").alias("at_lat"), F.col("longitude").alias("at_lon"), F.col("zone" if kind == "station" else "school_type").alias("detail"))
        near = spatial.nearest_place(here, named, ["name", "at_lat", "at_lon", "detail"])
        one = F.struct(F.lit(kind).alias("type"), "name", F.col("at_lat").alias("latitude"), F.col("at_lon").alias("longitude"), F.col("km").alias("distance_km"), F.lit(label).alias("label"), detail.alias("detail"))
        found = found.join(near.select("id", one.alias(kind)), "id", "left")
    return found.select("id", F.array_compact(F.array("station", "school")).alias("amenities"))


def amenities(features: DataFrame) -> DataFrame:
    """id and its nearest station and school as a list, for a map."""
    one = lambda kind, name, km: F.when(F.col(name).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(km).alias("km")))
    both = F.array(one("station", "nearest_station_name", "nearest_station_distance_km"), one("school", "nearest_school_name", "nearest_school_distance_km"))
    return features.select("id", F.array_compact(both).alias("amenities"))
