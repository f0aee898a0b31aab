"""The whole run: certificates and sales to features, features to estimates."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.comparables import comparable_estimates
from ..operators.enrichment import area_of_postcode, attach_crime, attach_index, crime_by_area, crime_levels, sector_averages
from ..operators.matching import match_sales
from ..operators.spatial import nearest_place, school_summary
from ..operators.valuation import estimates
from ..sources.tables import staged
from .proxies import AS_OF, proxy, wide_crime


def base_features(certificates: DataFrame, sales: DataFrame) -> DataFrame:
    """Dwellings with their matched sale: the match decides, even where its price is null."""
    matched = match_sales(certificates, sales).join(sales.select("sale_id", "price", "transfer_date"), "sale_id", "left")
    rows = certificates.join(matched.select("id", "price", "transfer_date", "match_kind"), "id", "left")
    return rows.withColumn("postcode_sector", T.postcode_sector(F.col("postcode"))).withColumnsRenamed({"price": "last_sold_price", "transfer_date": "last_transfer_date"})


def enriched_features(base: DataFrame, stations: DataFrame, schools: DataFrame, hospitals: DataFrame, postcode_areas: DataFrame, crime: DataFrame, series: DataFrame, as_of: datetime.date) -> DataFrame:
    """Places, crime, index and sector averages, all by left joins on the dwelling."""
    station = nearest_place(base, stations, ["name", "zone"]).selectExpr("id", "name AS nearest_station_name", "zone AS nearest_station_zone", "km AS nearest_station_distance_km")
    hospital = nearest_place(base, hospitals, ["name"]).selectExpr("id", "name AS nearest_hospital_name", "km AS nearest_hospital_distance_km")
    rows = base.join(station, "id", "left").join(school_summary(base, schools), "id", "left").join(hospital, "id", "left")
    rows = attach_index(attach_crime(rows, postcode_areas, crime), series)
    return rows.join(sector_averages(base, as_of), "postcode_sector", "left")


def proxy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all dwellings from all sales, schools, hospitals and crimes of the proxy views."""
    props = proxy(spark, sf_dir, "props")
    none = F.lit(None).cast("string")
    certificates = props.select("*", T.clean_postcode(F.col("postcode")).alias("postcode_clean"), none.alias("address1"), none.alias("house_number"), F.col("address").alias("full_address"), F.element_at(F.array(*map(F.lit, "ABCDEFG")), (F.col("id") % 7 + 1).cast("int")).alias("epc_rating"))
    full = T.full_address(F.col("saon"), F.col("paon"), F.col("street"), F.col("postcode"))
    sales = proxy(spark, sf_dir, "sales").select("sale_id", T.clean_postcode(F.col("postcode")).alias("postcode_clean"), F.col("paon").alias("house_number"), none.alias("building_name"), F.col("saon").alias("unit"), "street", full.alias("full_address"), "price", "transfer_date")
    stations, schools, hospitals = proxy(spark, sf_dir, "stations").withColumn("zone", F.lit("1")), proxy(spark, sf_dir, "schools"), proxy(spark, sf_dir, "hospitals")
    month = proxy(spark, sf_dir, "hpi")
    day = F.to_date(F.concat("month_key", F.lit("-01")))
    series = month.select(day.alias("day"), "month_key", F.explode(F.array(F.lit("HOUSE"), F.lit("FLAT"))).alias("index_type"), "idx", F.lit(None).cast("double").alias("annual_change"))
    areas = area_of_postcode(props.select(F.col("postcode").alias("pcd"), (F.col("id") % 120).cast("string").alias("lsoa11"), F.col("id").alias("ord")))
    crime = crime_levels(crime_by_area(wide_crime(spark, sf_dir)))
    base = staged(base_features(certificates, sales), "base")
    return enriched_features(base, stations, schools, hospitals, areas, crime, series, AS_OF)


def value_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over the proxy views."""
    features = staged(proxy_features(spark, sf_dir), "features")
    return estimates(features, comparable_estimates(features), AS_OF)
