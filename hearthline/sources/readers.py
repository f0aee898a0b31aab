"""Raw files to tables. All reads name their columns and types; nothing is inferred.

Where the first or last of equal keys is kept, rows carry `ord`: file, block of the
file, then place in the block, however Spark packs files into partitions. Ids follow
that order and are given once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..functions.numbers import to_double, to_long
from ..operators import enrichment
from .tables import staged

#: Authority codes of the capital's 33 boroughs, E09000001 to E09000033.
AUTHORITIES = tuple(f"E090000{n:02d}" for n in range(1, 34))
#: Names under which hospital files give their columns.
HOSPITAL_NAMES = {"name": ("hospital", "name", "site name", "organisationname"), "latitude": ("latitude", "lat"), "longitude": ("longitude", "lon", "lng"), "postcode": ("postcode",)}
LEAST_STATIONS = 50


def _strings(spark: SparkSession, path, columns: Sequence[str], header: bool = True, **options) -> DataFrame:
    """Columns by name, in any order, all text, and ord; columns not asked for are not parsed further."""
    reader = spark.read.options(header=header, enforceSchema=False, **options)
    return with_order(reader.csv(path)).select(*[F.col(f"`{c}`") for c in columns], "ord")


def with_order(df: DataFrame) -> DataFrame:
    """ord: the order of arrival."""
    return df.withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")))


def with_ids(df: DataFrame, column: str) -> DataFrame:
    """A number for each row, in the order of arrival; written down, so that it stays the same."""
    return staged(df.sort("ord").withColumn(column, F.monotonically_increasing_id()), column)


def latest_of(df: DataFrame, key: str, *by: Column | str) -> DataFrame:
    """The row of each key that comes last by the given order."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("x")).select(key, "x.*")


def of_the_capital(df: DataFrame) -> DataFrame:
    return df.where(F.col("oslaua").isin(*AUTHORITIES))


def of_postcodes(df: DataFrame, postcodes: DataFrame) -> DataFrame:
    """The rows whose postcode_clean is among the postcodes."""
    return df.join(postcodes.select("postcode_clean"), "postcode_clean", "left_semi")


def with_coordinates(df: DataFrame, postcodes: DataFrame, how: str = "left") -> DataFrame:
    """latitude and longitude of each row's postcode."""
    return df.join(postcodes.select("postcode_clean", "latitude", "longitude"), "postcode_clean", how)


def first_of(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key; null is a key like any other."""
    columns = [c for c in df.columns if c not in (key, "ord")]
    kept = df.groupBy(key).agg(F.min_by(F.struct(*columns), "ord").alias("x"), F.min("ord").alias("ord"))
    return kept.select(key, "x.*", "ord")


def read_postcodes(spark: SparkSession, path: str, prefixes: Sequence[str] = ()) -> DataFrame:
    """The capital's postcodes with coordinates, first of each, of the wanted prefixes."""
    raw = with_order(spark.read.option("header", True).csv(path))
    rows = of_the_capital(raw).select(
        F.col("pcd").alias("postcode"),
        F.col("pcds").alias("postcode_with_space"),
        T.clean_postcode(F.col("pcd")).alias("postcode_clean"),
        F.col("oslaua").alias("local_authority_code"),
        to_double(F.col("lat")).alias("latitude"),
        to_double(F.col("long")).alias("longitude"),
        "ord",
    )
    found = first_of(rows, "postcode_clean")
    return found.where(T.any_prefix(F.col("postcode_clean"), prefixes)) if prefixes else found


def read_sales(spark: SparkSession, path, allowed: DataFrame) -> DataFrame:
    """Sold prices of allowed postcodes (postcode_clean): current records, the first of each transaction."""
    raw = with_order(spark.read.schema(schemas.RAW_SALES).csv(path))
    current = raw.where(F.upper(F.coalesce("record_status", F.lit(""))) == "A").withColumn("postcode_clean", T.clean_postcode(F.col("postcode")))
    near = of_postcodes(current, allowed)
    house, building = T.house_number_of_primary_name(F.col("paon")), T.building_of_primary_name(F.col("paon"))
    plain = [T.clean_text(F.col(c)).alias(c) for c in ("transaction_id", "postcode", "street", "locality", "town_city", "district", "county", "property_type", "new_build_flag", "tenure", "transfer_date")]
    rows = near.select(
        "postcode_clean",
        *plain,
        house.alias("house_number"),
        building.alias("building_name"),
        T.clean_text(F.col("saon")).alias("unit"),
        T.or_null(T.full_address(*map(F.col, ("saon", "paon", "street", "locality", "town_city", "postcode")))).alias("full_address"),
        to_long(F.col("price")).alias("price"),
        "ord",
    )
    return first_of(rows.where("price is not null"), "transaction_id")


def read_certificates(spark: SparkSession, path: str, postcodes: DataFrame) -> DataFrame:
    """Energy certificates under a folder, the latest of each address (the later
    arrival wins ties), with their postcode's coordinates."""
    raw = _strings(spark, path, schemas.RAW_CERTIFICATES, recursiveFileLookup=True, pathGlobFilter="*.[cC][sS][vV]")
    c = lambda name: T.clean_text(F.col(name))
    address = F.coalesce(c("ADDRESS"), c("ADDRESS1"))
    rows = raw.select(
        c("POSTCODE").alias("postcode"),
        T.clean_postcode(F.col("POSTCODE")).alias("postcode_clean"),
        c("ADDRESS1").alias("address1"),
        address.alias("address"),
        c("POSTTOWN").alias("posttown"),
        c("LOCAL_AUTHORITY_LABEL").alias("local_authority"),
        T.or_null(T.full_address(address, F.col("POSTTOWN"), F.col("POSTCODE"))).alias("full_address"),
        T.house_number_of_address(address).alias("house_number"),
        c("CURRENT_ENERGY_RATING").alias("epc_rating"),
        to_double(F.col("TOTAL_FLOOR_AREA")).alias("floor_area"),
        to_double(F.col("CURRENT_ENERGY_EFFICIENCY")).alias("energy_efficiency"),
        c("BUILT_FORM").alias("built_form"),
        c("PROPERTY_TYPE").alias("property_subtype"),
        c("LODGEMENT_DATE").alias("lodgement_date"),
        "ord",
    )
    near = of_postcodes(rows, postcodes).where("full_address is not null")
    latest = latest_of(near, "full_address", F.coalesce("lodgement_date", F.lit("")), F.col("ord"))
    return with_coordinates(latest, postcodes)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """src_ord, name, zone and coordinates; nothing at all where fewer than LEAST_STATIONS are usable."""
    raw = _strings(spark, path, ["Station", "Latitude", "Longitude", "Zone"])
    zone = T.clean_text(F.col("Zone"))
    whole = F.regexp_replace(zone, r"^(\d+)\.0$", "$1")
    rows = raw.select(F.col("ord").alias("src_ord"), T.clean_text(F.col("Station")).alias("name"), whole.alias("zone"), to_double(F.col("Latitude")).alias("latitude"), to_double(F.col("Longitude")).alias("longitude"))
    usable = rows.where("name is not null and latitude is not null and longitude is not null")
    return usable if usable.limit(LEAST_STATIONS).count() == LEAST_STATIONS else usable.where("false")


def read_schools(spark: SparkSession, path: str, postcodes: DataFrame) -> DataFrame:
    """Open schools of the capital at their postcode's coordinates."""
    raw = _strings(spark, path, ["EstablishmentName", "PhaseOfEducation (name)", "Postcode", "EstablishmentStatus (name)", "GOR (name)"], encoding="ISO-8859-1")
    is_ = lambda c, v: F.upper(F.trim(f"`{c}`")) == v
    rows = raw.where(is_("EstablishmentStatus (name)", "OPEN") & is_("GOR (name)", "LONDON")).select(
        F.col("ord").alias("src_ord"), T.clean_text(F.col("EstablishmentName")).alias("name"), T.school_type(F.col("`PhaseOfEducation (name)`")).alias("school_type"), T.clean_postcode(F.col("Postcode")).alias("postcode_clean")
    )
    return with_coordinates(rows.where("name is not null"), postcodes, "inner")


def read_hospitals(spark: SparkSession, path: str, postcodes: DataFrame) -> DataFrame:
    """Hospitals under any of their column names; where either coordinate lacks, both are the postcode's."""
    raw = with_order(spark.read.option("header", True).csv(path))
    by_name = {c.strip().lower(): c for c in raw.columns}
    column = {k: next((F.col(f"`{by_name[n]}`") for n in names if n in by_name), F.lit(None).cast("string")) for k, names in HOSPITAL_NAMES.items()}
    rows = raw.select(F.col("ord").alias("src_ord"), T.clean_text(column["name"]).alias("name"), T.clean_postcode(column["postcode"]).alias("postcode_clean"), to_double(column["latitude"]).alias("own_lat"), to_double(column["longitude"]).alias("own_lon"))
    joined = with_coordinates(rows.where("name is not null"), postcodes)
    own: Column = F.col("own_lat").isNotNull() & F.col("own_lon").isNotNull()
    placed = joined.select("src_ord", "name", F.when(own, F.col("own_lat")).otherwise(F.col("latitude")).alias("latitude"), F.when(own, F.col("own_lon")).otherwise(F.col("longitude")).alias("longitude"))
    return placed.where("latitude is not null and longitude is not null")


def read_crime(spark: SparkSession, path: str) -> DataFrame:
    return enrichment.crime_levels(enrichment.crime_by_area(spark.read.option("header", True).csv(path)))


def read_postcode_areas(spark: SparkSession, path: str) -> DataFrame:
    return enrichment.area_of_postcode(_strings(spark, path, ["pcd", "lsoa11"]))


def read_price_index(spark: SparkSession, path: str) -> DataFrame:
    return enrichment.price_index(_strings(spark, path, ["Date", "RegionName", "Index", "FlatIndex", "12m%Change"]))


def training_rows(features: DataFrame, most: float = 50_000_000) -> DataFrame:
    """Sold dwellings that a model may learn from."""
    price = F.col("indexed_last_sold_price")
    return features.where((price > 50_000) & (price < max(1_000_000, most)) & (F.col("floor_area") > 10) & (F.col("floor_area") < 2000))
