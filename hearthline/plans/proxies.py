"""Views over the star-schema tables that stand in for the property data. Both
Spark and DuckDB take these texts as they are; {braces} name the tables."""

from __future__ import annotations

import datetime
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, write_ordered_csv

AS_OF = datetime.date(2001, 8, 1)

#: A postcode: of 63 sectors, and within them one more for every 500 customers, so that a postcode doesn't grow with the data.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LAST = f"substr('{_LETTERS}', CAST(floor(c_custkey / 500) AS INT) % 26 + 1, 1), substr('{_LETTERS[1:]}A', CAST(floor(c_custkey / 13000) AS INT) % 26 + 1, 1)"
_SECTOR = f"concat('SW', CAST(c_nationkey % 9 + 1 AS STRING), ' ', CAST(c_custkey % 7 AS STRING), {_LAST})"
_HOUSE = "CAST(c_custkey % 40 + 1 AS STRING), CASE c_custkey % 2 WHEN 0 THEN ', ' ELSE ' ' END"

PROXIES: dict[str, str] = {
    # dwellings and their certificates
    "props": f"""
        SELECT c_custkey AS id, {_SECTOR} AS postcode,
          CASE c_custkey % 3
            WHEN 0 THEN concat('Flat ', CAST(c_custkey % 5 + 1 AS STRING), ', ', {_HOUSE}, 'High St')
            WHEN 1 THEN concat('Ground Floor Flat, ', {_HOUSE}, 'Park Rd')
            ELSE concat({_HOUSE}, 'Kings Ave') END AS address,
          CAST(20 + c_custkey * 13 % 180 AS DOUBLE) AS floor_area, c_mktsegment AS property_subtype,
          CAST(51.40 AS DOUBLE) + CAST(c_custkey * 37 % 200 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
          CAST(-0.30 AS DOUBLE) + CAST(c_custkey * 53 % 300 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude
        FROM {{customer}}""",
    # sales; one house number in eleven is shifted
    "sales": f"""
        SELECT o_orderkey AS sale_id, o_totalprice AS price, CAST(CAST(o_orderdate AS DATE) AS STRING) AS transfer_date,
          {_SECTOR} AS postcode,
          CASE c_custkey % 3 WHEN 0 THEN concat('FLAT ', CAST(c_custkey % 5 + 1 AS STRING)) WHEN 1 THEN 'GROUND FLOOR FLAT' END AS saon,
          CAST(c_custkey % 40 + 1 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS STRING) AS paon,
          CASE c_custkey % 3 WHEN 0 THEN 'HIGH STREET' WHEN 1 THEN 'PARK ROAD' ELSE 'KINGS AVENUE' END AS street
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "stations": """
        SELECT s_suppkey AS src_ord, s_name AS name,
          CAST(51.40 AS DOUBLE) + CAST(s_suppkey * 71 % 200 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
          CAST(-0.30 AS DOUBLE) + CAST(s_suppkey * 97 % 300 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude
        FROM {supplier}""",
    "schools": """
        SELECT p_partkey AS src_ord, p_name AS name,
          CASE p_size % 3 WHEN 0 THEN 'PRIMARY' WHEN 1 THEN 'SECONDARY' ELSE 'OTHER' END AS school_type,
          CAST(51.40 AS DOUBLE) + CAST(p_partkey * 29 % 200 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
          CAST(-0.30 AS DOUBLE) + CAST(p_partkey * 43 % 300 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude
        FROM {part}""",
    # raw files, with what the readers have to clear up
    "raw_postcodes": f"""
        SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN lower({_SECTOR}) ELSE {_SECTOR} END AS pcd, {_SECTOR} AS pcds,
          concat('E090000', lpad(CAST(c_custkey % 40 + 1 AS STRING), 2, '0')) AS oslaua,
          CASE WHEN c_custkey % 9 = 0 THEN 'none' ELSE concat('51.', CAST(400 + c_custkey * 37 % 200 AS STRING)) END AS lat,
          concat('-0.', CAST(100 + c_custkey * 53 % 300 AS STRING)) AS long,
          CASE WHEN c_custkey % 6 = 0 THEN ' ' WHEN c_custkey % 6 = 1 THEN 'nan' ELSE concat('E010', CAST(c_custkey % 120 AS STRING)) END AS lsoa11
        FROM {{customer}}""",
    "raw_sales": f"""
        SELECT concat('T', CAST(floor(o_orderkey / 2) AS BIGINT)) AS transaction_id,
          CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE concat(CAST(100000 + o_orderkey % 900000 AS STRING), '.7') END AS price,
          CAST(CAST(o_orderdate AS DATE) AS STRING) AS transfer_date, lower({_SECTOR}) AS postcode, 'F' AS property_type, 'N' AS new_build_flag,
          'L' AS tenure, CASE WHEN o_orderkey % 19 = 0 THEN 'TOWER HOUSE' WHEN o_orderkey % 19 = 1 THEN '14A, THE MEWS' ELSE CAST(c_custkey % 40 + 1 AS STRING) END AS paon,
          CASE WHEN c_custkey % 3 = 0 THEN concat('FLAT ', CAST(c_custkey % 5 + 1 AS STRING)) ELSE '' END AS saon, 'HIGH STREET' AS street, ' ' AS locality,
          'LONDON' AS town_city, 'D' AS district, 'C' AS county, 'A' AS ppd_category, CASE WHEN o_orderkey % 13 = 0 THEN 'D' ELSE 'a' END AS record_status, o_orderkey AS id
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "raw_certificates": f"""
        SELECT o_orderkey AS id, {_SECTOR} AS POSTCODE, concat('Flat ', CAST(c_custkey % 5 + 1 AS STRING), ', ', CAST(c_custkey % 40 + 1 AS STRING), ' High St') AS ADDRESS1,
          CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(CAST(c_custkey % 40 + 1 AS STRING), ' Park Rd') END AS ADDRESS, 'LONDON' AS POSTTOWN, 'Here' AS LOCAL_AUTHORITY_LABEL,
          CASE WHEN o_orderkey % 3 = 0 THEN 'B' ELSE 'D' END AS CURRENT_ENERGY_RATING, CASE WHEN o_orderkey % 7 = 0 THEN 'NO DATA' ELSE CAST(20 + o_orderkey % 180 AS STRING) END AS TOTAL_FLOOR_AREA,
          '70' AS CURRENT_ENERGY_EFFICIENCY, 'Detached' AS BUILT_FORM, 'Flat' AS PROPERTY_TYPE, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS LODGEMENT_DATE
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "raw_stations": """
        SELECT s_suppkey AS id, CASE WHEN s_suppkey % 20 = 0 THEN ' ' ELSE concat(' ', s_name) END AS "Station", concat('51.', CAST(400 + s_suppkey * 71 % 200 AS STRING)) AS "Latitude",
          CASE WHEN s_suppkey % 30 = 7 THEN 'east' ELSE concat('-0.', CAST(100 + s_suppkey * 97 % 300 AS STRING)) END AS "Longitude", concat(CAST(s_suppkey % 6 + 1 AS STRING), CASE WHEN s_suppkey % 2 = 0 THEN '.0' ELSE '' END) AS "Zone"
        FROM {supplier}""",
    "raw_schools": f"""
        SELECT p_partkey AS id, p_name AS "EstablishmentName", CASE p_size % 4 WHEN 0 THEN 'Primary' WHEN 1 THEN 'Middle deemed secondary' WHEN 2 THEN 'Nursery' ELSE 'All-through primary' END AS "PhaseOfEducation (name)",
          concat('SW', CAST(p_partkey % 9 + 1 AS STRING), ' ', CAST(p_partkey % 8 AS STRING), 'ab') AS "Postcode",
          CASE WHEN p_partkey % 5 = 0 THEN 'Closed' ELSE ' open' END AS "EstablishmentStatus (name)", CASE WHEN p_partkey % 7 = 0 THEN 'South East' ELSE 'London' END AS "GOR (name)"
        FROM {{part}}""",
    "raw_hospitals": """
        SELECT s_suppkey AS id, concat('Hospital of ', s_name) AS "Site Name", CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('51.', CAST(400 + s_suppkey * 113 % 200 AS STRING)) END AS "LAT",
          concat('-0.', CAST(100 + s_suppkey * 59 % 300 AS STRING)) AS "lng", concat('sw', CAST(s_suppkey % 9 + 1 AS STRING), CAST(s_suppkey % 8 AS STRING), 'ab') AS "Postcode"
        FROM {supplier}""",
    # hospitals, at other places than the stations
    "hospitals": """
        SELECT s_suppkey AS src_ord, concat('Hospital of ', s_name) AS name,
          CAST(51.40 AS DOUBLE) + CAST(s_suppkey * 113 % 200 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
          CAST(-0.30 AS DOUBLE) + CAST(s_suppkey * 59 % 300 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude
        FROM {supplier}""",
    "hpi": """
        SELECT concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS month_key,
          round(avg(o_totalprice), 4) AS idx
        FROM {orders} GROUP BY 1""",
    "crime": """
        SELECT l_suppkey AS lsoa, year(l_shipdate) * 100 + month(l_shipdate) AS ym, count(*) AS crimes
        FROM {lineitem} GROUP BY 1, 2""",
    # dwellings with the columns that valuation reads, some of them missing in turn
    "valued": """
        SELECT o_orderkey AS id,
          CASE WHEN o_orderkey % 7 <> 0 THEN CAST(20 + o_orderkey * 13 % 180 AS DOUBLE) END AS floor_area,
          CASE WHEN o_orderkey % 5 <> 0 THEN CAST(1000 + o_orderkey * 17 % 9000 AS DOUBLE) END AS postcode_average_per_sqm,
          CASE WHEN o_orderkey % 11 <> 0 THEN CAST(100000 + o_orderkey * 101 % 900000 AS DOUBLE) END AS postcode_average_price,
          CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS last_sold_price,
          CASE WHEN o_orderkey % 6 IN (1, 2) THEN o_totalprice * CAST(1.25 AS DOUBLE) END AS indexed_last_sold_price,
          CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS last_transfer_date,
          CASE WHEN o_orderkey % 4 = 0 THEN CAST(120000 + o_orderkey * 29 % 700000 AS DOUBLE) END AS comparable,
          CASE o_orderkey % 9 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'F' WHEN 3 THEN 'G' WHEN 4 THEN NULL ELSE 'D' END AS epc_rating,
          CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 30 AS DOUBLE) / CAST(10 AS DOUBLE) END AS nearest_station_distance_km,
          CAST(o_orderkey % 5 AS INT) AS nearby_primary_schools_1km, CAST(o_orderkey % 4 AS INT) AS nearby_secondary_schools_2km,
          CASE o_orderkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'AVERAGE' END AS crime_level,
          CAST(o_orderkey * 31 % 1000000 AS DOUBLE) - CAST(1000 AS DOUBLE) AS ml_prediction,
          CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey % 97 AS DOUBLE) / CAST(97 AS DOUBLE) END AS ml_confidence
        FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proxy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = PROXIES[name].replace('"', "`")
    tables = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def proxy_sql(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", PROXIES[name])


def with_proxies(names: str, body: str) -> str:
    """SQL in which the named proxies are common tables."""
    views = ", ".join(f"{n} AS ({proxy_sql(n)})" for n in names.split())
    return f"WITH {views}{', ' if body.lstrip().startswith(',') else ' '}{body.lstrip().lstrip(',')}"


def wide_crime(spark, sf_dir) -> DataFrame:
    """Monthly counts in one column each, as the raw file has them."""
    crime = proxy(spark, sf_dir, "crime")
    months = [str(r["ym"]) for r in crime.select("ym").distinct().collect()]  # calendar months
    wide = crime.groupBy(F.col("lsoa").cast("string").alias("LSOA Code"), F.concat(F.lit("Area "), F.col("lsoa")).alias("LSOA Name"))
    return wide.pivot("ym", [int(m) for m in sorted(months)]).agg(F.sum("crimes"))


def raw_file(spark: SparkSession, sf_dir: str, name: str, folder: str | None = None, header: bool = True) -> str:
    """Raw files made of a view, ordered so that rows arrive in the order of their ids; their folder."""
    path = folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write_ordered_csv(proxy(spark, sf_dir, name), path, "id", header=header)
    return path
