"""The registered queries over the reference operators and, for each, DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import EngineConfig
from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..operators import comparables, enrichment, learning, matching, spatial, trees, valuation
from ..sources import readers, tables
from . import api
from .training import NEIGHBOURS
from . import oracle_text as O
from .proxies import AS_OF, proxy, raw_file, table, wide_crime, with_proxies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PREFIXES = ("SW3", "SW5", "SW7")


def query(sql: str | None):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


# --- recency and averages -------------------------------------------------------

_DAYS = "date_diff('day', CAST(transfer_date AS DATE), DATE '2001-08-01')"
_AVG_W = f"CASE WHEN {_DAYS} <= 365 THEN 1.0::DOUBLE WHEN {_DAYS} <= 1095 THEN 0.7::DOUBLE WHEN {_DAYS} <= 1825 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END"


def _sale_w(days: str) -> str:
    return f"CASE WHEN {days} <= 365 THEN 0.9::DOUBLE WHEN {days} <= 1095 THEN 0.85::DOUBLE WHEN {days} <= 1825 THEN 0.8::DOUBLE WHEN {days} <= 2920 THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END"


def _sold_dwellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as dwellings with a sector and an area."""
    sales = proxy(spark, sf_dir, "sales")
    return sales.select("sale_id", T.postcode_sector(F.col("postcode")).alias("postcode_sector"), F.col("price").alias("last_sold_price"), F.col("transfer_date").alias("last_transfer_date"), (F.lit(20.0) + F.col("sale_id") * 13 % 180).alias("floor_area"))


_AVERAGES = f", s AS (SELECT {O.sector('postcode')} AS postcode_sector, price, {_AVG_W} AS w, CAST(20 + sale_id * 13 % 180 AS DOUBLE) AS area FROM sales) SELECT postcode_sector, "


@query(with_proxies("sales", _AVERAGES + "round(sum(price * w) / sum(w), 6) AS average_price FROM s WHERE postcode_sector IS NOT NULL GROUP BY 1"))
def agg6_weighted_sector_avg(spark, sf_dir):
    found = enrichment.sector_averages(_sold_dwellings(spark, sf_dir), AS_OF)
    return found.select("postcode_sector", _r(F.col("postcode_average_price")).alias("average_price"))


@query(with_proxies("sales", _AVERAGES + "round(sum(price / area * w) / sum(w), 6) AS average_per_sqm FROM s WHERE postcode_sector IS NOT NULL GROUP BY 1"))
def agg7_weighted_per_unit(spark, sf_dir):
    found = enrichment.sector_averages(_sold_dwellings(spark, sf_dir), AS_OF)
    return found.select("postcode_sector", _r(F.col("postcode_average_per_sqm")).alias("average_per_sqm"))


@query(with_proxies("sales", f"SELECT {_sale_w(_DAYS)} AS weight, count(*) AS n, min({_DAYS}) AS youngest, max({_DAYS}) AS oldest FROM sales GROUP BY 1"))
def dat2_recency_bands(spark, sf_dir):
    s = proxy(spark, sf_dir, "sales")
    d = D.days_old(F.col("transfer_date"), AS_OF).cast("long")
    return s.groupBy(D.sale_recency_weight(F.col("transfer_date"), AS_OF).alias("weight")).agg(F.count("*").alias("n"), F.min(d).alias("youngest"), F.max(d).alias("oldest"))


@query(with_proxies("sales", f"SELECT {_AVG_W} AS weight, count(*) AS n FROM sales GROUP BY 1"))
def dat3_average_recency_bands(spark, sf_dir):
    return proxy(spark, sf_dir, "sales").groupBy(D.average_recency_weight(F.col("transfer_date"), AS_OF).alias("weight")).agg(F.count("*").alias("n"))


@query(with_proxies("sales", f"SELECT sale_id, least(0.85::DOUBLE, greatest(0.65::DOUBLE, {_sale_w(_DAYS)})) AS weight FROM sales"))
def dat4_clamp(spark, sf_dir):
    return proxy(spark, sf_dir, "sales").select("sale_id", D.anchor_weight(F.col("transfer_date"), AS_OF).alias("weight"))


@query(with_proxies("sales", "SELECT left(transfer_date, 7) AS month_key, left(transfer_date, 10) AS first_key, count(*) AS n FROM sales GROUP BY 1, 2"))
def dat5_month_keys(spark, sf_dir):
    s = proxy(spark, sf_dir, "sales")
    return s.groupBy(D.month_key(F.col("transfer_date")).alias("month_key"), D.date_key(F.col("transfer_date")).alias("first_key")).agg(F.count("*").alias("n"))


# --- text -----------------------------------------------------------------------


def _texts(name: str, spark_text: Callable[[Column], Column], sql_text: Callable[[str], str], wrap: str = "address") -> None:
    """A query that applies one text function to every dwelling's address."""

    def run(spark, sf_dir):
        return proxy(spark, sf_dir, "props").select("id", spark_text(F.expr(wrap)).alias("value"))

    run.__name__ = name
    query(with_proxies("props", f", a AS (SELECT id, {wrap} AS x FROM props) SELECT id, {sql_text('x')} AS value FROM a"))(run)


_texts("str1_clean", T.clean_text, O.clean, "CASE WHEN id % 5 = 0 THEN '   ' ELSE concat('  ', address, ' ') END")
_texts("str2_clean_postcode", T.clean_postcode, lambda x: f"upper(replace({O.clean(x)}, ' ', ''))", "concat(' ', lower(postcode), ' ')")
_texts("str4_normalize", T.normalize_text, O.normalize, "concat(address, ' & St. James''s Sq')")
_texts("str5_house_number", T.normalize_house_number, lambda x: f"replace({O.normalize(x)}, ' ', '')", "concat(CAST(id % 40 AS STRING), ' - ', CAST(id % 7 AS STRING), 'a')")
_texts("str6_unit", T.extract_unit, lambda x: O.unit_of_normalized(O.normalize(x)))
_texts("str7_strip", T.strip_unit, lambda x: O.strip_normalized(O.normalize(x)), "CASE WHEN id % 4 = 0 THEN concat(address, ', Flat 9') ELSE address END")
_texts("str8_house_number_of_address", T.house_number_of_address, lambda x: O.house_of_normalized(O.normalize(x)), "CASE WHEN id % 6 = 0 THEN 'Flat 3' WHEN id % 6 = 1 THEN 'The Tower' ELSE address END")
_texts("str9_last_part", T.last_address_part, O.last_part, "concat(address, CASE WHEN id % 3 = 0 THEN ' , ' ELSE ', London' END)")
_texts("str10_building", T.building_name, lambda x: f"CASE WHEN NOT regexp_matches({O.strip_normalized(O.normalize(f'string_split({O.clean(x)}, chr(44))[1]'))}, '[0-9]') THEN {O.normalize(O.strip_normalized(O.normalize(f'string_split({O.clean(x)}, chr(44))[1]')))} END", "concat(CASE WHEN id % 2 = 0 THEN 'Flat 2 Tower Ct, ' ELSE '12 Tower Ct, ' END, address)")
_texts("str13_primary_house_number", T.house_number_of_primary_name, lambda x: f"CASE WHEN regexp_matches(string_split_regex({O.clean(x)}, '\\s+')[1], '\\d') THEN trim(string_split_regex({O.clean(x)}, '\\s+')[1], ',') END", "CASE id % 3 WHEN 0 THEN concat(CAST(id AS STRING), ', - 14') WHEN 1 THEN 'The Tower' ELSE concat(CAST(id AS STRING), 'A') END")
_texts("str16_sector", T.postcode_sector, O.sector, "CASE id % 5 WHEN 0 THEN lower(replace(postcode, ' ', '')) WHEN 1 THEN 'ABC' WHEN 2 THEN concat(postcode, ' X') ELSE postcode END")
_texts("str18_client_postcode", T.client_postcode, lambda x: f"CASE WHEN length(upper(replace({O.clean(x)}, ' ', ''))) >= 5 AND regexp_matches(upper(replace({O.clean(x)}, ' ', '')), '[A-Z]{{1,2}}[0-9]') THEN left(upper(replace({O.clean(x)}, ' ', '')), length(replace({O.clean(x)}, ' ', '')) - 3) || ' ' || right(upper(replace({O.clean(x)}, ' ', '')), 3) END", "CASE WHEN id % 4 = 0 THEN 'W8' ELSE lower(postcode) END")
_texts("str19_index_type", T.index_type, lambda x: f"CASE WHEN regexp_matches(upper({x}), 'FLAT|MAISONETTE|APARTMENT') THEN 'FLAT' ELSE 'HOUSE' END")


@query(with_proxies("sales", f", s AS (SELECT sale_id, saon, paon, street, CASE WHEN sale_id % 4 = 0 THEN concat(paon, ' Tower Ct') WHEN sale_id % 4 = 1 THEN 'Tower Ct' END AS building FROM sales) SELECT sale_id, {O.normalize('''concat_ws(' ', saon, building, CASE WHEN building IS NULL OR NOT list_contains(string_split(''' + O.normalize('building') + ''', ' '), paon) THEN paon END, street)''')} AS core FROM s"))
def str12_core(spark, sf_dir):
    s = proxy(spark, sf_dir, "sales")
    building = F.expr("CASE WHEN sale_id % 4 = 0 THEN concat(paon, ' Tower Ct') WHEN sale_id % 4 = 1 THEN 'Tower Ct' END")
    return s.select("sale_id", T.sale_core(F.col("saon"), F.col("paon"), building, F.col("street")).alias("core"))


@query(with_proxies("valued", "SELECT id, CASE WHEN nearest_station_distance_km < 1 THEN concat(CAST(CAST(round_even(nearest_station_distance_km * 1000, 0) AS BIGINT) AS VARCHAR), ' m') WHEN nearest_station_distance_km IS NOT NULL THEN printf('%.2f km', nearest_station_distance_km) END AS said FROM valued"))
def str17_distance_text(spark, sf_dir):
    return proxy(spark, sf_dir, "valued").select("id", T.format_distance(F.col("nearest_station_distance_km")).alias("said"))


# --- latest and best of a key ------------------------------------------------------


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def win1_latest_per_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return readers.latest_of(orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("latest"))


@query(with_proxies("sales", ", s AS (SELECT sale_id, postcode, street, left(transfer_date, 7) AS month FROM sales), r AS (SELECT *, row_number() OVER (PARTITION BY postcode, street ORDER BY month DESC, sale_id DESC) AS n FROM s) SELECT postcode, street, sale_id FROM r WHERE n = 1"))
def win6_latest_tie_last(spark, sf_dir):
    s = proxy(spark, sf_dir, "sales").select("sale_id", F.col("postcode").alias("postcode_clean"), F.col("street").alias("core"), F.left("transfer_date", F.lit(7)).alias("dkey"))
    return matching.latest_sale_by_core(s).select(F.col("postcode_clean").alias("postcode"), F.col("core").alias("street"), F.col("exact_id").alias("sale_id"))


_SCORED = ", c AS (SELECT o_custkey AS id, o_orderkey AS sale_id, CAST(o_orderkey % 4 * 3 AS INT) AS score, CAST(year(o_orderdate) AS VARCHAR) AS dkey, CASE WHEN o_orderkey % 5 > 1 THEN 'one' WHEN o_orderkey % 5 = 1 THEN 'two' END AS full_address FROM orders)"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS id", "o_orderkey AS sale_id", "CAST(o_orderkey % 4 * 3 AS INT) AS score", "CAST(year(o_orderdate) AS STRING) AS dkey", "CASE WHEN o_orderkey % 5 > 1 THEN 'one' WHEN o_orderkey % 5 = 1 THEN 'two' END AS full_address")


@query("WITH " + _SCORED[2:] + ", r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, dkey DESC, sale_id) AS n FROM c) SELECT id, sale_id, score FROM r WHERE n = 1")
def win2_best_tie_first(spark, sf_dir):
    one_address = _scored(spark, sf_dir).withColumn("full_address", F.lit("one"))
    all_scores = one_address.withColumn("score", F.col("score") + matching.LEAST_SCORE)
    return matching.best_candidates(all_scores).withColumn("score", F.col("score") - matching.LEAST_SCORE)


@query("WITH " + _SCORED[2:] + ", b AS (SELECT *, max(score) OVER (PARTITION BY id) AS best FROM c) SELECT id, arg_max(sale_id, (dkey, -sale_id)) AS sale_id, max(best) AS score FROM b WHERE score = best GROUP BY id HAVING count(DISTINCT coalesce(full_address, 'x')) = 1 AND max(best) >= 5")
def win3_ambiguity(spark, sf_dir):
    return matching.best_candidates(_scored(spark, sf_dir))


# --- lookups ------------------------------------------------------------------------


@query(with_proxies("props sales", "SELECT sale_id FROM sales WHERE postcode IN (SELECT postcode FROM props WHERE starts_with(postcode, 'SW3') OR starts_with(postcode, 'SW5') OR starts_with(postcode, 'SW7'))"))
def jn1_semi(spark, sf_dir):
    keyed = lambda name: proxy(spark, sf_dir, name).withColumn("postcode_clean", T.clean_postcode(F.col("postcode")))
    allowed = keyed("props").where(T.any_prefix(F.col("postcode_clean"), PREFIXES))
    return readers.of_postcodes(keyed("sales"), allowed).select("sale_id")


@query(with_proxies("props", ", p AS (SELECT postcode, arg_min(latitude, id) AS lat FROM props WHERE NOT starts_with(postcode, 'SW9') GROUP BY 1) SELECT id, round(lat, 6) AS lat FROM props LEFT JOIN p USING (postcode)"))
def jn2_left_lookup(spark, sf_dir):
    props = proxy(spark, sf_dir, "props").withColumn("postcode_clean", T.clean_postcode(F.col("postcode")))
    directory = readers.first_of(props.where("postcode NOT LIKE 'SW9%'").select("postcode_clean", "latitude", "longitude", F.col("id").alias("ord")), "postcode_clean")
    return readers.with_coordinates(props.select("id", "postcode_clean"), directory).select("id", _r(F.col("latitude")).alias("lat"))


_CRIME = (
    ", m12 AS (SELECT DISTINCT ym FROM crime ORDER BY ym DESC LIMIT 12)"
    ", w AS (SELECT lsoa, coalesce(sum(crimes) FILTER (ym IN (FROM m12)), 0)::DOUBLE AS total FROM crime GROUP BY 1)"
)
_LEVELS = _CRIME + ", q AS (SELECT quantile_cont(total / 12, 0.33) AS low, quantile_cont(total / 12, 0.66) AS high FROM w), v AS (SELECT lsoa, total, total / 12 AS mean, CASE WHEN total / 12 <= low THEN 'LOW' WHEN total / 12 >= high THEN 'HIGH' ELSE 'AVERAGE' END AS level FROM w, q)"


@query(with_proxies("crime", _CRIME + " SELECT CAST(lsoa AS VARCHAR) AS area, total FROM w"))
def agg2_last12_sum(spark, sf_dir):
    found = enrichment.crime_by_area(wide_crime(spark, sf_dir))
    return found.select(F.col("crime_lsoa_code").alias("area"), F.col("crime_total_12m").alias("total"))


@query(with_proxies("crime", _LEVELS + " SELECT CAST(lsoa AS VARCHAR) AS area, round(mean, 6) AS mean, level FROM v"))
def agg4_quantile_bands(spark, sf_dir):
    found = enrichment.crime_levels(enrichment.crime_by_area(wide_crime(spark, sf_dir)))
    return found.select(F.col("crime_lsoa_code").alias("area"), _r(F.col("crime_avg_monthly_12m")).alias("mean"), F.col("crime_level").alias("level"))


@query(with_proxies("props crime", _LEVELS + ", m AS (SELECT postcode, max(CAST(id % 120 AS VARCHAR)) AS area FROM props WHERE id % 4 <> 0 GROUP BY 1) SELECT id, area, level FROM props LEFT JOIN m USING (postcode) LEFT JOIN v ON area = CAST(lsoa AS VARCHAR)"))
def jn5_two_hop(spark, sf_dir):
    props = proxy(spark, sf_dir, "props")
    raw = props.where("id % 4 <> 0").select(F.col("postcode").alias("pcd"), (F.col("id") % 120).cast("string").alias("lsoa11")).withColumn("ord", F.col("lsoa11"))
    areas = enrichment.area_of_postcode(raw)
    leveled = enrichment.crime_levels(enrichment.crime_by_area(wide_crime(spark, sf_dir)))
    keyed = props.withColumn("postcode_clean", T.clean_postcode(F.col("postcode")))
    return enrichment.attach_crime(keyed, areas, leveled).select("id", F.col("crime_lsoa_code").alias("area"), F.col("crime_level").alias("level"))


_INDEX = ", h AS (SELECT month_key, idx FROM hpi WHERE right(month_key, 2) <> '06'), cur AS (SELECT arg_max(idx, month_key) AS idx FROM h), j AS (SELECT s.sale_id, s.price, h.idx AS at_sale, cur.idx AS now FROM sales s LEFT JOIN h ON h.month_key = left(s.transfer_date, 7), cur)"


def _indexed(spark, sf_dir) -> DataFrame:
    """Monthly means as an index of houses and flats; one month of each year is missing."""
    raw = proxy(spark, sf_dir, "hpi").where("right(month_key, 2) <> '06'")
    day = F.concat(F.lit("01/"), F.right("month_key", F.lit(2)), F.lit("/"), F.left("month_key", F.lit(4)))
    raw = raw.select(day.alias("Date"), F.lit("London").alias("RegionName"), F.col("idx").alias("Index"), (F.col("idx") * 2).alias("FlatIndex"), F.lit(1.5).alias("12m%Change"))
    sales = proxy(spark, sf_dir, "sales").select("sale_id", F.col("price").alias("last_sold_price"), F.col("transfer_date").alias("last_transfer_date"), F.lit("House").alias("property_subtype"))
    return enrichment.attach_index(sales, enrichment.price_index(raw))


@query(with_proxies("sales hpi", _INDEX + " SELECT sale_id, at_sale FROM j"))
def jn6_composite_month(spark, sf_dir):
    return _indexed(spark, sf_dir).select("sale_id", F.col("london_hpi_at_last_sale").alias("at_sale"))


@query(with_proxies("sales hpi", _INDEX + " SELECT DISTINCT now AS current_index FROM j"))
def win7_latest_index(spark, sf_dir):
    return _indexed(spark, sf_dir).select(F.col("london_hpi_current_index").alias("current_index")).distinct()


@query(with_proxies("sales hpi", _INDEX + " SELECT sale_id, round(CASE WHEN at_sale > 0 THEN price * now / at_sale END, 4) AS indexed FROM j"))
def num10_indexing(spark, sf_dir):
    return _indexed(spark, sf_dir).select("sale_id", _r(F.col("indexed_last_sold_price"), 4).alias("indexed"))


# --- matching -------------------------------------------------------------------------


def _certificates(spark, sf_dir) -> DataFrame:
    return proxy(spark, sf_dir, "props").select("id", F.col("postcode").alias("postcode_clean"), "address", F.lit(None).cast("string").alias("address1"), F.lit(None).cast("string").alias("house_number"), F.col("address").alias("full_address"))


#: Some dwellings get a house number that no sale has, some another street: they are scored among all sales.
_MOVED = "CASE WHEN id % 12 IN (2, 5) THEN concat('9', address) WHEN id % 4 = 0 THEN concat(address, ' North') ELSE address END"


def _moved_certificates(spark, sf_dir) -> DataFrame:
    moved = F.expr(_MOVED)
    return _certificates(spark, sf_dir).withColumns({"address": moved, "full_address": moved})


def _all_sales(spark, sf_dir) -> DataFrame:
    """Every sale, with its full address as loaded."""
    full = T.full_address(F.col("saon"), F.col("paon"), F.col("street"), F.col("postcode"))
    return proxy(spark, sf_dir, "sales").select("sale_id", F.col("postcode").alias("postcode_clean"), F.col("paon").alias("house_number"), F.lit(None).cast("string").alias("building_name"), F.col("saon").alias("unit"), "street", full.alias("full_address"), "price", "transfer_date")


_MATCH = (
    f", d0 AS (SELECT id, postcode, address, {O.normalize('address')} AS n, {O.normalize(O.last_part('address'))} AS street, {O.normalize('string_split(address, chr(44))[1]')} AS f FROM props)"
    f", d AS (SELECT id, postcode, n AS core, {O.unit_of_normalized('n')} AS unit, {O.house_of_normalized('n')} AS house, street, CASE WHEN NOT regexp_matches({O.strip_normalized('f')}, '[0-9]') THEN {O.normalize(O.strip_normalized('f'))} END AS building FROM d0)"
    f", s AS (SELECT sale_id, postcode, concat_ws(', ', saon, paon, street, postcode) AS addr, transfer_date AS dkey, {O.normalize('''concat_ws(' ', saon, paon, street)''')} AS core, saon AS unit, paon AS house, street FROM sales)"
    ", e AS (SELECT d.id, arg_max(s.sale_id, (s.dkey, s.sale_id)) AS sale_id FROM d JOIN s ON d.postcode = s.postcode AND d.core = s.core GROUP BY 1)"
    ", rest AS (SELECT * FROM d WHERE id NOT IN (SELECT id FROM e))"
    ", pool AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.postcode = r.postcode AND s.unit = r.unit) THEN 'U' WHEN EXISTS (SELECT 1 FROM s WHERE s.postcode = r.postcode AND s.house = r.house) THEN 'H' ELSE 'P' END AS pool FROM rest r)"
)
_PICK = (
    ", cand AS (SELECT p.id, s.sale_id, s.addr, s.dkey, "
    "CASE WHEN p.unit = s.unit THEN 6 WHEN p.unit IS NOT NULL AND s.unit IS NOT NULL THEN -4 ELSE 0 END + CASE WHEN p.house = s.house THEN 5 WHEN p.house IS NOT NULL AND s.house IS NOT NULL THEN -3 ELSE 0 END + CASE WHEN p.street = s.street THEN 3 WHEN p.street IS NOT NULL AND s.street IS NOT NULL THEN -1 ELSE 0 END AS score "
    "FROM pool p JOIN s ON p.postcode = s.postcode AND (p.pool = 'P' OR (p.pool = 'U' AND p.unit = s.unit) OR (p.pool = 'H' AND p.house = s.house)))"
    ", top AS (SELECT *, max(score) OVER (PARTITION BY id) AS best FROM cand)"
    ", m AS (SELECT id, arg_max(sale_id, (dkey, -sale_id)) AS sale_id FROM top WHERE score = best GROUP BY id HAVING max(best) >= 5 AND count(DISTINCT addr) = 1)"
)


_MATCH_ALL = f", moved AS (SELECT id, postcode, {_MOVED} AS address FROM props)" + _MATCH.replace("FROM props)", "FROM moved)")


def _exact(certificates: DataFrame, sales: DataFrame) -> DataFrame:
    dwellings, sold = matching.describe_dwellings(certificates), matching.describe_sales(sales)
    return dwellings.join(matching.latest_sale_by_core(sold), ["postcode_clean", "core"]).select("id", F.col("exact_id").alias("sale_id"))


def _pools(certificates: DataFrame, sales: DataFrame) -> DataFrame:
    dwellings, sold = matching.describe_dwellings(certificates), matching.describe_sales(sales)
    rest = dwellings.join(matching.latest_sale_by_core(sold), ["postcode_clean", "core"], "left_anti")
    return matching.choose_pools(rest, sold).select("id", "pool")


@query(with_proxies("props sales", _MATCH + " SELECT id, sale_id FROM e"))
def jn7_exact(spark, sf_dir):
    return _exact(_certificates(spark, sf_dir), _all_sales(spark, sf_dir))


@query(with_proxies("props sales", _MATCH_ALL + " SELECT id, sale_id FROM e"))
def jn7_exact_all(spark, sf_dir):
    return _exact(_moved_certificates(spark, sf_dir), _all_sales(spark, sf_dir))


@query(with_proxies("props sales", _MATCH + " SELECT id, pool FROM pool"))
def jn8_pool(spark, sf_dir):
    return _pools(_certificates(spark, sf_dir), _all_sales(spark, sf_dir))


@query(with_proxies("props sales", _MATCH_ALL + " SELECT id, pool FROM pool"))
def jn8_pool_all(spark, sf_dir):
    return _pools(_moved_certificates(spark, sf_dir), _all_sales(spark, sf_dir))


@query(with_proxies("props sales", _MATCH + _PICK + " SELECT id, coalesce(e.sale_id, m.sale_id) AS sale_id, CASE WHEN e.sale_id IS NOT NULL THEN 'exact' WHEN m.sale_id IS NOT NULL THEN 'scored' END AS match_kind FROM d LEFT JOIN e USING (id) LEFT JOIN m USING (id)"))
def jn9_match(spark, sf_dir):
    return matching.match_sales(_certificates(spark, sf_dir), _all_sales(spark, sf_dir))


@query(with_proxies("props sales", _MATCH_ALL + _PICK + " SELECT id, coalesce(e.sale_id, m.sale_id) AS sale_id, CASE WHEN e.sale_id IS NOT NULL THEN 'exact' WHEN m.sale_id IS NOT NULL THEN 'scored' END AS match_kind FROM d LEFT JOIN e USING (id) LEFT JOIN m USING (id)"))
def jn9_match_all(spark, sf_dir):
    return matching.match_sales(_moved_certificates(spark, sf_dir), _all_sales(spark, sf_dir))


# --- places ----------------------------------------------------------------------------

_KM = "6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h))"


def _pairs(places: str) -> str:
    h = "pow(sin(radians(q.latitude - p.latitude) / 2), 2) + cos(radians(p.latitude)) * cos(radians(q.latitude)) * pow(sin(radians(q.longitude - p.longitude) / 2), 2)"
    cell = lambda x: f"floor({x} / 0.02::DOUBLE)"
    return (
        f", pr AS (SELECT p.id, q.*, {cell('q.latitude')} - {cell('p.latitude')} AS dl, {cell('q.longitude')} - {cell('p.longitude')} AS dn, {h} AS h FROM props p, {places} q)"
        f", k0 AS (SELECT *, {_KM} AS km, abs(dl) <= 2 AND abs(dn) <= 2 AS near FROM pr)"
        ", k AS (SELECT *, bool_or(near) OVER (PARTITION BY id) AS sees FROM k0)"
        ", u AS (SELECT *, CASE WHEN sees THEN dl ELSE 0 END AS ol, CASE WHEN sees THEN dn ELSE 0 END AS oj FROM k WHERE near OR NOT sees)"
    )


@query(with_proxies("props stations", _pairs("stations") + ", r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, ol, oj, src_ord) AS n FROM u) SELECT id, name, round(km, 6) AS km FROM r WHERE n = 1"))
def jn10_nearest(spark, sf_dir):
    found = spatial.nearest_place(proxy(spark, sf_dir, "props"), proxy(spark, sf_dir, "stations"), ["name"])
    return found.select("id", "name", _r(F.col("km")).alias("km"))


def _radius_counts(dwellings: DataFrame, schools: DataFrame) -> DataFrame:
    found = spatial.school_summary(dwellings, schools)
    return found.select(
        "id",
        F.col("nearest_school_name").alias("name"),
        _r(F.col("nearest_school_distance_km")).alias("km"),
        _r(F.col("nearest_primary_school_distance_km")).alias("primary_km"),
        _r(F.col("nearest_secondary_school_distance_km")).alias("secondary_km"),
        F.col("nearby_primary_schools_1km").alias("primaries"),
        F.col("nearby_secondary_schools_2km").alias("secondaries"),
    )


@query(with_proxies("props schools", _pairs("schools") + " SELECT id, arg_min(name, (km, ol, oj, src_ord)) AS name, round(min(km), 6) AS km, round(min(km) FILTER (school_type = 'PRIMARY'), 6) AS primary_km, round(min(km) FILTER (school_type = 'SECONDARY'), 6) AS secondary_km, CAST(count(*) FILTER (school_type = 'PRIMARY' AND km <= 1) AS INT) AS primaries, CAST(count(*) FILTER (school_type = 'SECONDARY' AND km <= 2) AS INT) AS secondaries FROM u GROUP BY id"))
def jn11_radius_counts(spark, sf_dir):
    return _radius_counts(proxy(spark, sf_dir, "props"), proxy(spark, sf_dir, "schools"))


# --- comparables --------------------------------------------------------------------------

_FEATURES = f", f AS (SELECT id, CASE WHEN id % 6 = 0 THEN concat(postcode, CAST(id AS VARCHAR)) ELSE postcode END AS postcode_clean, {O.sector('postcode')} AS postcode_sector, floor_area, CASE WHEN id % 10 <> 0 THEN property_subtype END AS property_subtype, address AS full_address, CASE WHEN id % 3 <> 0 THEN CAST(40000 + id * 7919 % 900000 AS DOUBLE) END AS indexed_last_sold_price FROM props)"
_COMPARE = (
    ", ok AS (SELECT * FROM f WHERE floor_area > 10 AND indexed_last_sold_price > 50000)"
    ", n AS (SELECT t.id, count(c.id) AS n FROM f t LEFT JOIN ok c ON c.postcode_clean = t.postcode_clean AND c.id <> t.id GROUP BY 1)"
    ", lv AS (SELECT f.*, CASE WHEN n < 2 AND coalesce(postcode_sector, '') <> '' THEN 'postcode sector' ELSE 'same postcode' END AS source FROM f JOIN n USING (id))"
    ", pr AS (SELECT t.id, t.source, t.floor_area, c.id AS other, c.full_address AS address, c.indexed_last_sold_price / c.floor_area AS per, abs(c.floor_area - t.floor_area) / greatest(t.floor_area, 1) + CASE WHEN c.property_subtype IS NOT DISTINCT FROM t.property_subtype THEN 0 ELSE 0.25::DOUBLE END AS gap FROM lv t JOIN ok c ON c.id <> t.id AND CASE WHEN t.source = 'same postcode' THEN c.postcode_clean = t.postcode_clean ELSE c.postcode_sector = t.postcode_sector END)"
    ", rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, other) AS n FROM pr)"
)


def _features(spark, sf_dir) -> DataFrame:
    props = proxy(spark, sf_dir, "props")
    return props.select(
        "id",
        F.when(F.col("id") % 6 == 0, F.concat("postcode", F.col("id").cast("string"))).otherwise(F.col("postcode")).alias("postcode_clean"),
        T.postcode_sector(F.col("postcode")).alias("postcode_sector"),
        "floor_area",
        F.when(F.col("id") % 10 != 0, F.col("property_subtype")).alias("property_subtype"),
        F.col("address").alias("full_address"),
        F.when(F.col("id") % 3 != 0, (40000 + F.col("id") * 7919 % 900000).cast("double")).alias("indexed_last_sold_price"),
    )


@query(with_proxies("props", _FEATURES + _COMPARE + " SELECT id, source, round(avg(per) * max(floor_area), 4) AS estimate, CAST(count(*) AS INT) AS n, string_agg(address, '|' ORDER BY n) AS addresses FROM rk WHERE n <= 3 GROUP BY id, source"))
def jn12_comparables(spark, sf_dir):
    found = comparables.comparable_estimates(_features(spark, sf_dir))
    return found.select("id", "source", _r(F.col("estimate"), 4).alias("estimate"), F.col("count").alias("n"), F.array_join("addresses", "|").alias("addresses"))


# --- filters, sets, small endpoints ------------------------------------------------------------


@query("WITH p AS (SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand FROM part) SELECT count(*) AS n FROM (SELECT DISTINCT brand FROM p)")
def agg8_distinct_with_null(spark, sf_dir):
    brand = F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand"))
    found = api.data_coverage(table(spark, sf_dir, "part").select(brand.alias("postcode_clean")))
    return found.select(F.col("postcodes").cast("long").alias("n"))


@query(with_proxies("props", "SELECT DISTINCT left(replace(postcode, ' ', ''), length(replace(postcode, ' ', '')) - 3) AS outward FROM props"))
def agg10_prefixes(spark, sf_dir):
    p = T.clean_postcode(F.col("postcode"))
    return proxy(spark, sf_dir, "props").where(F.length(p) > 3).select(F.left(p, F.length(p) - 3).alias("outward")).distinct()


@query(with_proxies("props", "SELECT id FROM props WHERE id % 9 <> 0 AND (starts_with(postcode, 'SW3') OR starts_with(postcode, 'SW5') OR starts_with(postcode, 'SW7'))"))
def flt4_prefix_any(spark, sf_dir):
    postcode = F.when(F.col("id") % 9 != 0, F.col("postcode"))
    return proxy(spark, sf_dir, "props").where(T.any_prefix(postcode, PREFIXES)).select("id")


@query(with_proxies("raw_postcodes", "SELECT id FROM raw_postcodes WHERE CAST(right(oslaua, 2) AS INT) BETWEEN 1 AND 33"))
def flt1_membership(spark, sf_dir):
    return readers.of_the_capital(proxy(spark, sf_dir, "raw_postcodes")).select("id")


@query(with_proxies("props", "SELECT id FROM props WHERE address ILIKE '%high%1%' OR CASE WHEN id % 5 = 0 THEN address END ILIKE '%PARK%'"))
def flt9_contains(spark, sf_dir):
    other = F.when(F.col("id") % 5 == 0, F.col("address"))
    return proxy(spark, sf_dir, "props").where(T.contains_text(F.col("address"), "high%1") | T.contains_text(other, "PARK")).select("id")


@query(with_proxies("props", "SELECT id, postcode FROM props WHERE postcode ILIKE 'sw3%'"))
def flt10_startswith(spark, sf_dir):
    return proxy(spark, sf_dir, "props").where(T.starts_with_text(F.col("postcode"), "sw3")).select("id", "postcode")


@query(with_proxies("props", "SELECT DISTINCT postcode FROM props WHERE postcode ILIKE 'sw%' ORDER BY postcode LIMIT 10"))
def set1_distinct_sorted_limit(spark, sf_dir):
    found = api.postcode_suggestions(proxy(spark, sf_dir, "props").withColumnRenamed("postcode", "postcode_clean"), "sw", 10)
    return found.withColumnRenamed("postcode_clean", "postcode")


@query(with_proxies("props", ", k AS (SELECT id, address, CASE WHEN id % 8 <> 0 THEN postcode END AS key FROM props) SELECT key, min(id) AS id, arg_min(address, id) AS address FROM k GROUP BY key"))
def set2_keep_first(spark, sf_dir):
    key = F.when(F.col("id") % 8 != 0, F.col("postcode")).alias("key")
    return readers.first_of(proxy(spark, sf_dir, "props").select(key, "id", "address", F.col("id").alias("ord")), "key").drop("ord")


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 <> 1")
def set4_difference(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey").join(part.where("p_partkey % 4 = 1").select("p_partkey"), "p_partkey", "left_anti")


# --- valuation ------------------------------------------------------------------------------------

_OLD = "date_diff('day', CAST(last_transfer_date AS DATE), DATE '2001-08-01')"
_VALUE = (
    ", b AS (SELECT *, CASE WHEN floor_area > 0 THEN postcode_average_per_sqm * floor_area END AS base, coalesce(nullif(indexed_last_sold_price, 0), nullif(last_sold_price, 0)) AS anchor FROM valued)"
    ", r AS (SELECT *, CASE WHEN base IS NOT NULL AND anchor IS NOT NULL THEN greatest(base, anchor) / least(base, anchor) END AS ratio FROM b)"
    f", w AS (SELECT *, CASE WHEN ratio >= 1.8 THEN greatest({_sale_w(_OLD)}, 0.85::DOUBLE) WHEN ratio >= 1.35 THEN greatest({_sale_w(_OLD)}, 0.8::DOUBLE) ELSE {_sale_w(_OLD)} END AS w FROM r)"
    ", e AS (SELECT *, CASE WHEN base IS NOT NULL AND anchor IS NOT NULL THEN greatest((1 - w) * CASE WHEN comparable IS NOT NULL THEN 0.7::DOUBLE * comparable + 0.3::DOUBLE * base ELSE base END + w * anchor, 0.9::DOUBLE * anchor) WHEN anchor IS NOT NULL THEN anchor WHEN base IS NOT NULL THEN CASE WHEN comparable IS NOT NULL THEN 0.75::DOUBLE * comparable + 0.25::DOUBLE * base ELSE base END ELSE postcode_average_price END AS raw FROM w)"
)
_FACTORS = (
    "CASE WHEN epc_rating IN ('A', 'B') THEN 1.03::DOUBLE WHEN epc_rating IN ('F', 'G') THEN 0.97::DOUBLE ELSE 1 END"
    " * CASE WHEN nearest_station_distance_km <= 0.5 THEN 1.02::DOUBLE WHEN nearest_station_distance_km <= 1 THEN 1.01::DOUBLE WHEN nearest_station_distance_km >= 2 THEN 0.99::DOUBLE ELSE 1 END"
    " * CASE WHEN nearby_primary_schools_1km >= 3 THEN 1.01::DOUBLE ELSE 1 END * CASE WHEN nearby_secondary_schools_2km >= 2 THEN 1.01::DOUBLE ELSE 1 END"
    " * CASE WHEN crime_level = 'LOW' THEN 1.01::DOUBLE WHEN crime_level = 'HIGH' THEN 0.98::DOUBLE ELSE 1 END"
)


def _weighed(spark, sf_dir) -> DataFrame:
    v = proxy(spark, sf_dir, "valued").withColumn("base", valuation.area_baseline()).withColumn("anchor", valuation.sale_anchor())
    return v.withColumn("w", valuation.sale_weight(F.col("anchor"), F.col("base"), F.col("last_transfer_date"), AS_OF))


def _raw() -> Column:
    return valuation.raw_estimate(F.col("base"), F.col("comparable"), F.col("anchor"), F.col("w"), F.col("postcode_average_price"))


@query(with_proxies("valued", _VALUE + " SELECT id, w AS weight, round(raw, 6) AS blended FROM e WHERE base IS NOT NULL AND anchor IS NOT NULL"))
def val5_blend_floor(spark, sf_dir):
    both = _weighed(spark, sf_dir).where("base is not null and anchor is not null")
    return both.select("id", F.col("w").alias("weight"), _r(valuation.blended(F.col("base"), F.col("comparable"), F.col("anchor"), F.col("w")), 6).alias("blended"))


@query(with_proxies("valued", _VALUE + " SELECT id, round(raw, 6) AS estimate FROM e"))
def val6_ladder(spark, sf_dir):
    return _weighed(spark, sf_dir).select("id", _r(_raw(), 6).alias("estimate"))


@query(with_proxies("valued", f"SELECT id, round({_FACTORS}, 9) AS factor FROM valued"))
def val8_multipliers(spark, sf_dir):
    factor = valuation.adjusted(F.lit(1.0), F.col("epc_rating"), F.col("crime_level"))
    return proxy(spark, sf_dir, "valued").select("id", _r(factor, 9).alias("factor"))


@query(with_proxies("valued", _VALUE + f", z AS (SELECT id, CAST(round_even(round(raw * ({_FACTORS}), 4), 0) AS BIGINT) AS price FROM e) SELECT id, price, CAST(round_even(price * 0.95::DOUBLE, 0) AS BIGINT) AS low, CAST(round_even(price * 1.05::DOUBLE, 0) AS BIGINT) AS high FROM z"))
def val9_price_range(spark, sf_dir):
    price = N.whole(_r(_raw() * valuation.adjusted(F.lit(1.0), F.col("epc_rating"), F.col("crime_level")), 4))
    v = _weighed(spark, sf_dir).select("id", price.alias("price"))
    return v.select("id", "price", N.whole(F.col("price") * 0.95).alias("low"), N.whole(F.col("price") * 1.05).alias("high"))


_ANCHOR = (
    f", a AS (SELECT *, CASE WHEN last_sold_price > 0 THEN last_sold_price ELSE comparable END AS market, CASE WHEN last_sold_price > 0 THEN least(0.85::DOUBLE, {_sale_w(_OLD)}) WHEN id % 2 = 0 THEN 0.65::DOUBLE ELSE 0.5::DOUBLE END AS aw FROM valued)"
    ", p AS (SELECT *, coalesce(ml_prediction > 0 AND greatest(ml_prediction, market) / least(ml_prediction, market) >= 1.35, false) AS pull, greatest(aw * market + (1 - aw) * ml_prediction, market * 0.85::DOUBLE) AS v FROM a)"
)


@query(with_proxies("valued", _ANCHOR + " SELECT id, CAST(round_even(CASE WHEN pull THEN CASE WHEN last_sold_price IS NOT NULL THEN greatest(v, market * 0.9::DOUBLE) ELSE v END ELSE ml_prediction END, 0) AS BIGINT) AS prediction, pull AS adjusted, round(CASE WHEN pull THEN round_even(least(coalesce(nullif(ml_confidence, 0), 0.35::DOUBLE), 0.45::DOUBLE), 3) ELSE ml_confidence END, 6) AS confidence FROM p"))
def val11_anchor(spark, sf_dir):
    x = valuation.anchored_prediction(F.col("ml_prediction"), F.col("ml_confidence"), F.col("last_sold_price"), F.col("last_transfer_date"), F.col("comparable"), F.col("id") % 2 == 0, AS_OF)
    return proxy(spark, sf_dir, "valued").withColumn("x", x).select("id", "x.prediction", "x.adjusted", _r(F.col("x.confidence")).alias("confidence"))


_MIX = (
    ", a AS (SELECT id, CAST(floor(postcode_average_price) AS BIGINT) AS base, CAST(ml_prediction AS BIGINT) AS ml, coalesce(nullif(ml_confidence, 0), 0.35::DOUBLE) AS c FROM valued WHERE postcode_average_price IS NOT NULL)"
    ", r AS (SELECT *, base > 0 AND ml > 0 AS safe, CASE WHEN base > 0 AND ml > 0 THEN greatest(base, ml)::DOUBLE / least(base, ml) END AS ratio FROM a)"
    ", w AS (SELECT *, CASE WHEN c < 0.25 THEN 0.15::DOUBLE WHEN c < 0.45 THEN 0.25::DOUBLE ELSE 1 END AS cap, CASE WHEN ratio >= 2.5 THEN 0.15::DOUBLE WHEN ratio >= 1.8 THEN 0.25::DOUBLE WHEN ratio >= 1.35 THEN 0.35::DOUBLE ELSE 0.5::DOUBLE END AS w0, CASE WHEN ratio >= 2.5 THEN least(c, 0.25::DOUBLE) WHEN ratio >= 1.8 THEN least(c, 0.35::DOUBLE) WHEN ratio >= 1.35 THEN least(c, 0.5::DOUBLE) ELSE c END AS sure FROM r)"
)


@query(with_proxies("valued", _MIX + " SELECT id, CASE WHEN safe THEN CAST(round_even((1 - least(w0, cap)) * base + least(w0, cap) * ml, 0) AS BIGINT) ELSE base END AS mixed, CASE WHEN safe THEN least(w0, cap) ELSE 0 END AS model_weight, round(CASE WHEN safe THEN sure ELSE 0.15::DOUBLE END, 3) AS confidence, CASE WHEN NOT safe THEN 'low' WHEN sure >= 0.7 THEN 'high' WHEN sure >= 0.45 THEN 'medium' ELSE 'low' END AS label FROM w"))
def val12_mix(spark, sf_dir):
    v = proxy(spark, sf_dir, "valued").where("postcode_average_price is not null")
    x = valuation.mixed_prediction(F.floor("postcode_average_price").cast("long"), F.col("ml_prediction").cast("long"), F.col("ml_confidence"))
    return v.withColumn("x", x).select("id", "x.mixed", "x.model_weight", _r(F.col("x.confidence"), 3).alias("confidence"), "x.label")


@query(with_proxies("valued", "SELECT id, round(CASE WHEN ml_prediction <= 0 THEN 0 ELSE least(0.95::DOUBLE, greatest(0.05::DOUBLE, 1 - 5000::DOUBLE * (id % 40) / ml_prediction - coalesce(nullif(ml_confidence, 0), 0.25::DOUBLE) - least(0.25::DOUBLE, 0.015::DOUBLE * (id % 25)))) END, 6) AS confidence FROM valued"))
def val13_confidence(spark, sf_dir):
    x = valuation.model_confidence(F.col("ml_prediction"), 5000.0 * (F.col("id") % 40), F.col("id") % 25, F.col("ml_confidence"))
    return proxy(spark, sf_dir, "valued").select("id", _r(x).alias("confidence"))


# --- learning ----------------------------------------------------------------------------------------

_SPLIT_HASH = "(o_orderkey * 2654435761) % 4294967296"
_STRATUM = "concat_ws('|', CASE WHEN o_orderpriority LIKE '1%' THEN 'FLAT' ELSE 'HOUSE' END, o_orderstatus, CAST(CAST(o_totalprice >= 350000 AS INT) + CAST(o_totalprice >= 600000 AS INT) + CAST(o_totalprice >= 900000 AS INT) + CAST(o_totalprice >= 1400000 AS INT) + CAST(o_totalprice >= 2200000 AS INT) AS VARCHAR), CAST(o_custkey % 97 AS VARCHAR))"


def _stratified(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("o_orderpriority").startswith("1"), "Flat").otherwise("House")
    stratum = F.concat_ws("|", T.stratum(kind, F.col("o_orderstatus"), N.price_band(F.col("o_totalprice"))), (F.col("o_custkey") % 97).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", stratum.alias("stratum"))


_NUMBERS = ", x AS (SELECT 'a' AS feature, CASE WHEN id % 9 <> 0 THEN floor_area END AS v FROM props UNION ALL SELECT 'b', latitude FROM props UNION ALL SELECT 'c', NULL::DOUBLE FROM props), md AS (SELECT feature, coalesce(median(v), 0) AS m FROM x GROUP BY 1)"


@query(with_proxies("props", _NUMBERS + " SELECT feature, round(m, 6) AS median, round(avg(coalesce(v, m)), 6) AS mean, round(CASE WHEN stddev_pop(coalesce(v, m)) = 0 THEN 1 ELSE stddev_pop(coalesce(v, m)) END, 6) AS std FROM x JOIN md USING (feature) GROUP BY feature, m"))
def ml1_standardize(spark, sf_dir):
    p = proxy(spark, sf_dir, "props").select(F.when(F.col("id") % 9 != 0, F.col("floor_area")).alias("a"), F.col("latitude").alias("b"), F.lit(None).cast("double").alias("c"))
    found = learning.numeric_statistics(p, ["a", "b", "c"])
    return found.select("feature", *[_r(F.col(n)).alias(n) for n in ("median", "mean", "std")])


@query("WITH s AS (SELECT DISTINCT upper(trim(c_mktsegment)) AS category FROM customer WHERE c_custkey % 6 <> 0), k AS (SELECT category, CAST(row_number() OVER (ORDER BY category) AS INT) AS code FROM s WHERE category <> 'BUILDING') SELECT c_custkey, coalesce(code, 0) AS code FROM customer LEFT JOIN k ON upper(trim(c_mktsegment)) = category")
def ml1_encode(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    codes = learning.category_codes(c.where("c_custkey % 6 <> 0 and c_mktsegment <> 'BUILDING'"), "c_mktsegment")
    return c.withColumn("category", F.upper(F.trim("c_mktsegment"))).join(codes, "category", "left").select("c_custkey", F.coalesce("code", F.lit(0)).alias("code"))


def _knn(spark, sf_dir, asked: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    near = learning.nearest_rows(v.where(asked).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), v.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), F.col("label").alias("y")), 7)
    return learning.neighbour_means(near).select("id", _r(F.col("prediction")).alias("prediction"), _r(F.col("spread")).alias("spread"))


@query("WITH q AS (SELECT a.vec_id AS id, b.vec_id AS row_id, b.label AS y, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, row_id) AS n FROM q) SELECT id, round(sum(y / (d + 1e-6)) / sum(1 / (d + 1e-6)), 6) AS prediction, round(stddev_pop(y), 6) AS spread FROM r WHERE n <= 7 GROUP BY id")
def ml2_knn(spark, sf_dir):
    return _knn(spark, sf_dir, "vec_id % 5 = 0")


_PARTS = f"WITH s AS (SELECT o_orderkey, {_STRATUM} AS stratum FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_SPLIT_HASH}, o_orderkey) AS place, count(*) OVER (PARTITION BY stratum) AS n FROM s)"


@query(_PARTS + ", q AS (SELECT *, greatest(1, round_even(n * 0.7::DOUBLE, 0)) AS a, greatest(1, round_even(n * 0.15::DOUBLE, 0)) AS b FROM p), z AS (SELECT *, CASE WHEN a + b >= n THEN n - 2 ELSE a END AS f, CASE WHEN a + b >= n THEN 1 ELSE b END AS g FROM q) SELECT o_orderkey, CASE WHEN n < 3 OR place <= f THEN 'train' WHEN place <= f + g THEN 'validation' ELSE 'test' END AS part FROM z")
def ml8_split_quota(spark, sf_dir):
    return learning.three_way_split(_stratified(spark, sf_dir), "o_orderkey", "stratum").select("o_orderkey", "part")


@query(_PARTS + " SELECT o_orderkey, CAST((place - 1) % 4 AS INT) AS fold FROM p")
def ml9_folds(spark, sf_dir):
    return learning.stratified_folds(_stratified(spark, sf_dir), "o_orderkey", "stratum").select("o_orderkey", "fold")


_TWO = "SELECT o_orderkey AS id, o_totalprice AS y, o_totalprice * (1 + ((o_orderkey % 21) - 10)::DOUBLE / 50) AS knn, o_totalprice * (1 + ((o_orderkey % 13) - 6)::DOUBLE / 40) AS forest FROM orders"


def _two_models(spark, sf_dir) -> DataFrame:
    o, y = table(spark, sf_dir, "orders"), F.col("o_totalprice")
    return o.select(F.col("o_orderkey").alias("id"), y.alias("y"), (y * (1 + ((F.col("o_orderkey") % 21) - 10).cast("double") / 50)).alias("knn"), (y * (1 + ((F.col("o_orderkey") % 13) - 6).cast("double") / 40)).alias("forest"))


@query(f"WITH t AS ({_TWO}), w AS (SELECT range / 10::DOUBLE AS forest_weight FROM range(11)) SELECT forest_weight, round(avg(abs(y - ((1 - forest_weight) * knn + forest_weight * forest)) / greatest(y, 1)), 6) AS mape FROM t, w GROUP BY 1")
def ml13_weight_sweep(spark, sf_dir):
    return learning.weight_sweep(_two_models(spark, sf_dir), "y", "knn", "forest").select("forest_weight", _r(F.col("mape")).alias("mape"))


@query(f"WITH t AS ({_TWO}), m AS (SELECT avg(y) AS mean FROM t) SELECT round(avg(abs(y - knn)), 4) AS mae, round(sqrt(avg((y - knn) * (y - knn))), 4) AS rmse, round(avg(abs(y - knn) / greatest(y, 1)), 6) AS mape, round(1 - sum((y - knn) * (y - knn)) / sum((y - mean) * (y - mean)), 6) AS r2 FROM t, m")
def agg12_metrics(spark, sf_dir):
    found = learning.regression_metrics(_two_models(spark, sf_dir), "y", "knn")
    return found.select(_r(F.col("mae"), 4).alias("mae"), _r(F.col("rmse"), 4).alias("rmse"), _r(F.col("mape")).alias("mape"), _r(F.col("r2")).alias("r2"))


_FOREST_FEATURES = ["p_size", "l_quantity", "l_discount", "l_tax"]


def _forest_rows(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items.select("l_orderkey", "l_linenumber", *_FOREST_FEATURES, F.col("l_extendedprice").alias("label"))


@query(None)
def ml4_forest(spark, sf_dir):
    rows = _forest_rows(spark, sf_dir)
    model = learning.fit_forest(rows.where("l_orderkey % 5 <> 0"), _FOREST_FEATURES, "label", trees=10, depth=6)
    return learning.predict_forest(model, rows.where("l_orderkey % 5 = 0"), _FOREST_FEATURES).select("l_orderkey", "l_linenumber", "label", "prediction")


def _two_levels(leaf: int, tried: int) -> str:
    """A tree of depth 2 over lineitem and part: each level's quantiles, sums on either side of them, and rows in the next level."""
    xs = ", ".join(f"{{'f': {i}, 'x': {c}::DOUBLE}}" for i, c in enumerate(_FOREST_FEATURES))
    hashed = "(node * 1009 + f) % 1048573 * 2654435761 % 4294967296"  # of tree 0
    shares = ", ".join(f"{s!r}::DOUBLE" for s in trees.SHARES)
    sql = f"WITH r0 AS (SELECT 1::BIGINT AS node, l_extendedprice::DOUBLE AS y, [{xs}] AS xs FROM lineitem JOIN part ON l_partkey = p_partkey)"
    for k in range(3):
        sql += f", s{k} AS (SELECT node, count(*) AS n, avg(y) AS value, min(y) AS lo, max(y) AS hi FROM r{k} GROUP BY node)"
        if k == 2:
            break
        sql += f""", f{k} AS (SELECT node, value, f FROM s{k}, range({len(_FOREST_FEATURES)}) t(f) WHERE n > {2 * leaf} AND lo < hi QUALIFY row_number() OVER (PARTITION BY node ORDER BY {hashed}, f) <= {tried}),
        x{k} AS (SELECT node, f, y - value AS y, xs[f + 1].x AS x FROM r{k} JOIN f{k} USING (node)),
        t{k} AS (SELECT DISTINCT node, f, unnest(ts) AS t FROM (SELECT node, f, quantile_cont(x, [{shares}]) AS ts FROM x{k} GROUP BY node, f)),
        e{k} AS (SELECT node, f, t, count(*) FILTER (x <= t) AS a, count(*) FILTER (x > t) AS b, coalesce(sum(y) FILTER (x <= t), 0) AS sa, coalesce(sum(y) FILTER (x > t), 0) AS sb, sum(y * y) AS q FROM x{k} JOIN t{k} USING (node, f) GROUP BY node, f, t),
        b{k} AS (SELECT node, f, t FROM e{k} WHERE a >= {leaf} AND b >= {leaf} QUALIFY row_number() OVER (PARTITION BY node ORDER BY round((q - sa * sa / a - sb * sb / b) / q, 9), f, t) = 1),
        r{k + 1} AS (SELECT node * 2 + CASE WHEN xs[f + 1].x <= t THEN 0 ELSE 1 END AS node, y, xs FROM r{k} JOIN b{k} USING (node))"""
    levels = " UNION ALL ".join(f"SELECT s.*, {'b.f, b.t' if k < 2 else 'NULL::INT AS f, NULL::DOUBLE AS t'} FROM s{k} s{f' LEFT JOIN b{k} b USING (node)' if k < 2 else ''}" for k in range(3))
    return f"{sql} SELECT node, n, round(value, 4) AS value, f AS feature, round(t, 6) AS threshold FROM ({levels})"


@query(_two_levels(leaf=12, tried=2))
def ml3_tree(spark, sf_dir):
    found = trees.grow_trees(_forest_rows(spark, sf_dir), _FOREST_FEATURES, "label", "l_orderkey", depth=2, leaf=12, tried=2, bootstrap=False)
    return found.select("node", "n", _r(F.col("value"), 4).alias("value"), "feature", _r(F.col("threshold")).alias("threshold"))


@query(None)
def ml12_growing_forest(spark, sf_dir):
    """Errors on held-out orders of a forest of our own trees, after every five of them."""
    rows = _forest_rows(spark, sf_dir).withColumn("key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    _, errors = trees.grow_forest(rows.where("l_orderkey % 5 <> 0"), rows.where("l_orderkey % 5 = 0"), _FOREST_FEATURES, "label", "key", trees=10, step=5, depth=4, leaf=12, tried=2)
    return spark.createDataFrame(errors, "trees long, mape double")


@query(None)
def ml12_prefix_stop(spark, sf_dir):
    rows = _forest_rows(spark, sf_dir)
    model = learning.fit_forest(rows.where("l_orderkey % 5 <> 0"), _FOREST_FEATURES, "label", trees=20, depth=4)
    return learning.prefix_errors(model, rows.where("l_orderkey % 5 = 0"), _FOREST_FEATURES, "label", step=5)


@query(None)
def api9_estimate(spark, sf_dir):
    from .valuation_run import value_proxies

    return value_proxies(spark, sf_dir).select("id", "estimated_price", "price_min", "price_max", "comparable.source", "explanations")


# --- what else the engine's surface offers ----------------------------------------------------------------


def _listed(spark, sf_dir) -> DataFrame:
    """Dwellings as the endpoints see them."""
    props = proxy(spark, sf_dir, "props")
    return props.select("id", T.clean_postcode(F.col("postcode")).alias("postcode_clean"), F.col("address").alias("full_address"), T.house_number_of_address(F.col("address")).alias("house_number"), F.when(F.col("id") % 3 == 0, F.col("floor_area")).alias("last_sold_price"))


_LISTED = f", l AS (SELECT id, upper(replace(postcode, ' ', '')) AS postcode_clean, address AS full_address, {O.house_of_normalized(O.normalize('address'))} AS house_number, CASE WHEN id % 3 = 0 THEN floor_area END AS last_sold_price FROM props)"


@query(with_proxies("props", _LISTED + " SELECT id, full_address, CASE WHEN last_sold_price IS NOT NULL THEN 'exact_matched_sale' ELSE 'area_fallback' END AS sale_price_source FROM l WHERE postcode_clean = 'SW53AB' AND (full_address ILIKE '%flat%' OR house_number ILIKE '%flat%') ORDER BY id LIMIT 50"))
def api4_property_search(spark, sf_dir):
    return api.property_search(_listed(spark, sf_dir), "sw5 3ab", "flat", 80).select("id", "full_address", "sale_price_source")


@query(with_proxies("props", _LISTED + " SELECT id, house_number FROM l WHERE postcode_clean = 'SW53AB' AND house_number ILIKE '%1%' ORDER BY id LIMIT 20"))
def api2_address_suggestions(spark, sf_dir):
    return api.address_suggestions(_listed(spark, sf_dir), "SW5 3AB", "1").select("id", "house_number")


@query(with_proxies("props", _LISTED + " SELECT DISTINCT postcode_clean FROM l WHERE postcode_clean LIKE 'SW3%' ORDER BY 1 LIMIT 10"))
def api5_postcode_suggestions(spark, sf_dir):
    return api.postcode_suggestions(_listed(spark, sf_dir), " sw3 ", 40)


@query(with_proxies("props", _LISTED + ", p AS (SELECT CASE WHEN id % 11 <> 0 THEN postcode_clean END AS p FROM l) SELECT (SELECT count(*) FROM (SELECT DISTINCT p FROM p)) AS postcodes, count(*) AS rows, string_agg(DISTINCT left(p, length(p) - 3), ',' ORDER BY left(p, length(p) - 3)) AS prefixes FROM p"))
def api6_data_coverage(spark, sf_dir):
    some = _listed(spark, sf_dir).withColumn("postcode_clean", F.when(F.col("id") % 11 != 0, F.col("postcode_clean")))
    found = api.data_coverage(some)
    return found.select(F.col("postcodes").cast("long").alias("postcodes"), "rows", F.array_join("prefixes", ",").alias("prefixes"))


@query(with_proxies("props", _LISTED + " SELECT id, full_address FROM l ORDER BY id LIMIT 25"))
def api8_features_preview(spark, sf_dir):
    return api.features_preview(_listed(spark, sf_dir), 25).select("id", "full_address")


@query(with_proxies("valued", ", c AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE floor_area * 2 END AS v FROM valued WHERE id % 3 = 0) SELECT v.id, CASE WHEN c.id IS NOT NULL THEN c.v ELSE v.floor_area END AS floor_area, v.crime_level FROM valued v LEFT JOIN c USING (id)"))
def snk5_keyed_update(spark, sf_dir):
    v = proxy(spark, sf_dir, "valued").select("id", "floor_area", "crime_level")
    changes = v.where("id % 3 = 0").select("id", F.when(F.col("id") % 4 != 0, F.col("floor_area") * 2).alias("floor_area"))
    return tables.updated(v, changes)


_TIE = 1e-8  # off exact ties, which the two engines round differently
_AREA = "CASE WHEN floor_area > 0 THEN floor_area * postcode_average_per_sqm END"


@query(with_proxies("valued", f"SELECT id, round(coalesce({_AREA}, indexed_last_sold_price, last_sold_price, postcode_average_price) * {_FACTORS} + {_TIE}, 6) AS training, round(coalesce({_AREA}, postcode_average_price) * {_FACTORS} + {_TIE}, 6) AS serving FROM valued"))
def val10_feature_baseline(spark, sf_dir):
    v = proxy(spark, sf_dir, "valued")
    return v.select("id", _r(valuation.feature_baseline(True) + _TIE).alias("training"), _r(valuation.feature_baseline(False) + _TIE).alias("serving"))


@query(with_proxies("valued", "SELECT id, CAST((floor_area IS NULL)::INT + (postcode_average_price IS NULL)::INT + (postcode_average_per_sqm IS NULL)::INT + (nearest_station_distance_km IS NULL)::INT + (epc_rating IS NULL)::INT + (crime_level IS NULL)::INT + 16 AS INT) AS missing FROM valued"))
def val15_missing_features(spark, sf_dir):
    v = proxy(spark, sf_dir, "valued").withColumn("base_estimator_prediction", F.lit(None).cast("double"))
    return tables.with_schema(v.drop("comparable"), schemas.FEATURES + ", base_estimator_prediction double").select("id", valuation.missing_features().alias("missing"))


@query(f"WITH t AS ({_TWO}) SELECT id, round(0.4::DOUBLE * knn + 0.6::DOUBLE * forest, 6) AS prediction, round((knn * 0.1::DOUBLE + forest * 0.2::DOUBLE + abs(knn - forest)) / 3, 6) AS uncertainty FROM t")
def ml5_blended_models(spark, sf_dir):
    x = valuation.blended_models(F.col("knn"), F.col("knn") * 0.1, F.col("forest"), F.col("forest") * 0.2)
    return _two_models(spark, sf_dir).withColumn("x", x).select("id", _r(F.col("x.prediction")).alias("prediction"), _r(F.col("x.uncertainty")).alias("uncertainty"))


@query(_PARTS + ", t AS (SELECT count(*) AS total FROM s), q AS (SELECT p.*, place > greatest(1, round_even(n * 1000::DOUBLE / total, 0)) AS over FROM p, t) SELECT o_orderkey FROM q ORDER BY over, " + _SPLIT_HASH + ", o_orderkey LIMIT 1000")
def ml7_stratified_sample(spark, sf_dir):
    return learning.stratified_sample(_stratified(spark, sf_dir), "o_orderkey", "stratum", 1000).select("o_orderkey")


def _neighbour_grid(spark, sf_dir, chosen: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    asked = v.where(chosen).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("double").alias("y"))
    near = learning.nearest_rows(asked.select("id", "vec"), v.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), F.col("label").alias("y")), max(NEIGHBOURS))
    return learning.score_of_k(near, asked, NEIGHBOURS).select("k", _r(F.col("mape")).alias("mape"))


@query("WITH q AS (SELECT a.vec_id AS id, a.label AS actual, b.label AS y, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, b.vec_id AS o FROM embeddings a JOIN embeddings b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS n FROM q), k AS (SELECT unnest([2, 3, 4, 5, 7, 9, 12, 15, 25]) AS k), p AS (SELECT id, k, any_value(actual) AS actual, sum(y / (d + 1e-6)) / sum(1 / (d + 1e-6)) AS p FROM r, k WHERE n <= k GROUP BY id, k) SELECT k, round(avg(abs(actual - p) / greatest(actual, 1)), 6) AS mape FROM p GROUP BY k")
def ml10_neighbour_grid(spark, sf_dir):
    return _neighbour_grid(spark, sf_dir, "vec_id % 5 = 0")


@query(with_proxies("props sales", _MATCH_ALL + _PICK + " SELECT count(*) AS n, count(coalesce(e.sale_id, m.sale_id)) AS matched, count(*) - count(coalesce(e.sale_id, m.sale_id)) AS unmatched FROM d LEFT JOIN e USING (id) LEFT JOIN m USING (id)"))
def agg16_match_counts(spark, sf_dir):
    return matching.match_counts(matching.match_sales(_moved_certificates(spark, sf_dir), _all_sales(spark, sf_dir)))


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part GROUP BY 1")
def set3_union_all(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where("p_size > 10").groupBy("p_brand").agg(F.count("*").alias("n")).unionAll(part.groupBy("p_type").agg(F.count("*").alias("n")))


# --- raw files, written from the views and read back ----------------------------------------------------------

_KNOWN_POSTCODES = (
    ", known AS (SELECT * FROM (SELECT *, upper(replace(pcd, ' ', '')) AS postcode_clean,"
    " row_number() OVER (PARTITION BY upper(replace(pcd, ' ', '')) ORDER BY id) AS n"
    " FROM raw_postcodes WHERE CAST(right(oslaua, 2) AS INT) BETWEEN 1 AND 33) WHERE n = 1)"
)


def _known_postcodes(spark, sf_dir) -> DataFrame:
    return readers.read_postcodes(spark, raw_file(spark, sf_dir, "raw_postcodes"))


@query(with_proxies("raw_postcodes", _KNOWN_POSTCODES + """
    SELECT postcode_clean, pcd AS postcode, local_authority_code, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
    FROM (SELECT *, oslaua AS local_authority_code, try_cast(lat AS DOUBLE) AS latitude, try_cast(long AS DOUBLE) AS longitude FROM known)
    WHERE starts_with(postcode_clean, 'SW3') OR starts_with(postcode_clean, 'SW5') OR starts_with(postcode_clean, 'SW7')"""))
def src1_postcodes(spark, sf_dir):
    found = readers.read_postcodes(spark, raw_file(spark, sf_dir, "raw_postcodes"), PREFIXES)
    return found.select("postcode_clean", "postcode", "local_authority_code", _r(F.col("latitude")).alias("latitude"), _r(F.col("longitude")).alias("longitude"))


@query(with_proxies("raw_postcodes raw_sales", _KNOWN_POSTCODES + """,
    s AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY id) AS n FROM raw_sales
      WHERE record_status = 'a' AND price <> 'n/a' AND upper(replace(postcode, ' ', '')) IN (SELECT postcode_clean FROM known))
    SELECT transaction_id, CAST(trunc(CAST(price AS DOUBLE)) AS BIGINT) AS price, transfer_date,
      CASE WHEN paon = 'TOWER HOUSE' THEN NULL WHEN starts_with(paon, '14A') THEN '14A' ELSE paon END AS house_number,
      CASE WHEN paon = 'TOWER HOUSE' OR starts_with(paon, '14A') THEN paon END AS building_name,
      nullif(saon, '') AS unit, concat_ws(', ', nullif(saon, ''), paon, street, town_city, postcode) AS full_address
    FROM s WHERE n = 1"""))
def src3_sales(spark, sf_dir):
    path = raw_file(spark, sf_dir, "raw_sales", header=False)
    found = readers.with_ids(readers.read_sales(spark, path, _known_postcodes(spark, sf_dir)), "sale_id")
    return found.select("transaction_id", "price", "transfer_date", "house_number", "building_name", "unit", "full_address")


_PREFIXED = _KNOWN_POSTCODES.replace("WHERE n = 1)", "WHERE n = 1 AND (starts_with(postcode_clean, 'SW3') OR starts_with(postcode_clean, 'SW5') OR starts_with(postcode_clean, 'SW7')))")
_RAW_SALES = """,
    s AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY id) AS n FROM raw_sales
      WHERE record_status = 'a' AND price <> 'n/a' AND upper(replace(postcode, ' ', '')) IN (SELECT postcode_clean FROM known))"""


@query(with_proxies("raw_postcodes raw_sales", _PREFIXED + _RAW_SALES + " SELECT transaction_id, upper(replace(postcode, ' ', '')) AS postcode_clean, CAST(trunc(CAST(price AS DOUBLE)) AS BIGINT) AS price, transfer_date FROM s WHERE n = 1"))
def src5_read_through(spark, sf_dir):
    """Sales of some districts, where a run over all of them came first and a build of the table broke off."""
    from .raw_run import Processed

    folder = f"{tables.shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    raw_file(spark, sf_dir, "raw_postcodes", f"{folder}/postcodes.csv")
    raw_file(spark, sf_dir, "raw_sales", f"{folder}/sales", header=False)
    Processed(spark, folder, EngineConfig(AS_OF, ())).sales()
    some = Processed(spark, folder, EngineConfig(AS_OF, PREFIXES))
    some.postcodes()
    return some.sales().select("transaction_id", "postcode_clean", "price", "transfer_date")


@query(with_proxies("raw_postcodes", """
    , k AS (SELECT id, upper(replace(pcd, ' ', '')) AS postcode_clean, oslaua FROM raw_postcodes)
    SELECT id, postcode_clean, oslaua, left(postcode_clean, length(postcode_clean) - 3) AS outward FROM k
    WHERE starts_with(postcode_clean, 'SW3') OR starts_with(postcode_clean, 'SW5') OR starts_with(postcode_clean, 'SW7')"""))
def snk11_export(spark, sf_dir):
    """What an export of two tables wrote, read back."""
    rows = proxy(spark, sf_dir, "raw_postcodes").select("id", T.clean_postcode(F.col("pcd")).alias("postcode_clean"), "oslaua")
    folder = f"{tables.shared_folder(spark)}/export-{uuid.uuid4().hex}"
    tables.export_subsets({f"{folder}/postcodes": rows.select("id", "postcode_clean"), f"{folder}/authorities": rows}, PREFIXES)
    both = [spark.read.parquet(f"{folder}/{name}") for name in ("postcodes", "authorities")]
    return both[0].join(both[1].drop("outward"), ["id", "postcode_clean"]).select("id", "postcode_clean", "oslaua", "outward")


@query(with_proxies("raw_postcodes raw_certificates", _KNOWN_POSTCODES + """,
    c AS (SELECT *, upper(replace(POSTCODE, ' ', '')) AS key, coalesce(nullif(ADDRESS, ''), ADDRESS1) AS said FROM raw_certificates),
    f AS (SELECT *, concat(said, ', LONDON, ', POSTCODE) AS full_address FROM c WHERE key IN (SELECT postcode_clean FROM known)),
    r AS (SELECT *, row_number() OVER (PARTITION BY full_address ORDER BY LODGEMENT_DATE DESC, id DESC) AS n FROM f)
    SELECT full_address, nullif(LODGEMENT_DATE, '') AS lodgement_date, CURRENT_ENERGY_RATING AS epc_rating, try_cast(TOTAL_FLOOR_AREA AS DOUBLE) AS floor_area,
      string_split(said, ' ')[CASE WHEN starts_with(said, 'Flat') THEN 3 ELSE 1 END] AS house_number, round(try_cast(lat AS DOUBLE), 6) AS latitude
    FROM r JOIN known ON postcode_clean = key WHERE r.n = 1"""))
def src4_certificates(spark, sf_dir):
    found = readers.read_certificates(spark, raw_file(spark, sf_dir, "raw_certificates"), _known_postcodes(spark, sf_dir))
    return found.select("full_address", "lodgement_date", "epc_rating", "floor_area", "house_number", _r(F.col("latitude")).alias("latitude"))


@query(with_proxies("raw_stations", """
    , s AS (SELECT trim("Station") AS name, CAST(id % 6 + 1 AS VARCHAR) AS zone, CAST("Latitude" AS DOUBLE) AS latitude, try_cast("Longitude" AS DOUBLE) AS longitude FROM raw_stations),
    u AS (SELECT * FROM s WHERE name <> '' AND longitude IS NOT NULL)
    SELECT name, zone, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM u WHERE (SELECT count(*) FROM u) >= 50"""))
def src6_stations(spark, sf_dir):
    found = readers.read_stations(spark, raw_file(spark, sf_dir, "raw_stations"))
    return found.select("name", "zone", _r(F.col("latitude")).alias("latitude"), _r(F.col("longitude")).alias("longitude"))


@query(with_proxies("raw_postcodes raw_schools", _KNOWN_POSTCODES + """
    SELECT "EstablishmentName" AS name, CASE WHEN contains(upper("PhaseOfEducation (name)"), 'PRIMARY') THEN 'PRIMARY' WHEN contains(upper("PhaseOfEducation (name)"), 'SECONDARY') THEN 'SECONDARY' ELSE 'OTHER' END AS school_type,
      postcode_clean, round(try_cast(lat AS DOUBLE), 6) AS latitude
    FROM raw_schools JOIN known ON postcode_clean = upper(replace("Postcode", ' ', '')) WHERE "EstablishmentStatus (name)" = ' open' AND "GOR (name)" = 'London'"""))
def src7_schools(spark, sf_dir):
    found = readers.read_schools(spark, raw_file(spark, sf_dir, "raw_schools"), _known_postcodes(spark, sf_dir))
    return found.select("name", "school_type", "postcode_clean", _r(F.col("latitude")).alias("latitude"))


@query(with_proxies("raw_postcodes raw_hospitals", _KNOWN_POSTCODES + """,
    j AS (SELECT r."Site Name" AS name, r."LAT" AS own_lat, r."lng" AS own_lon, k.lat AS their_lat, k.long AS their_lon
      FROM raw_hospitals r LEFT JOIN known k ON k.postcode_clean = upper(r."Postcode")),
    h AS (SELECT name, CASE WHEN own_lat <> '' THEN own_lat ELSE their_lat END AS y, CASE WHEN own_lat <> '' THEN own_lon ELSE their_lon END AS x FROM j)
    SELECT name, round(try_cast(y AS DOUBLE), 6) AS latitude, round(try_cast(x AS DOUBLE), 6) AS longitude FROM h WHERE try_cast(y AS DOUBLE) IS NOT NULL AND try_cast(x AS DOUBLE) IS NOT NULL"""))
def src8_hospitals(spark, sf_dir):
    found = readers.read_hospitals(spark, raw_file(spark, sf_dir, "raw_hospitals"), _known_postcodes(spark, sf_dir))
    return found.select("name", _r(F.col("latitude")).alias("latitude"), _r(F.col("longitude")).alias("longitude"))


@query(with_proxies("raw_postcodes", """
    , a AS (SELECT upper(replace(pcd, ' ', '')) AS postcode_clean, lsoa11, id FROM raw_postcodes WHERE trim(lsoa11) <> '' AND lsoa11 <> 'nan')
    SELECT postcode_clean, arg_max(lsoa11, id) AS area FROM a GROUP BY 1"""))
def src9_postcode_areas(spark, sf_dir):
    found = readers.read_postcode_areas(spark, raw_file(spark, sf_dir, "raw_postcodes"))
    return found.select("postcode_clean", F.col("crime_lsoa_code").alias("area"))


@query(with_proxies("props", _LISTED + " SELECT id, full_address FROM l WHERE postcode_clean = 'SW53AB' AND (full_address ILIKE '%kings%' OR house_number ILIKE '%kings%') ORDER BY id LIMIT 20"))
def api3_certificate_suggestions(spark, sf_dir):
    return api.certificate_suggestions(_listed(spark, sf_dir), "sw53ab", "kings").select("id", "full_address")


@query(with_proxies("props", _LISTED + " SELECT DISTINCT postcode_clean FROM l WHERE postcode_clean = 'SW53AB'"))
def api1_check_postcode(spark, sf_dir):
    return api.check_postcode(_listed(spark, sf_dir), " sw5 3ab").select("postcode_clean")


@query(with_proxies("props", _LISTED + " SELECT id, house_number FROM l WHERE postcode_clean = 'SW53AB' ORDER BY id LIMIT 20"))
def api7_debug_certificates(spark, sf_dir):
    return api.debug_certificates(_listed(spark, sf_dir), "SW5 3AB").select("id", "house_number")


_LOST = "CASE id % 50 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('Infinity' AS DOUBLE) ELSE latitude END"


def _nearest_sql(places: str, other: str) -> str:
    """Of each dwelling the nearest of the places."""
    body = _pairs(places).replace("FROM props p", "FROM found p")
    for name in ("pr", "k0", "k", "u"):
        body = body.replace(f", {name} AS", f", {name}_{other} AS").replace(f"FROM {name})", f"FROM {name}_{other})").replace(f"FROM {name} WHERE", f"FROM {name}_{other} WHERE")
    return body + f", n_{other} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, ol, oj, src_ord) AS n FROM u_{other}) WHERE n = 1)"


_MAP = (
    f", found AS (SELECT * FROM (SELECT id, {_LOST} AS latitude, longitude FROM props) WHERE isfinite(latitude))" + _nearest_sql("stations", "s") + _nearest_sql("schools", "e")
    + " SELECT p.id, s.name AS station, round(s.km, 6) AS station_km, e.name AS school, round(e.km, 6) AS school_km, round(e.latitude, 6) AS school_latitude, e.school_type AS detail, CAST((s.id IS NOT NULL)::INT + (e.id IS NOT NULL)::INT AS INT) AS n"
    " FROM props p LEFT JOIN n_s s ON s.id = p.id LEFT JOIN n_e e ON e.id = p.id"
)


@query(with_proxies("props stations schools", _MAP))
def api10_map_amenities(spark, sf_dir):
    props = proxy(spark, sf_dir, "props").withColumn("latitude", F.expr(_LOST))
    found = api.map_amenities(props, proxy(spark, sf_dir, "stations").withColumn("zone", F.lit("1")), proxy(spark, sf_dir, "schools"))
    s, e = F.get("amenities", F.lit(0)), F.get("amenities", F.lit(1))
    return found.select(
        "id", s["name"].alias("station"), _r(s["distance_km"]).alias("station_km"), e["name"].alias("school"), _r(e["distance_km"]).alias("school_km"),
        _r(e["latitude"]).alias("school_latitude"), e["detail"].alias("detail"), F.size("amenities").alias("n"),
    )


@query(with_proxies("valued", "SELECT id, CASE WHEN nearest_station_distance_km IS NOT NULL THEN 'station' END AS first_kind, CASE WHEN nearest_station_distance_km IS NOT NULL THEN 1 ELSE 0 END AS n FROM valued"))
def api10_amenities(spark, sf_dir):
    v = proxy(spark, sf_dir, "valued").withColumn("nearest_station_name", F.when(F.col("nearest_station_distance_km").isNotNull(), F.lit("Halt")))
    v = v.withColumns({"nearest_school_name": F.lit(None).cast("string"), "nearest_school_distance_km": F.lit(None).cast("double")})
    return api.amenities(v).select("id", F.get("amenities", F.lit(0))["kind"].alias("first_kind"), F.size("amenities").alias("n"))
