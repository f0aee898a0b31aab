"""What the area, the market and past sales say about a dwelling."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import average_recency_weight, month_key
from ..functions.numbers import to_double
from ..functions.text import clean_postcode, clean_text, index_type, or_null
from ..sources.tables import staged
from .quantiles import exact_quantiles

#: Quantiles that part low, average and high crime.
LOW_SHARE, HIGH_SHARE = 0.33, 0.66


def month_columns(names: list[str], last: int = 12) -> list[str]:
    """The last of the columns that are named by digits."""
    return sorted(n for n in names if n.isascii() and n.isdigit())[-last:]


def row_total(columns: list[Column]) -> Column:
    """The sum with nulls as 0; null over no columns."""
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns]) if columns else F.lit(0.0)


def crime_by_area(wide: DataFrame, code: str = "LSOA Code", name: str = "LSOA Name") -> DataFrame:
    """Totals of the last twelve months by area."""
    months = [F.col(f"`{m}`") for m in month_columns(wide.columns)]
    rows = wide.select(F.col(f"`{code}`").alias("crime_lsoa_code"), F.col(f"`{name}`").alias("crime_lsoa_name"), row_total(months).alias("n"))
    known = rows.where("crime_lsoa_code is not null and crime_lsoa_name is not null")
    return known.groupBy("crime_lsoa_code", "crime_lsoa_name").agg(F.sum("n").alias("crime_total_12m"))


def crime_levels(areas: DataFrame) -> DataFrame:
    """Monthly mean and level; an area at the lower edge is low, at the upper high."""
    means = staged(areas.withColumn("crime_avg_monthly_12m", F.col("crime_total_12m") / 12.0), "crime")
    found = exact_quantiles(means.select(F.lit("mean").alias("feature"), F.col("crime_avg_monthly_12m").alias("x")), [LOW_SHARE, HIGH_SHARE])
    low, high = map(F.lit, found.get("mean", [0.0, 0.0]))
    mean = F.col("crime_avg_monthly_12m")
    return means.withColumn("crime_level", F.when(mean <= low, "LOW").when(mean >= high, "HIGH").otherwise("AVERAGE"))


def area_of_postcode(directory: DataFrame) -> DataFrame:
    """postcode_clean and its area; the later row of a postcode wins. Needs ord, the order of arrival."""
    area = clean_text(F.col("lsoa11"))
    rows = directory.select(clean_postcode(F.col("pcd")).alias("postcode_clean"), area.alias("crime_lsoa_code"), "ord")
    known = rows.where(F.col("postcode_clean").isNotNull() & F.col("crime_lsoa_code").isNotNull() & (F.lower("crime_lsoa_code") != "nan"))
    return known.groupBy("postcode_clean").agg(F.max_by("crime_lsoa_code", "ord").alias("crime_lsoa_code"))


def attach_crime(dwellings: DataFrame, postcode_areas: DataFrame, leveled: DataFrame) -> DataFrame:
    """Two left joins: the area's code stays where no crime is known for it."""
    return dwellings.join(postcode_areas, "postcode_clean", "left").join(leveled, "crime_lsoa_code", "left")


def price_index(raw: DataFrame, region: str = "London") -> DataFrame:
    """day, month_key, index_type, idx and annual_change from d/m/Y rows of one region."""
    day = F.try_to_timestamp("Date", F.lit("d/M/yyyy")).cast("date")
    kinds = F.array(F.struct(F.lit("HOUSE").alias("index_type"), to_double(F.col("Index")).alias("idx")), F.struct(F.lit("FLAT").alias("index_type"), to_double(F.col("FlatIndex")).alias("idx")))
    rows = raw.where(F.col("RegionName") == region).select(day.alias("day"), to_double(F.col("`12m%Change`")).alias("annual_change"), F.explode(kinds).alias("x")).where("day is not null")
    return rows.select("day", F.date_format("day", "yyyy-MM").alias("month_key"), "x.*", "annual_change")


def latest_index(series: DataFrame) -> DataFrame:
    """The value of each type's latest row, even if that is null."""
    return series.groupBy("index_type").agg(F.max_by("idx", "day").alias("current_idx"))


def indexed_price(price: Column, at_sale: Column, current: Column) -> Column:
    return F.when(at_sale > 0, price * current / at_sale)


def attach_index(dwellings: DataFrame, series: DataFrame) -> DataFrame:
    """Index at the month of the last sale, its annual change then, the current
    index, and the sale's price carried forward."""
    keyed = dwellings.withColumn("index_type", index_type(F.col("property_subtype"))).withColumn("month_key", month_key(F.col("last_transfer_date")))
    monthly = series.groupBy("index_type", "month_key").agg(F.max_by(F.struct("idx", "annual_change"), "day").alias("m"))
    found = keyed.join(monthly, ["index_type", "month_key"], "left").join(latest_index(series), "index_type", "left")
    return found.select(
        *[c for c in dwellings.columns],
        F.col("current_idx").alias("london_hpi_current_index"),
        F.col("m.idx").alias("london_hpi_at_last_sale"),
        F.col("m.annual_change").alias("london_hpi_annual_change_pct"),
        indexed_price(F.col("last_sold_price"), F.col("m.idx"), F.col("current_idx")).alias("indexed_last_sold_price"),
    )


def sector_averages(dwellings: DataFrame, as_of: datetime.date) -> DataFrame:
    """Recency-weighted mean price, and price per square metre, of each sector's nominal sales."""
    w = average_recency_weight(F.col("last_transfer_date"), as_of)
    sized = F.col("floor_area") > 0
    sold = dwellings.where(or_null(F.col("postcode_sector")).isNotNull() & F.col("last_sold_price").isNotNull())
    per_metre = F.sum(F.when(sized, F.col("last_sold_price") / F.when(sized, F.col("floor_area")) * w)) / F.sum(F.when(sized, w))
    return sold.groupBy("postcode_sector").agg((F.sum(F.col("last_sold_price") * w) / F.sum(w)).alias("postcode_average_price"), per_metre.alias("postcode_average_per_sqm"))


def attach_sector_averages(dwellings: DataFrame, as_of: datetime.date) -> DataFrame:
    return dwellings.join(sector_averages(dwellings, as_of), "postcode_sector", "left")
