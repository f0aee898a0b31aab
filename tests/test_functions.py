"""Golden values of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from hearthline.config import EngineConfig, parse_prefixes
from hearthline.functions import dates as D
from hearthline.functions import numbers as N
from hearthline.functions import text as T

ADDRESSES = [
    ("Flat 3, 12 High St.", "FLAT 3 12 HIGH STREET", "FLAT 3", "12 HIGH STREET", "12"),
    ("Ground Floor Flat, 7 St. James's Sq", "GROUND FLOOR FLAT 7 STREET JAMES S SQUARE", "GROUND FLOOR FLAT", "7 STREET JAMES S SQUARE", "7"),
    ("Apt 5B Tower Ct", "FLAT 5B TOWER COURT", "FLAT 5B", "TOWER COURT", None),
    ("Studio House, 9 Ave Rd", "STUDIO HOUSE 9 AVENUE ROAD", "FLAT HOUSE", "9 AVENUE ROAD", "9"),
    ("A & B Mews", "A AND B MEWS", None, "A AND B MEWS", None),
    ("First Floor Flat 2, 10 Park Pl", "FIRST FLOOR FLAT 2 10 PARK PLACE", "FIRST FLOOR FLAT", "2 10 PARK PLACE", "2"),
    ("Lower Ground Floor Flat, 1A Kings Rd", "LOWER GROUND FLOOR FLAT 1A KINGS ROAD", "LOWER GROUND FLOOR FLAT", "1A KINGS ROAD", "1A"),
    ("Flat 3", "FLAT 3", "FLAT 3", None, "3"),
    ("Room 4 Unit 5 Mill Ln", "ROOM 4 UNIT 5 MILL LANE", "FLAT 4", "UNIT 5 MILL LANE", "5"),
    ("  \t", None, None, None, None),
    (None, None, None, None, None),
]


def test_addresses(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ADDRESSES)], "i int, a string")
    a = F.col("a")
    rows = df.select("i", T.normalize_text(a), T.extract_unit(a), T.strip_unit(a), T.house_number_of_address(a)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [a[1:] for a in ADDRESSES]


@pytest.mark.parametrize(
    "function,given,expected",
    [
        (T.postcode_sector, ["SW6 4AB", "sw73eg", "E2 7DP", "ABC", "SW7 3 EG", None], ["SW6 4", "SW7 3", "E2 7", None, None, None]),
        (T.format_distance, [0.4, 1.234, None], ["400 m", "1.23 km", None]),
        (N.price_band, [349_999.0, 350_000.0, 2_200_000.0], [0, 1, 5]),
        (T.last_address_part, ["a, b , ", ",", None], ["b", None, None]),
        (T.house_number_of_primary_name, ["12 - 14", "The Tower", "7A,"], ["12", None, "7A"]),
        (T.building_of_primary_name, ["12 - 14", "The Tower", "7A"], ["12 - 14", "The Tower", None]),
        (T.school_type, ["All-through Primary", "Secondary", None], ["PRIMARY", "SECONDARY", "OTHER"]),
        (T.client_postcode, ["sw73eg", "W8"], ["SW7 3EG", None]),
    ],
)
def test_values(spark, function, given, expected):
    kind = "double" if isinstance(given[0], float) else "string"
    df = spark.createDataFrame(list(enumerate(given)), f"i int, x {kind}")
    assert [r[1] for r in df.select("i", function(F.col("x"))).orderBy("i").collect()] == expected


def test_recency(spark):
    today = datetime.date(2020, 1, 1)
    days = [365, 366, 1095, 1096, 1825, 1826, 2920, 2921, -5]
    df = spark.createDataFrame([(i, str(today - datetime.timedelta(d))) for i, d in enumerate(days)] + [(9, "soon"), (10, None)], "i int, d string")
    rows = df.select("i", D.sale_recency_weight(F.col("d"), today), D.average_recency_weight(F.col("d"), today)).orderBy("i").collect()
    assert [r[1] for r in rows] == [0.9, 0.85, 0.85, 0.8, 0.8, 0.75, 0.75, 0.65, 0.9, 0.65, 0.65]
    assert [r[2] for r in rows] == [1.0, 0.7, 0.7, 0.5, 0.5, 0.25, 0.25, 0.25, 1.0, 0.2, 0.2]


def test_distance_and_casts(spark):
    row = spark.range(1).select(N.haversine_km(F.lit(51.5), F.lit(-0.1), F.lit(51.51), F.lit(-0.1)), N.to_double(F.lit("inf")), N.to_double(F.lit("x")), N.to_long(F.lit("-2.9")), T.sale_core(F.lit("Flat 1"), F.lit("12"), F.lit("12 Tower Ct"), F.lit("High St"))).first()
    assert abs(row[0] - 1.11194926) < 1e-7
    assert tuple(row)[1:] == (None, None, -2, "FLAT 1 12 TOWER COURT HIGH STREET")


def test_prefixes(spark):
    assert parse_prefixes(" w8, ,sw 7") == ("W8", "SW7") and parse_prefixes("ALL") == ()
    assert EngineConfig(datetime.date(2020, 1, 1)).prefixes[0] == "W8"
    df = spark.createDataFrame([("SW71AA",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(T.any_prefix(F.col("p"), ("SW7",))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(T.any_prefix(F.col("p"), ())).collect()] == [True, False, False]
