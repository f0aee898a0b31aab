"""Edge cases that the star-schema tables don't hold, and plans."""

import datetime
import math
import random

from pyspark.sql import functions as F

from hearthline.operators import comparables, enrichment, learning, matching, spatial, valuation
from hearthline.plans import api
from hearthline.sources import readers, tables

SALE = "sale_id long, postcode_clean string, house_number string, building_name string, unit string, street string, full_address string, price long, transfer_date string"
DWELLING = "id long, postcode_clean string, address string, address1 string, house_number string, full_address string"


def _match(spark, dwellings, sales):
    found = matching.match_sales(spark.createDataFrame(dwellings, DWELLING), spark.createDataFrame(sales, SALE))
    return {r["id"]: (r["sale_id"], r["match_kind"]) for r in found.collect()}


def test_match_ties_and_ambiguity(spark):
    sales = [
        (1, "P1", "12", None, "FLAT 3", "HIGH STREET", "A", 5, "2001-01-01"),
        (2, "P1", "12", None, "FLAT 3", "HIGH STREET", "A", 5, "2001-01-01"),  # same core and date: the later arrival
        (3, "P2", "9", None, None, "MILL LANE", "B", 5, "2001-01-01"),
        (4, "P2", "9", None, None, "MILL LANE", "B", 5, "2001-01-02"),
        (5, "P3", "9", None, None, "MILL LANE", "C", 5, "2001-01-01"),
        (6, "P3", "9", None, None, "MILL LANE", "D", 5, "2001-01-01"),  # another address with the same score
        (7, "P4", "8", None, "FLAT 9", "MILL LANE", "E", None, "2001-01-01"),
    ]
    dwellings = [
        (1, "P1", "Flat 3, 12 High St", None, None, None),
        (2, "P2", "The Old Barn, 9, Mill Ln", None, None, None),
        (3, "P3", "The Old Barn, 9, Mill Ln", None, None, None),
        (4, "P4", "Flat 1, 8, Mill Ln", None, None, None),  # wrong unit: 4 points, too few
        (5, None, "Flat 3, 12 High St", None, None, None),
        (6, "P9", None, None, None, None),
        (7, "P4", "Flat 9, 8 Mill Ln", None, None, None),  # a match without a price is one
    ]
    found = _match(spark, dwellings, sales)
    assert found == {1: (2, "exact"), 2: (4, "scored"), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None), 7: (7, "exact")}


def test_match_without_rows(spark):
    assert _match(spark, [], []) == {}


def test_nearest_matches_brute_force(spark):
    rng = random.Random(4)
    points = [(i, 51 + rng.random() * 0.5, rng.random() * 0.5) for i in range(60)] + [(98, 55.0, 3.0), (99, None, 1.0)]
    places = [(i, f"p{i}", "PRIMARY" if i % 2 else "SECONDARY", 51 + rng.random() * 0.5, rng.random() * 0.5) for i in range(40)]
    km = lambda a, b, c, d: 6371 * 2 * math.asin(math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2))
    p, q = spark.createDataFrame(points, "id long, latitude double, longitude double"), spark.createDataFrame(places, "src_ord long, name string, school_type string, latitude double, longitude double")
    found = {r["id"]: r for r in spatial.nearest_place(p, q, ["name"]).collect()}
    cell = lambda x: math.floor(x / 0.02)
    assert set(found) == {i for i, a, _ in points if a is not None}
    for i, a, b in points:
        if a is None:
            continue
        seen = [x for x in places if abs(cell(x[3]) - cell(a)) <= 2 and abs(cell(x[4]) - cell(b)) <= 2] or places
        assert abs(found[i]["km"] - min(km(a, b, x[3], x[4]) for x in seen)) < 1e-9
    schools = {r["id"]: r for r in spatial.school_summary(p, q).collect()}
    assert schools[99]["nearby_primary_schools_1km"] is None and schools[99]["nearest_school_name"] is None
    assert schools[98]["nearby_primary_schools_1km"] == 0
    assert abs(schools[98]["nearest_primary_school_distance_km"] - min(km(55.0, 3.0, x[3], x[4]) for x in places if x[2] == "PRIMARY")) < 1e-9


def test_comparables_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("AB") + "1", rng.choice(["S 1", "", None]), float(rng.choice([0, 20, 30, 31, 45, 60])), rng.choice(["Flat", "House", None]), f"a{i}", rng.choice([None, 40_000.0, 90_000.0, 120_000.0])) for i in range(80)] + [(200, "C1", "S 1", 33.0, None, "z", None)]
    df = spark.createDataFrame(rows, "id long, postcode_clean string, postcode_sector string, floor_area double, property_subtype string, full_address string, indexed_last_sold_price double")
    found = {r["id"]: r for r in comparables.comparable_estimates(df).collect()}
    for t in rows:
        good = [c for c in rows if c[0] != t[0] and c[6] and c[6] > 50_000 and c[3] > 10]
        near, source = [c for c in good if c[1] == t[1]], "same postcode"
        if len(near) < 2 and t[2]:
            near, source = [c for c in good if c[2] == t[2]], "postcode sector"
        best = sorted(near, key=lambda c: (abs(c[3] - t[3]) / max(t[3], 1) + (0 if c[4] == t[4] else 0.25), c[0]))[:3]
        if t[3] <= 0 or not best:
            assert t[0] not in found
            continue
        got = found[t[0]]
        assert (got["source"], got["addresses"], got["count"]) == (source, [c[5] for c in best], len(best))
        assert abs(got["estimate"] - t[3] * sum(c[6] / c[3] for c in best) / len(best)) < 1e-6


def test_no_pair_explosion_in_plans(spark):
    p = spark.createDataFrame([(1, 51.5, 0.1)], "id long, latitude double, longitude double")
    q = spark.createDataFrame([(1, "a", 51.5, 0.1)], "src_ord long, name string, latitude double, longitude double")
    d, s = spark.createDataFrame([], DWELLING), spark.createDataFrame([], SALE)
    for df in (spatial.nearest_place(p, q, ["name"]), matching.match_sales(d, s)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_estimate_chain(spark):
    from hearthline import schemas

    row = {"id": 1, "floor_area": 50.0, "postcode_average_per_sqm": 10_000.0, "last_sold_price": 600_000, "last_transfer_date": "2019-12-01", "epc_rating": "B", "nearest_station_distance_km": 0.4, "crime_level": "LOW"}
    df = tables.with_schema(spark.createDataFrame([row], "id long, floor_area double, postcode_average_per_sqm double, last_sold_price long, last_transfer_date string, epc_rating string, nearest_station_distance_km double, crime_level string"), schemas.FEATURES)
    got = valuation.estimates(df.unionByName(tables.with_schema(spark.createDataFrame([(2,)], "id long"), schemas.FEATURES)), comparables.comparable_estimates(df), datetime.date(2020, 1, 1)).orderBy("id").collect()
    assert (got[0]["estimated_price"], got[0]["price_min"], got[0]["price_max"]) == (626_053, 594_750, 657_356)
    assert got[1]["estimated_price"] is None and "There is not enough pricing data for this dwelling." in got[1]["explanations"]
    assert "Weights: sale 90%, area 9%." in got[0]["explanations"]


def test_blends(spark):
    mix = lambda b, m, c: spark.range(1).select(valuation.mixed_prediction(F.lit(b), F.lit(m), F.lit(c)).alias("x")).select("x.*").first()
    assert tuple(mix(1_000_000, 1_500_000, 0.6))[:6] == (1_175_000, 0.35, 0.65, 1.5, 0.5, "medium")
    assert tuple(mix(100, 260, 0.9))[:6] == (124, 0.15, 0.85, 2.6, 0.25, "low")
    assert tuple(mix(100, 0, 0.9))[:6] == (100, 0.0, 1.0, None, 0.15, "low")
    x = valuation.anchored_prediction(F.lit(300_000.0), F.lit(0.7), F.lit(600_000.0), F.lit("2018-12-01"), F.lit(None).cast("double"), F.lit(True), datetime.date(2020, 1, 1))
    assert tuple(spark.range(1).select(x.alias("x")).select("x.prediction", "x.confidence", "x.label").first()) == (555_000, 0.45, "medium")
    score = valuation.model_confidence(F.lit(100.0), F.lit(10.0), F.lit(2), F.lit(0.1))
    assert abs(spark.range(1).select(score).first()[0] - 0.77) < 1e-9


def test_learning(spark):
    near = spark.createDataFrame([(1, 1, 1.0, 10.0, 1), (1, 2, 2.0, 20.0, 2)], "id long, row_id long, distance double, y double, place int")
    got = learning.neighbour_means(near).first()
    assert abs(got["prediction"] - 13.3333) < 1e-3 and got["spread"] == 5.0
    rows = spark.createDataFrame([(i, "a" if i < 10 else "b" if i < 13 else "c") for i in range(15)], "k long, s string")
    parts = {(r["s"], r["part"]): r["count"] for r in learning.three_way_split(rows, "k", "s").groupBy("s", "part").count().collect()}
    assert parts == {("a", "train"): 7, ("a", "validation"): 2, ("a", "test"): 1, ("b", "train"): 1, ("b", "validation"): 1, ("b", "test"): 1, ("c", "train"): 2}
    assert learning.stratified_sample(rows, "k", "s", 6).count() == 6
    assert learning.stop_early([(10, 0.5), (20, 0.4), (30, 0.399), (40, 0.399), (50, 0.399), (60, 0.1)]) == 20


def test_sources(spark, tmp_path):
    (tmp_path / "pc.csv").write_text("pcd,pcds,oslaua,lat,long,extra\nSW7 1AA,SW7 1AA,E09000020,51.5,-0.17,x\nSW71AA,SW7 1AA,E09000020,1,1,x\nW1 1AA,W1 1AA,E09000033,bad,,x\nM1 1AA,M1 1AA,E08000003,53,-2,x\n")
    pc = readers.read_postcodes(spark, str(tmp_path / "pc.csv"))
    assert {(r["postcode_clean"], r["latitude"]) for r in pc.collect()} == {("SW71AA", 51.5), ("W11AA", None)}
    sale = '"t{}","{}","2001-02-03 00:00","SW7 1AA","F","N","L","12 - 14","FLAT 2","HIGH STREET","","LONDON","X","Y","A","{}"\n'
    (tmp_path / "sales").mkdir()
    (tmp_path / "sales" / "a.csv").write_text(sale.format(1, 100, "A") + sale.format(1, 200, "A") + sale.format(2, "x", "A") + sale.format(3, 300, "D"))
    got = readers.read_sales(spark, str(tmp_path / "sales"), pc).collect()
    assert [(r["transaction_id"], r["price"], r["house_number"], r["building_name"], r["full_address"]) for r in got] == [("t1", 100, "12", "12 - 14", "FLAT 2, 12 - 14, HIGH STREET, LONDON, SW7 1AA")]
    (tmp_path / "epc" / "d").mkdir(parents=True)
    (tmp_path / "epc" / "d" / "c.CSV").write_text("ADDRESS1,ADDRESS,POSTTOWN,POSTCODE,LOCAL_AUTHORITY_LABEL,CURRENT_ENERGY_RATING,TOTAL_FLOOR_AREA,CURRENT_ENERGY_EFFICIENCY,BUILT_FORM,PROPERTY_TYPE,LODGEMENT_DATE,more\nFlat 1,,London,SW7 1AA,K,C,50,70,Mid,Flat,2001-01-01,x\nFlat 1,,London,SW7 1AA,K,D,bad,70,Mid,Flat,2001-01-01,x\n")
    got = readers.read_certificates(spark, str(tmp_path / "epc"), pc).collect()
    assert [(r["epc_rating"], r["floor_area"], r["full_address"], r["latitude"]) for r in got] == [("D", None, "Flat 1, London, SW7 1AA", 51.5)]
    (tmp_path / "crime.csv").write_text("LSOA Code,LSOA Name,202001,202002,Borough\nE1,a,1,2,z\nE2,b,,10,z\nE3,c,100,,z\n")
    got = {r["crime_lsoa_code"]: (r["crime_total_12m"], r["crime_level"]) for r in readers.read_crime(spark, str(tmp_path / "crime.csv")).collect()}
    assert got == {"E1": (3.0, "LOW"), "E2": (10.0, "AVERAGE"), "E3": (100.0, "HIGH")}
    (tmp_path / "h.csv").write_text("Site Name,Lat,Postcode\nOne,50,SW7 1AA\nTwo,,ZZ\n")
    assert [(r["name"], r["latitude"]) for r in readers.read_hospitals(spark, str(tmp_path / "h.csv"), pc).collect()] == [("One", 51.5)]
    (tmp_path / "st.csv").write_text("Station,Latitude,Longitude,Zone\nA,51,0,1.0\n")
    assert readers.read_stations(spark, str(tmp_path / "st.csv")).count() == 0


def test_tables(spark, tmp_path):
    t = spark.createDataFrame([(1, "SW71AA", 1), (2, "W11AA", 2), (3, None, 3)], "id long, postcode_clean string, v int")
    new = tables.updated(t, spark.createDataFrame([(1, None), (2, 9)], "id long, v int"))
    assert {(r["id"], r["v"]) for r in new.collect()} == {(1, None), (2, 9), (3, 3)}
    assert tables.export_subset(t, str(tmp_path / "sub"), ["SW7"]) == 1
    assert tables.with_schema(t, "id long, w string").columns == ["id", "w"]
    assert api.data_coverage(t).first()["prefixes"] == ["SW7", "W1"] and api.data_coverage(t).first()["postcodes"] == 3
    assert [r[0] for r in api.postcode_suggestions(t, "sw").collect()] == ["SW71AA"] and api.postcode_suggestions(t, " ").count() == 0


def test_index_edges(spark):
    raw = spark.createDataFrame([("01/01/2001", "London", "100", "50", "1.0"), ("01/02/2001", "London", "0", None, "2.0"), ("x", "London", "1", "1", "1"), ("01/03/2001", "Leeds", "7", "7", "7")], "Date string, RegionName string, Index string, FlatIndex string, `12m%Change` string")
    d = spark.createDataFrame([(1, "House", "2001-01-09", 10), (2, "House", "2001-02-09", 10), (3, "Flat", "1999-01-01", 10)], "id long, property_subtype string, last_transfer_date string, last_sold_price long")
    got = {r["id"]: r for r in enrichment.attach_index(d, enrichment.price_index(raw)).collect()}
    assert got[1]["indexed_last_sold_price"] == 0.0 and got[2]["indexed_last_sold_price"] is None
    assert got[3]["london_hpi_current_index"] is None and got[3]["london_hpi_at_last_sale"] is None
