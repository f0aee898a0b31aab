"""From raw files to estimates in one call, kept tables, and settings of the environment."""

import datetime

from pyspark.sql import functions as F

from hearthline.config import EngineConfig
from hearthline.operators import learning
from hearthline.plans.proxies import AS_OF, proxy, raw_file
from hearthline.plans.raw_run import Processed, features_from_files, value_files
from hearthline.sources import readers, tables

SF = "/root/testdata/sf0.001"


def raw_folder(spark, folder):
    for view, name, header in (("raw_postcodes", "postcodes.csv", True), ("raw_sales", "sales", False), ("raw_certificates", "certificates/of/a/year", True), ("raw_stations", "stations.csv", True), ("raw_schools", "schools.csv", True), ("raw_hospitals", "hospitals.csv", True)):
        raw_file(spark, SF, view, f"{folder}/{name}", header)
    crime = "LSOA Code,LSOA Name,202301,202302,note\n" + "".join(f"E010{i},Area {i},{i % 7},{i % 3},x\n" for i in range(120))
    index = "Date,RegionName,Index,FlatIndex,12m%Change\n" + "".join(f"01/{m:02d}/{y},London,{100 + y % 90 + m},{90 + m},1.5\n" for y in range(1995, 2002) for m in range(1, 13))
    for name, text in (("crime.csv", crime), ("price_index.csv", index)):
        (folder / name).write_text(text)


def test_from_files_to_estimates(spark, tmp_path):
    raw_folder(spark, tmp_path)
    config = EngineConfig(AS_OF, ())
    found = value_files(spark, f"file://{tmp_path}", config)
    rows = {r["id"]: r for r in found.collect()}
    kept = Processed(spark, f"file://{tmp_path}", config)
    certificates = kept.certificates()
    assert len(rows) == certificates.count() == certificates.select("id").distinct().count() > 50
    sales = {r["sale_id"]: r for r in kept.sales().collect()}
    assert len(sales) > 300 and {r["price"] for r in sales.values()} >= {r["last_sold_price"] for r in rows.values()} - {None}
    matched = [r for r in rows.values() if r["match_kind"]]
    assert matched and all(r["estimated_price"] and r["explanations"] for r in matched)
    assert {r["crime_level"] for r in rows.values()} >= {"LOW", "HIGH"} and any(r["nearest_hospital_name"] for r in rows.values())
    assert any(r["indexed_last_sold_price"] for r in rows.values()) and any(r["nearest_school_name"] for r in rows.values())
    before = features_from_files(spark, f"file://{tmp_path}", config).inputFiles()
    assert features_from_files(spark, f"file://{tmp_path}", config).inputFiles() == before
    assert features_from_files(spark, f"file://{tmp_path}", EngineConfig(AS_OF, (), refresh=True)).inputFiles() != before


def test_order_of_arrival(spark, tmp_path):
    """Files in the order of their names and rows as they stand, however large the files are."""
    for name, n in (("b.csv", 3), ("a.csv", 400), ("c.csv", 50)):
        (tmp_path / name).write_text("pcd,lsoa11\n" + "".join(f"SW1 {i % 2}AA,{name[0]}{i}\n" for i in range(n)))
    got = {r["postcode_clean"]: r["crime_lsoa_code"] for r in readers.read_postcode_areas(spark, f"file://{tmp_path}").collect()}
    assert got == {"SW10AA": "c48", "SW11AA": "c49"}


def test_settings(monkeypatch):
    day = datetime.date(2024, 5, 1)
    names = ("POSTCODE_PREFIXES", "REFRESH_PROCESSED_DATASETS", "ML_MAX_TRAINING_ROWS", "ML_MAX_TARGET_PRICE")
    for values, want in (
        ((None, None, None, None), EngineConfig(day)),
        ((" all ", "Yes", "FULL", "7"), EngineConfig(day, (), True, 0, 1_000_000)),
        (("w 8,ALL,, n1 ", "no", "20", "x"), EngineConfig(day, ("W8", "ALL", "N1"), False, 500, 50_000_000)),
        (("", "1", "9000", "2000000"), EngineConfig(day, (), True, 9000, 2_000_000)),
    ):
        for name, value in zip(names, values):
            monkeypatch.delenv(name, raising=False) if value is None else monkeypatch.setenv(name, value)
        assert EngineConfig.from_environment(day) == want


def test_file_or_table(spark, tmp_path):
    proxy(spark, SF, "props").createOrReplaceTempView("dwellings_of_test")
    path = f"file://{tmp_path}/dwellings"
    assert tables.table_or_file(spark, "dwellings_of_test", path).count() == proxy(spark, SF, "props").count()
    tables.write_table(spark.range(3), path)
    assert tables.table_or_file(spark, "dwellings_of_test", path).count() == 3


def test_medians_are_exact(spark):
    """Against the engine's own median: many values, few values, ties, none."""
    rows = spark.range(20_000).select((F.xxhash64("id") % 1000 / 7.0).alias("a"), F.when(F.col("id") < 3, F.col("id")).cast("double").alias("b"), (F.col("id") % 2).cast("double").alias("c"), F.lit(None).cast("double").alias("d"), F.lit(5.0).alias("e"))
    got = {r["feature"]: r["median"] for r in learning.numeric_statistics(rows, list("abcde")).collect()}
    want = rows.select(*[F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in "abcde"]).first().asDict()
    assert got == want


def test_neighbours_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 3)), 1)  # many equal distances
    train = [(i, x[i].tolist(), float(i)) for i in range(350)]
    asked = [(i, x[i].tolist()) for i in range(300, 400)]
    near = learning.nearest_rows(spark.createDataFrame(asked, "id long, vec array<double>"), spark.createDataFrame(train, "row_id long, vec array<double>, y double"), 6)
    got = {}
    for r in near.orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["row_id"])
    for i, v in asked:
        distance = np.sqrt(((x[:350] - v) ** 2).sum(1))
        assert got[i] == np.lexsort((np.arange(350), distance))[:6].tolist()
