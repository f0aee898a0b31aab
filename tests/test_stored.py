"""Processed tables that notice other files and settings, ordered files, exports."""

import os
from pathlib import Path

import pytest

from hearthline.config import EngineConfig
from hearthline.plans.proxies import AS_OF, proxy, raw_file
from hearthline.plans.raw_run import HOSPITAL_FILES, Processed, _hospitals
from hearthline.sources import readers, tables

SF = "/root/testdata/sf0.001"


def raw(spark, folder):
    raw_file(spark, SF, "raw_postcodes", f"file://{folder}/postcodes.csv")
    raw_file(spark, SF, "raw_sales", f"file://{folder}/sales", header=False)
    return f"file://{folder}"


def sales(spark, folder, prefixes, refresh=False):
    found = Processed(spark, folder, EngineConfig(AS_OF, prefixes, refresh)).sales()
    return {tuple(r) for r in found.drop("sale_id").collect()}, found.inputFiles()


def test_other_prefixes_give_what_a_fresh_run_gives(spark, tmp_path):
    kept, runs = raw(spark, tmp_path / "kept"), [(), ("SW3",), ("SW3", "SW5"), ("SW3",), ()]
    found = [sales(spark, kept, p) for p in runs]
    for i, prefixes in enumerate(runs[:3]):
        assert found[i][0] == sales(spark, raw(spark, tmp_path / f"fresh{i}"), prefixes)[0]
    assert found[3] == found[1] and found[4] == found[0]  # read again, not made again
    assert len(found[1][0]) < len(found[2][0]) < len(found[0][0])


def test_changed_files_and_refresh(spark, tmp_path):
    folder = raw(spark, tmp_path)
    first = sales(spark, folder, ())
    assert sales(spark, folder, ())[1] == first[1]
    assert sales(spark, folder, (), refresh=True)[1] != first[1]
    part = sorted(Path(tmp_path / "sales").glob("part-*.csv"))[0]
    prices = {t[1]: t for t in first[0]}  # by transaction
    lines = [x.split(",") for x in part.read_text().splitlines()]
    row = next(x for x in lines if x[0] in prices and x[1] != "n/a" and int(float(x[1])) in prices[x[0]])
    row[0] = "NEW"
    (tmp_path / "sales" / "part-99999.csv").write_text(",".join(row) + "\n")
    again = sales(spark, folder, ())
    assert len(again[0]) == len(first[0]) + 1
    os.utime(part, (1, 1))
    assert sales(spark, folder, ())[1] != again[1]


def test_half_written_tables_are_made_again(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    made = []

    def make(n):
        made.append(n)
        return spark.range(n).repartition(3)

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        tables.read_through(spark, path, broken, version="v")
    tables.write_table(spark.range(99), f"{path}/v/data-of-a-broken-build")
    assert tables.read_through(spark, path, lambda: make(5), version="v").count() == 5
    for part in Path(tmp_path / "t/v/marker").glob("part-*"):  # as if the marker had not been finished
        part.unlink()
    old = tables.read_through(spark, path, lambda: make(6), version="v")
    assert old.count() == 6
    assert tables.read_through(spark, path, lambda: make(7), True, version="v").count() == 7
    assert old.count() == 6  # a reader of the former build is not disturbed
    assert tables.read_through(spark, path, lambda: make(8), version="v").count() == 7 and made == [5, 6, 7]
    assert tables.fingerprint(spark, [f"{path}/v"], 1) != tables.fingerprint(spark, [f"{path}/v"], 2)
    assert tables.fingerprint(spark, [f"{path}/none"]) == tables.fingerprint(spark, [f"{path}/none"])


def test_ordered_files(spark, tmp_path):
    """Many files, none with all rows; the first of repeated keys is the first by id, whatever file it is in."""
    path = raw_file(spark, SF, "raw_sales", f"file://{tmp_path}/sales", header=False)
    files = sorted(Path(tmp_path / "sales").glob("part-*.csv"))
    rows = [len(f.read_text().splitlines()) for f in files]
    total = proxy(spark, SF, "raw_sales").count()
    assert len(files) >= 8 and sum(rows) == total and max(rows) < total / 3
    ids = [r["ord"] for r in readers.with_order(spark.read.csv(path)).orderBy("ord").collect()]
    assert len(ids) == total
    want = [r["transaction_id"] for r in proxy(spark, SF, "raw_sales").orderBy("id").collect()]
    assert [r["_c0"] for r in readers.with_order(spark.read.csv(path)).orderBy("ord").collect()] == want


def test_first_hospital_file_counts(spark, tmp_path):
    none = spark.createDataFrame([], "postcode_clean string, latitude double, longitude double")
    assert _hospitals(spark, f"file://{tmp_path}", none).count() == 0
    for name in reversed(HOSPITAL_FILES):
        (tmp_path / name).write_text(f"Name,lat,lng\n{name},51.5,0.1\n")
        assert [r["name"] for r in _hospitals(spark, f"file://{tmp_path}", none).collect()] == [name]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"SW{i % 4 + 1}{i % 10}AB", None) for i in range(3000)] + [(9001, None, "x"), (9002, "AB", "y")], "id long, postcode_clean string, note string")
    paths = {f"file://{tmp_path}/{n}": rows.withColumnRenamed("note", n) for n in ("a", "b")}
    counts = tables.export_subsets(paths, ("SW1", "SW3"))
    assert set(counts.values()) == {1500}
    back = spark.read.parquet(f"file://{tmp_path}/a")
    assert back.count() == 1500 and {r["outward"] for r in back.select("outward").distinct().collect()} == {"SW1", "SW3"}
    plan = back.where("outward = 'SW1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(outward" in plan
    assert set(tables.export_subsets(paths, ()).values()) == {3002}
    for part in Path(tmp_path / "a/outward=SW1").glob("*.parquet"):
        seen = [r["postcode_clean"] for r in spark.read.parquet(f"file://{part}").collect()]
        assert seen == sorted(seen)
