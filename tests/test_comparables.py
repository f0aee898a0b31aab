"""Comparables of a sector that holds all rows, cut into many ranges, against a loop."""

import random

import pytest

from hearthline.operators.comparables import comparable_estimates

SCHEMA = "id long, postcode_clean string, postcode_sector string, floor_area double, property_subtype string, full_address string, indexed_last_sold_price double"


def brute(rows):
    out = {}
    for t in rows:
        good = [c for c in rows if c[0] != t[0] and c[6] and c[6] > 50_000 and c[3] and c[3] > 10]
        near, source = [c for c in good if c[1] == t[1]], "same postcode"
        if len(near) < 2 and t[2]:
            near, source = [c for c in good if c[2] == t[2]], "postcode sector"
        if not t[3] or t[3] <= 0 or not near:
            continue
        best = sorted(near, key=lambda c: (abs(c[3] - t[3]) / max(t[3], 1) + (0 if c[4] == t[4] else 0.25), c[0]))[:3]
        out[t[0]] = (source, [c[5] for c in best], round(t[3] * sum(c[6] / c[3] for c in best) / len(best), 6))
    return out


@pytest.mark.parametrize("partitions, seed", [("4", 1), ("97", 2)])
def test_one_sector_of_all_rows(spark, partitions, seed):
    """Sizes all different or repeated, most of them unsold, types rare and common; ranges of a few sizes each."""
    rng = random.Random(seed)
    sizes = [rng.random() * 300 for _ in range(120)] + [50.0, 60.0, 61.0]
    rows = [(i, f"P{i}" if i % 3 else "P", "S 1", rng.choice([rng.choice(sizes), rng.random() * 300, None]), rng.choice(["Flat"] * 6 + ["House", "Tower", None]), f"a{i}", rng.choice([None, None, None, 40_000.0, 90_000.0, 120_000.0])) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {r["id"]: (r["source"], r["addresses"], round(r["estimate"], 6)) for r in comparable_estimates(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == brute(rows) and len(found) > 300


def test_no_window_over_a_whole_group(spark):
    df = spark.createDataFrame([(1, "P", "S 1", 50.0, "Flat", "a", 90_000.0)], SCHEMA)
    plan = comparable_estimates(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line.split("windowspecdefinition(")[1] for line in plan.splitlines() if "Window [" in line]
    assert windows and all("size" in w.split(" ASC")[0] or "part" in w.split(" ASC")[0] or "id" in w.split(" ASC")[0] for w in windows)
