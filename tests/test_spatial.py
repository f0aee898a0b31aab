"""Cell summaries against a loop over all places: nothing may be lost at edges, on borders or to ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hearthline.operators import spatial

POINT, PLACE = "id long, latitude double, longitude double", "src_ord long, name string, school_type string, latitude double, longitude double"


def km(a, b, c, d):
    h = math.pow(math.sin(math.radians(c - a) / 2), 2.0) + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.pow(math.sin(math.radians(d - b) / 2), 2.0)
    return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def cell(x):
    return math.floor(x / 0.02)


def brute(points, places):
    out = {}
    for i, a, b in points:
        if a is None or b is None:
            out[i] = (None,) * 7
            continue
        seen = [(km(a, b, x, y), cell(x) - cell(a), cell(y) - cell(b), o, name, kind) for o, name, kind, x, y in places if x is not None and abs(cell(x) - cell(a)) <= 2 and abs(cell(y) - cell(b)) <= 2]
        if seen:
            best = min(seen)
            of = lambda kind: min((s[0] for s in seen if s[5] == kind), default=None)
        else:
            far = [(km(a, b, x, y), o, name, kind) for o, name, kind, x, y in places if x is not None]
            best = (f := min(far))[0], 0, 0, f[1], f[2], f[3]
            of = lambda kind: min((s[0] for s in far if s[3] == kind), default=None)
        count = lambda kind, r: sum(s[5] == kind and s[0] <= r for s in seen)
        out[i] = (best[4], best[5], best[0], of("PRIMARY"), of("SECONDARY"), count("PRIMARY", 1.0), count("SECONDARY", 2.0))
    return out


def same(got, want):
    assert set(got) == set(want)
    for i, w in want.items():
        for g, x in zip(got[i], w):
            assert (g is None) == (x is None) and (abs(g - x) < 1e-9 if isinstance(x, float) else g == x), (i, got[i], w)


LATTICE = lambda rng, lat: (lat + rng.randrange(0, 120) / 1000, rng.randrange(-80, 80) / 1000)
ANYWHERE = lambda rng, lat: (lat + rng.random() * 0.12, rng.random() * 0.16 - 0.08)


@pytest.mark.parametrize("lat, where, seed", [(51.4, LATTICE, 1), (51.4, ANYWHERE, 2), (-0.05, ANYWHERE, 3), (68.0, LATTICE, 4)])
def test_equals_brute_force(spark, lat, where, seed):
    """On borders of cells and between them, across the equator and the meridian, far
    north; many places at one location, equal distances, and points that see nothing."""
    rng = random.Random(seed)
    spots = [where(rng, lat) for _ in range(60)]
    places = [(i, f"n{i}", rng.choice(["PRIMARY", "SECONDARY", "OTHER"]), *rng.choice([rng.choice(spots), where(rng, lat)])) for i in range(400)]
    places += [(1000, "nowhere", "PRIMARY", None, 0.0)]
    points = [(i, *rng.choice([rng.choice(spots), where(rng, lat)])) for i in range(150)] + [(900, None, 0.0), (901, lat + 3.0, 1.0), (902, lat + 3.0, 1.0)]
    p, q = spark.createDataFrame(points, POINT), spark.createDataFrame(places, PLACE)
    want = brute(points, places)
    same({r[0]: tuple(r)[1:] for r in spatial.school_summary(p, q).collect()}, want)
    near = {r["id"]: (r["name"], r["km"]) for r in spatial.nearest_place(p, q, ["name"]).collect()}
    same(near, {i: (w[0], w[2]) for i, w in want.items() if w[0] is not None})


def test_few_pairs_are_met(spark):
    """Ten times the dwellings and places at the same locations meet no more; at locations
    of their own, parts on the edge are a small share of all pairs in the window."""
    rng = random.Random(5)
    spots = [LATTICE(rng, 51.4) for _ in range(50)]
    few = [(i, f"n{i}", "PRIMARY", *spots[i % 50]) for i in range(50)]
    many = [(i, f"n{i}", "PRIMARY", *spots[i % 50]) for i in range(500)]
    own = [(i, f"n{i}", "PRIMARY", *ANYWHERE(rng, 51.4)) for i in range(2000)]
    kinds = [spatial.any_place(), spatial.Kind("PRIMARY", F.col("school_type") == "PRIMARY", 1.0)]
    at = spark.createDataFrame([(i, *ANYWHERE(rng, 51.4)) for i in range(300)], POINT).select("latitude", "longitude").distinct()

    def met(places):
        there = spatial.place_points(spark.createDataFrame(places, PLACE).withColumnsRenamed({"latitude": "p_lat", "longitude": "p_lon"}), kinds, ["name"])
        return spatial.meetings(at, there, kinds).count()

    assert met(few) == met(many)
    assert met(own) < 300 * 2000 / 8


def test_no_places(spark):
    p = spark.createDataFrame([(1, 51.5, 0.1), (2, None, None)], POINT)
    q = spark.createDataFrame([], PLACE)
    assert spatial.nearest_place(p, q, ["name"]).count() == 0
    assert {tuple(r) for r in spatial.school_summary(p, q).collect()} == {(1, None, None, None, None, None, 0, 0), (2, None, None, None, None, None, None, None)}
