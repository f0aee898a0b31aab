"""Nearest places, and numbers of places within a radius, by summaries of cells.

Places at one location are one point with its numbers by kind, and points of
dwellings are met once each. A dwelling sees the places in its window of five by
five cells. Cells are cut into FINE parts each way; for two such parts the least and
greatest distance of anything in them are known, so that per part of a cell, and not per
dwelling, it is settled which other parts lie within a radius as a whole (their
numbers are added), which lie outside, and which can hold the nearest place. Only
what is left, the parts on a radius' edge and those as near as the nearest, is met point by
point. Where a point sees nothing, cells are made four times as large until what is
found is certainly the nearest.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import CELL_DEGREES, EARTH_KM, REACH, haversine_km
from ..sources.tables import staged

LEVELS = 7
#: Parts of a cell each way.
FINE = 8
#: Degrees by which rounding may put a point outside its part, and the like for distances.
SLACK_DEGREES, SLACK = 1e-9, 1e-9
_PART, _AT = ["ci", "cj", "si", "sj"], ["latitude", "longitude"]


@dataclasses.dataclass(frozen=True)
class Kind:
    """Places that a condition picks out, to be counted within km (if it is given)."""

    name: str
    condition: Column
    km: float | None = None


def _parts(lat: Column, lon: Column, side: float) -> list[Column]:
    """The cell of a location, as the window knows it, and the part within it."""
    out = []
    for x, cell, part in ((lat, "ci", "si"), (lon, "cj", "sj")):
        at = F.floor(x / F.lit(side))
        within = F.floor((x - at * F.lit(side)) / F.lit(side / FINE))
        out += [at.alias(cell), F.greatest(F.lit(0), F.least(F.lit(FINE - 1), within)).cast("int").alias(part)]
    return [out[0], out[2], out[1], out[3]]


def _edges(side: float, prefix: str = "") -> list[Column]:
    """The box around a part, a little wider than the part."""
    out = []
    for cell, part, name in (("ci", "si", "lat"), ("cj", "sj", "lon")):
        low = F.col(f"{prefix}{cell}") * F.lit(side) + F.col(f"{prefix}{part}") * F.lit(side / FINE)
        out += [(low - SLACK_DEGREES).alias(f"{prefix}{name}_lo"), (low + side / FINE + SLACK_DEGREES).alias(f"{prefix}{name}_hi")]
    return out


def _between(least: bool) -> Column:
    """The least or greatest distance between two boxes, in km, or something a little beyond it."""
    gaps = []
    for name in ("lat", "lon"):
        lo, hi, q_lo, q_hi = (F.col(f"{p}{name}_{e}") for p in ("", "q_") for e in ("lo", "hi"))
        gaps.append(F.greatest(q_lo - hi, lo - q_hi, F.lit(0.0)) if least else F.greatest(q_hi - lo, hi - q_lo))
    shrink = F.lit(1.0)
    for p in ("", "q_"):
        lo, hi = F.col(f"{p}lat_lo"), F.col(f"{p}lat_hi")
        outer = F.greatest(F.abs(lo), F.abs(hi))
        inner = F.when((lo <= 0) & (hi >= 0), 0.0).otherwise(F.least(F.abs(lo), F.abs(hi)))
        shrink = shrink * F.greatest(F.cos(F.radians(outer if least else inner)), F.lit(0.0))
    half = [F.pow(F.sin(F.radians(F.least(g, F.lit(180.0))) / 2), F.lit(2.0)) for g in gaps]
    km = 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), half[0] + shrink * half[1])))
    return km * (1 - SLACK if least else 1 + SLACK)


def place_points(places: DataFrame, kinds: list[Kind], columns: list[str]) -> DataFrame:
    """One row for each location with places: the first of them to arrive, and the number of each kind."""
    first = [F.min("src_ord").alias("src_ord"), F.min_by(F.struct(*columns, F.lit(0).alias("_")), "src_ord").alias("first")]
    return places.groupBy("p_lat", "p_lon").agg(*first, *[F.count_if(k.condition).alias(f"n_{k.name}") for k in kinds])


def meetings(points: DataFrame, there: DataFrame, kinds: list[Kind], side: float = CELL_DEGREES) -> DataFrame:
    """points: latitude and longitude, each once. there: place_points. The pairs that decide
    the nearest place of each kind and the numbers within radii: latitude, longitude,
    the place point with km, d_lat and d_lon (the window's cells, in the order in which
    ties are broken), in_<kind> (the number known from whole parts) and edge_<kind>
    (whether this pair's part is on the radius' edge)."""
    here = points.select("latitude", "longitude", *_parts(F.col("latitude"), F.col("longitude"), side))
    placed = there.select("*", *_parts(F.col("p_lat"), F.col("p_lon"), side)).withColumnsRenamed({c: f"q_{c}" for c in _PART})
    counts = [F.sum(f"n_{k.name}").alias(f"n_{k.name}") for k in kinds]
    steps = F.sequence(F.lit(-REACH), F.lit(REACH))
    their = placed.groupBy(*[f"q_{c}" for c in _PART]).agg(*counts).select("*", *_edges(side, "q_"))
    spread = their.withColumn("d_lat", F.explode(steps)).withColumn("d_lon", F.explode(steps))
    spread = spread.withColumn("ci", F.col("q_ci") - F.col("d_lat")).withColumn("cj", F.col("q_cj") - F.col("d_lon"))
    mine = here.select(*_PART).distinct().select("*", *_edges(side))
    pairs = mine.join(spread, ["ci", "cj"]).withColumn("low", _between(True)).withColumn("high", _between(False))
    part = Window.partitionBy(*_PART)  # as many rows as a window has parts, at most
    wanted = F.lit(False)
    for k in kinds:
        some = F.col(f"n_{k.name}") > 0
        pairs = pairs.withColumn(f"near_{k.name}", F.min(F.when(some, F.col("high"))).over(part))
        whole = F.lit(0) if k.km is None else F.coalesce(F.sum(F.when(F.col("high") <= k.km, F.col(f"n_{k.name}"))).over(part), F.lit(0))
        edge = F.lit(False) if k.km is None else some & (F.col("low") <= k.km) & (F.col("high") > k.km)
        pairs = pairs.withColumn(f"in_{k.name}", whole).withColumn(f"edge_{k.name}", edge)
        wanted = wanted | (some & (F.col("low") <= F.col(f"near_{k.name}"))) | F.col(f"edge_{k.name}")
    q_part = [f"q_{c}" for c in _PART]
    found = pairs.where(wanted).select(*_PART, *q_part, "d_lat", "d_lon", *[f"{x}_{k.name}" for k in kinds for x in ("in", "edge")])
    met = here.join(found, _PART).join(placed, q_part)
    return met.withColumn("km", haversine_km(F.col("latitude"), F.col("longitude"), F.col("p_lat"), F.col("p_lon"))).drop(*_PART, *q_part)


def _located(points: DataFrame) -> DataFrame:
    return points.select("id", "latitude", "longitude").where("latitude is not null and longitude is not null")


def _placed(places: DataFrame) -> DataFrame:
    usable = places.where("latitude is not null and longitude is not null")
    return usable.withColumnRenamed("latitude", "p_lat").withColumnRenamed("longitude", "p_lon")


def any_place() -> Kind:
    return Kind("any", F.lit(True))


def tie_order() -> Column:
    return F.struct("km", "d_lat", "d_lon", "src_ord")


def _farther(points: DataFrame, there: DataFrame, columns: list[str]) -> DataFrame:
    """The nearest over all place points, ties by arrival, for locations that see none (one at least)."""
    left, found = points, None
    for level in range(1, LEVELS):
        side = CELL_DEGREES * 4**level
        near = meetings(left, there, [any_place()], side).groupBy(*_AT).agg(F.min_by(F.struct("first", "km"), F.struct("km", "src_ord")).alias("x"))
        sure = F.lit(0.5 * REACH * side * math.pi / 180 * EARTH_KM) * F.cos(F.radians("latitude"))  # well inside the window's edge
        settled = staged(near.where((F.col("x.km") <= sure) | F.lit(level == LEVELS - 1)).select(*_AT, *[F.col(f"x.first.{c}").alias(c) for c in columns], "x.km"), "settled")
        found = settled if found is None else found.unionByName(settled)
        left = staged(left.join(settled.select(*_AT), _AT, "left_anti"), "unsettled")
        if left.isEmpty():
            break
    return found


def _blind(points: DataFrame, places: DataFrame) -> DataFrame:
    """The points in whose window there is no place: by the cells that places are seen from, without pairs."""
    steps = F.sequence(F.lit(-REACH), F.lit(REACH))
    side = F.lit(CELL_DEGREES)
    home = places.select(F.floor(F.col("p_lat") / side).alias("ci"), F.floor(F.col("p_lon") / side).alias("cj")).distinct()
    around = home.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
    seen_from = around.select((F.col("ci") + F.col("di")).alias("ci"), (F.col("cj") + F.col("dj")).alias("cj")).distinct()
    cells = points.withColumn("ci", F.floor(F.col("latitude") / side)).withColumn("cj", F.floor(F.col("longitude") / side))
    return staged(cells.join(seen_from, ["ci", "cj"], "left_anti").drop("ci", "cj"), "blind")


def _first_columns(x: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{x}.first.{c}").alias(c) for c in columns]


def nearest_place(points: DataFrame, places: DataFrame, columns: list[str]) -> DataFrame:
    """id, the columns of the nearest place, and km. Points without coordinates
    are left out, as all are where there is no place."""
    here = _located(points)
    at, there = here.select(*_AT).distinct(), staged(place_points(_placed(places), [any_place()], columns), "places")
    near = meetings(at, there, [any_place()]).groupBy(*_AT).agg(F.min_by(F.struct("first", "km"), tie_order()).alias("x")).select(*_AT, *_first_columns("x", columns), "x.km")
    blind = _blind(at, there)
    if not blind.isEmpty():
        near = near.unionByName(_farther(blind, there, columns))
    return here.join(near, _AT).drop(*_AT)


def school_summary(points: DataFrame, schools: DataFrame) -> DataFrame:
    """Nearest school of any kind and of each kind in the window (beyond it for
    points that see none), primary ones within 1 km, secondary ones within 2 km.
    Counts are 0 for located points and null for others."""
    kinds = [any_place(), *[Kind(name, F.col("school_type") == name, km) for name, km in (("PRIMARY", 1.0), ("SECONDARY", 2.0))]]
    columns = ["name", "school_type"]
    at, there = _located(points).select(*_AT).distinct(), staged(place_points(_placed(schools), kinds, columns), "schools")
    nearest_of = lambda name: F.min(F.when(F.col(f"n_{name}") > 0, F.col("km")))
    edge = lambda k: F.sum(F.when(F.col(f"edge_{k.name}") & (F.col("km") <= k.km), F.col(f"n_{k.name}")).otherwise(0))
    summed = meetings(at, there, kinds).groupBy(*_AT).agg(
        F.min_by(F.struct("first.name", "first.school_type", "km"), tie_order()).alias("x"),
        nearest_of("PRIMARY").alias("nearest_primary_school_distance_km"),
        nearest_of("SECONDARY").alias("nearest_secondary_school_distance_km"),
        (F.max("in_PRIMARY") + edge(kinds[1])).alias("nearby_primary_schools_1km"),
        (F.max("in_SECONDARY") + edge(kinds[2])).alias("nearby_secondary_schools_2km"),
    )
    blind = _blind(at, there)
    joined = at.join(summed, _AT, "left")
    if blind.isEmpty():
        far = {"far": F.lit(None).cast("struct<name:string,school_type:string,km:double>")}
        joined = joined.withColumns(far | {f"far_{name}": F.lit(None).cast("double") for name in ("PRIMARY", "SECONDARY")})
    else:
        joined = joined.join(_farther(blind, there, columns).select(*_AT, F.struct("name", "school_type", "km").alias("far")), _AT, "left")
        for name in ("PRIMARY", "SECONDARY"):
            only = _farther(blind, there.where(F.col(f"n_{name}") > 0), []).select(*_AT, F.col("km").alias(f"far_{name}"))
            joined = joined.join(only, _AT, "left")
    joined = points.select("id", *_AT).join(joined, _AT, "left")
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    nearest = F.coalesce("x", "far")
    of_kind = lambda name, c: F.coalesce(F.col(c), F.col(f"far_{name}")).alias(c)
    counted = lambda c: F.when(located, F.coalesce(F.col(c), F.lit(0))).cast("int").alias(c)
    return joined.select(
        "id",
        nearest["name"].alias("nearest_school_name"),
        nearest["school_type"].alias("nearest_school_type"),
        nearest["km"].alias("nearest_school_distance_km"),
        of_kind("PRIMARY", "nearest_primary_school_distance_km"),
        of_kind("SECONDARY", "nearest_secondary_school_distance_km"),
        counted("nearby_primary_schools_1km"),
        counted("nearby_secondary_schools_2km"),
    )
