"""Local comparables: the three sold dwellings nearest in size, from the postcode
or else the sector.

No dwelling meets its whole group. Within a group, those of one size (and, for
the bonus of an equal type, of one size and type) are one entry with the smallest
ids, and each entry looks at its neighbours in order of size: the three best are
among three sizes either way. Sizes are cut into ranges that see a little of the
ranges beside them, so that a group may hold any part of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import staged

WANTED = 3
#: What another type costs; the least area and price that count.
OTHER_TYPE, LEAST_AREA, LEAST_PRICE = 0.25, 10.0, 50_000.0


def sold_dwellings(features: DataFrame) -> DataFrame:
    return features.where((F.col("floor_area") > LEAST_AREA) & (F.col("indexed_last_sold_price") > LEAST_PRICE))


def _beside(column: str, over: str) -> Column:
    """The WANTED values of a column before and after a row, as far as there are any; rows without one are passed over."""
    both = [f"{way}({column}, {i}) ignore nulls over ({over})" for way in ("lag", "lead") for i in range(1, WANTED + 1)]
    return F.array_compact(F.array(*map(F.expr, both)))


def _near_in_size(targets: DataFrame, sold: DataFrame, key: str) -> DataFrame:
    """id and candidates of each target: the sold of its key, and of its key and type, at
    its own size and up to three sizes below and above.

    All sizes, sorted by key, type and size, are cut into ranges; a range looks
    within itself and at the outermost entries of the ranges beside it, so that no task
    sorts a key, however many sizes it has."""
    # of one type (null is one), and of any
    kinds = F.explode(F.array(F.coalesce(F.concat(F.lit("="), "property_subtype"), F.lit("")), F.lit("*"))).alias("kind")
    group = ["k", "kind"]
    one = F.struct(F.col("id").alias("other"), F.col("floor_area").alias("area"), F.col("property_subtype").alias("subtype"), F.col("indexed_last_sold_price").alias("price"), F.col("full_address").alias("address"))
    rows = sold.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), kinds, F.col("floor_area").alias("size"), one.alias("one"))
    first = Window.partitionBy(*group, "size").orderBy("one.other")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= WANTED + 1)
    entries = few.groupBy(*group, "size").agg(F.collect_list("one").alias("here"))  # four at most
    tied = targets.where(F.col(key).isNotNull()).select("id", F.col(key).alias("k"), kinds, F.col("floor_area").alias("size"))
    both = entries.unionByName(tied.select(*group, "size").distinct().withColumn("here", F.lit(None).cast(entries.schema["here"].dataType)))
    merged = both.groupBy(*group, "size").agg(F.max("here").alias("here"))
    order = [*group, "size"]
    ranged = staged(merged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "sizes")
    near = ranged.withColumn("near", _beside("here", "partition by part, k, kind order by size"))
    # the outermost entries of each range, and of the nearest ranges that have any what lies next to it
    out = [F.row_number().over(Window.partitionBy("part", *group).orderBy(c)) <= WANTED for c in (F.asc("size"), F.desc("size"))]
    outer = ranged.where("here is not null").withColumn("outer", out[0] | out[1]).where("outer").groupBy("part", *group).agg(F.flatten(F.collect_list("here")).alias("ends"))
    parts = ranged.select("part", *group).distinct().join(outer, ["part", *group], "left")
    halos = parts.select("part", *group, F.flatten(_beside("ends", "partition by k, kind order by part")).alias("halo"))
    around = F.concat(F.coalesce("here", F.array().cast(ranged.schema["here"].dataType)), F.flatten("near"), F.when(F.size("near") < 2 * WANTED, F.col("halo")).otherwise(F.array()))
    lookup = near.join(halos, ["part", *group]).select(*order, around.alias("near"))
    return tied.join(lookup, order).select("id", F.explode("near").alias("c"))


def _comparables_at(targets: DataFrame, sold: DataFrame, key: str) -> DataFrame:
    """id and the best comparables of one level, nearest first, ties to the smaller id."""
    met = _near_in_size(targets, sold, key).select("id", "c.*").where("id <> other").distinct()
    joined = met.join(targets.select("id", "floor_area", "property_subtype"), "id")
    penalty = F.when(F.col("subtype").eqNullSafe(F.col("property_subtype")), 0.0).otherwise(OTHER_TYPE)
    gap = F.abs(F.col("area") - F.col("floor_area")) / F.greatest("floor_area", F.lit(1.0)) + penalty
    best = Window.partitionBy("id").orderBy("gap", "other")
    return joined.withColumn("gap", gap).withColumn("n", F.row_number().over(best)).where(F.col("n") <= WANTED)


def _candidates(targets: DataFrame, sold: DataFrame, key: str) -> DataFrame:
    """id and the number of sold dwellings of its key, itself left out."""
    counts = sold.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    own = ((F.col("floor_area") > LEAST_AREA) & (F.col("indexed_last_sold_price") > LEAST_PRICE)).cast("int")
    mine = targets.select("id", F.col(key).alias("k"), F.coalesce(own, F.lit(0)).alias("own"))
    return mine.join(counts, "k", "left").select("id", (F.coalesce("n", F.lit(0)) - F.when(F.col("n").isNotNull(), F.col("own")).otherwise(0)).alias("n"))


def comparable_estimates(features: DataFrame) -> DataFrame:
    """id, estimate, average_per_sqm, count, source and addresses, for dwellings
    with an area and a comparable. The sector replaces the postcode where that has
    fewer than two candidates and the sector is known."""
    slim = staged(features.select("id", "postcode_clean", "postcode_sector", "floor_area", "property_subtype", "full_address", "indexed_last_sold_price"), "comparables")
    sold, targets = sold_dwellings(slim), slim.where("floor_area > 0")
    level = F.when((F.col("n") < 2) & (F.coalesce("postcode_sector", F.lit("")) != ""), "postcode sector").otherwise("same postcode")
    leveled = staged(targets.join(_candidates(targets, sold, "postcode_clean"), "id").withColumn("source", level), "leveled")
    found = _comparables_at(leveled.where("source = 'same postcode'"), sold, "postcode_clean").withColumn("source", F.lit("same postcode"))
    found = found.unionByName(_comparables_at(leveled.where("source = 'postcode sector'"), sold, "postcode_sector").withColumn("source", F.lit("postcode sector")))
    mean = F.avg(F.col("price") / F.col("area"))
    addresses: Column = F.transform(F.array_sort(F.collect_list(F.struct("n", "address"))), lambda x: x["address"])
    grouped = found.groupBy("id", "floor_area", "source").agg(mean.alias("average_per_sqm"), F.count("*").cast("int").alias("count"), addresses.alias("addresses"))
    return grouped.select("id", (F.col("average_per_sqm") * F.col("floor_area")).alias("estimate"), "average_per_sqm", "count", "source", "addresses")
