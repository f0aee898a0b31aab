"""Connected components of a link table as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_hot, join_spread, materialize


def _star(edges: DataFrame, large: bool, total: int, most: int) -> DataFrame:
    """One step: every node's neighbours (the larger, or else the smaller ones and
    itself) are linked with the smallest of its neighbours and itself. total: rows
    of both directions, at most; nodes with a large part of them are dealt over many
    tasks. most: rows of one node, at most; where it isn't hot, a plain join does."""
    joined = (lambda around, least: join_spread(around, least, "u", total, "v")) if is_hot(most, total) else (lambda around, least: around.join(least, "u"))
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("count"))
        moved = joined(around, least).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("count"))
        moved = joined(around, least).select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.where("a < b").distinct()


def _shape(edges: DataFrame) -> tuple[int, int, int, int]:
    """The number of edges; of nodes that keep them from being stars: those below two
    others, or both below and above another; the most neighbours of a node; and the most smaller ones."""
    above = edges.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    below = edges.select(F.col("b").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below"))
    roles = above.unionAll(below).groupBy("node").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
    loose = (F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") > 0))
    found = (F.sum("below"), F.count_if(loose), F.max(F.col("above") + F.col("below")), F.max("below"))
    return tuple(roles.agg(*[F.coalesce(c, F.lit(0)) for c in found]).first())


def component_labels(links: DataFrame) -> DataFrame:
    """node and label (the smallest node that it reaches) of every node in links
    (a, b) other than the smallest of its component. Large and small stars
    alternate until every node has one node above it and none has both, a
    logarithmic number of times; each result is a table in the shared folder.
    Self-links, repeated links and nulls don't matter."""
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    while True:
        rows, loose, most, smaller = _shape(edges)
        if not loose:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
        # A large star gives no node more smaller neighbours than it had.
        edges = materialize(_star(_star(edges, True, 2 * rows, most), False, 2 * rows, smaller), "stars")
