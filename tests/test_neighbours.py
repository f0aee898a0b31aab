"""Exact neighbours from few blocks: against brute force, and fewer blocks than all."""

import numpy as np
import pytest

from hearthline.operators import learning

ROW, QUERY = "row_id long, vec array<double>, y double", "id long, vec array<double>"


def brute(train, asked, k):
    x = np.array([v for _, v, _ in train])
    ids = np.array([i for i, _, _ in train])
    out = {}
    for i, v in asked:
        distance = np.sqrt(((x - v) ** 2).sum(1))
        out[i] = ids[np.lexsort((ids, distance))[:k]].tolist()
    return out


def found(near):
    out = {}
    for r in near.orderBy("id", "place").collect():
        out.setdefault(r["id"], []).append(r["row_id"])
    return out


def clusters(rng, n, dim=6):
    centres = rng.normal(size=(12, dim)) * 20
    x = np.round(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)), 1)
    x[: n // 3] = x[0]  # a third of all rows are one vector
    return x


@pytest.mark.parametrize("block, rings", [(4096, 32), (40, 4), (25, 1)])
def test_equals_brute_force(spark, monkeypatch, block, rings):
    """One block and many; rows that are one vector, equal distances, queries far from all rows."""
    monkeypatch.setattr(learning, "BLOCK", block)
    monkeypatch.setattr(learning, "RINGS", rings)
    rng = np.random.default_rng(5)
    x = clusters(rng, 600)
    train = [(i, x[i].tolist(), float(i)) for i in range(500)]
    asked = [(i, x[i].tolist()) for i in range(450, 600)] + [(900, [500.0] * 6), (901, x[0].tolist())]
    near = learning.nearest_rows(spark.createDataFrame(asked, QUERY), spark.createDataFrame(train, ROW), 7)
    assert found(near) == brute(train, asked, 7)


def test_few_blocks_are_met(spark, monkeypatch):
    monkeypatch.setattr(learning, "BLOCK", 40)
    monkeypatch.setattr(learning, "RINGS", 4)
    rng = np.random.default_rng(6)
    x = clusters(rng, 3000)
    train = spark.createDataFrame([(i, x[i].tolist(), 0.0) for i in range(2500)], ROW)
    blocks = learning.Blocks.of(train)
    sizes = [r["count"] for r in blocks.rows.groupBy("cell", "ring", "salt").count().collect()]
    assert sum(sizes) == 2500 and max(sizes) < 3 * 40 and len(sizes) > 40
    asked = blocks.own(spark.createDataFrame([(i, x[i].tolist()) for i in range(2500, 3000)], QUERY))
    first = blocks.met(asked, 500, 5)
    visits = learning.block_visits(blocks, asked, first, 5).count()
    assert visits < 500 * len(sizes) / 4


def test_few_rows(spark):
    asked = spark.createDataFrame([(1, [0.0, 1.0])], QUERY)
    assert learning.nearest_rows(asked, spark.createDataFrame([], ROW), 3).count() == 0
    assert found(learning.nearest_rows(asked, spark.createDataFrame([(5, [0.0, 2.0], 1.0), (4, [0.0, 0.0], 1.0)], ROW), 3)) == {1: [4, 5]}
    assert learning.nearest_rows(asked.limit(0), spark.createDataFrame([(5, [0.0, 2.0], 1.0)], ROW), 3).count() == 0
