"""Nearest neighbours: recall against brute force, exact scores, ties and unusable vectors."""

import numpy as np

from hearthline.llm import nearest as A

from . import helpers as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, every, k):
    found = {}
    for i, q in rows:
        if i % every == 0:
            scored = sorted((-float(np.dot(np.float64(q), np.float64(v))), j) for j, v in rows if j != i)
            found[i] = [(j, -s) for s, j in scored[:k]]
    return found


def collected(df):
    found: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def check(spark, rows, every, k, least):
    got = collected(A.nearest_neighbours(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), every, k))
    want = brute_force(rows, every, k)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, found in want.items():
        score = dict(brute_force([(i, v) for i, v in rows], 1, len(rows))[q]) if len(rows) < 60 else None
        assert len(got[q]) == len(found)
        hits, total = hits + len({j for j, _ in got[q]} & {j for j, _ in found}), total + len(found)
        vectors = dict(rows)
        for j, s in got[q]:
            assert abs(s - float(np.dot(np.float64(vectors[q]), np.float64(vectors[j])))) < 1e-9
            assert score is None or abs(score[j] - s) < 1e-9
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    assert hits / total >= least


def test_recall_on_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{H.SF}/embeddings.parquet").collect()]
    check(spark, rows, 20, 20, 0.9)


def test_recall_with_lengths_and_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 24))) * rng.uniform(0.2, 3, (1500, 1))
    check(spark, [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], 25, 10, 0.9)


def test_fewer_candidates_than_wanted(spark):
    check(spark, [(i, [float(i + 1), 1.0, -1.0]) for i in range(7)], 2, 20, 1.0)


def test_ties_and_unusable(spark):
    same = [(i, [1.0, 0.0], 0) for i in range(0, 200, 4)]
    odd = [(1, [2.0, 0.0], 0), (3, None, 0), (5, [0.0, 0.0], 0), (7, [1.0, None], 0), (9, [float("nan"), 1.0], 0), (11, [float("inf"), 1.0], 0), (13, [1.0], 0), (None, [1.0, 0.0], 0), (15, [], 0)]
    got = collected(A.nearest_neighbours(spark.createDataFrame(same + odd + same[:3], SCHEMA), 20, 5))
    assert set(got) == set(range(0, 200, 20))
    for q, found in got.items():
        assert found == [(1, 2.0)] + [(j, 1.0) for j in range(0, 200, 4) if j != q][:4]
    assert A.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert A.nearest_neighbours(spark.createDataFrame(odd[1:4], SCHEMA)).count() == 0


def test_small_places_and_several_rotations(spark, monkeypatch):
    """Places, turns and buckets of two rotations: blocks of 64 vectors make all of them."""
    monkeypatch.setattr(A, "BLOCK", 64)
    monkeypatch.setattr(A, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 8))[rng.integers(0, 30, 1500)] + 0.2 * rng.normal(size=(1500, 8))
    assert A.Hashing(1.0, 0.1, 8, 1500).hashes == 1 and A.Hashing(1.0, 0.1, 8, 5000).hashes == 2
    monkeypatch.setattr(A, "BLOCK", 32)
    assert A.Hashing(10.0, 0.1, 8, 1500).hashes == 2
    check(spark, [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], 20, 5, 0.9)


def test_queries_meet_only_the_places_they_probe(spark):
    x = np.random.default_rng(4).normal(size=(300, 16))
    hashing = A.Hashing(float(np.linalg.norm(x, axis=1).max()), 0.5, 16, 10**6)
    assert hashing.places > 100
    wanted = hashing.probes(x, 1, 12)
    assert all(len(set(hashing.place(1, w).tolist())) <= 12 for w in wanted)
    own = A.Hashing(1.0, 1.0, 16, 10**6)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (own.probes(unit, 0, 3)[:, 0] == own.bucket(unit, 0)).all()  # a vector's own bucket comes first
    need = own.needed(unit[0], unit[:20])
    probed = [own.probes(unit[:1], t, own.buckets)[0].tolist() for t in range(A.TABLES)]
    want = [min(probed[t].index(own.bucket(unit[i : i + 1], t)[0]) for t in range(A.TABLES)) for i in range(20)]
    assert np.abs(need - np.array(want)).max() <= 2  # sums in single precision may change places


def test_hot_copies_and_double_vectors(spark):
    """A third of all rows are one vector, queries among them; doubles keep their precision."""
    rng = np.random.default_rng(9)
    rows = [(i, [0.1, 0.2, 1.0 / 3.0]) if i % 3 == 0 else (i, rng.normal(size=3).tolist()) for i in range(3000)]
    got = collected(A.nearest_neighbours(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA.replace("float", "double")), 20, 20))
    want = brute_force(rows, 20, 20)
    assert got.keys() == want.keys() and len(got) == 150
    hits = 0
    for q, found in got.items():
        vectors = dict(rows)
        assert all(abs(s - float(np.dot(vectors[q], vectors[j]))) < 1e-15 * 100 for j, s in found)
        hits += len({j for j, _ in found} & {j for j, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)
