"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from hearthline.llm import near_duplicates as N
from hearthline.llm.components import component_labels

from . import helpers as H


def brute_force(rows, size, percent):
    """doc_id to (set size, smallest reachable id), every pair compared through shared shingles."""
    sets = {}
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where: dict = {}
    for i in sorted(sets):
        common: dict = {}
        for s in sets[i]:
            for j in where.get(s, ()):
                common[j] = common.get(j, 0) + 1
            where.setdefault(s, []).append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def generated():
    """Chains and clouds of altered copies, short texts, and passages that many share."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(words) for _ in range(60)]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    rows += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(0, 60))]) for _ in range(120)]
    rows += ["one", "ONE", "one two", "one  two", "", "a b c", "A\tb\nc", "é b c", "É b c"]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("block", [2048, 16])
def test_generated(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = generated()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.link_components(df, size, percent).collect()}
    assert got == brute_force(rows, size, percent)


def test_documents(spark):
    docs = H.documents(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicate_digests(docs).collect()}
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 85)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    assert any(i != c for i, (_, c) in want.items())


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
        a, b = pool[:220], pool[40:]
        agree = (N.superminhash(a, 96) == N.superminhash(b, 96)).mean()
        errors.append(agree - 180 / 300)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07
    one = N.superminhash(np.array([7], np.uint64), 96)
    assert sorted((one >> np.uint64(52)).tolist()) == list(range(96))  # one element's ranks are a permutation


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(60, 61), (61, 60), (70, 70)]
    got = {r["node"]: r["label"] for r in component_labels(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 61: 60}
    assert component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    got = N.near_duplicate_digests(H.awkward(spark)).collect()
    assert len(got) == len(H.AWKWARD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[7]["component_id"] == 6 and not by_id[7]["kept"] and by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i for i in (1, 2, 3))
    assert N.near_duplicate_digests(H.empty(spark)).count() == 0
    kept = N.keep_one_of_each(H.awkward(spark))
    assert kept.columns == H.awkward(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
