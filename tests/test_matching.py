"""Scored matching by sets of equal parts against a loop over all candidates."""

import random
from collections import defaultdict

import pytest

from hearthline.operators import matching

SOLD = "sale_id long, postcode_clean string, full_address string, dkey string, core string, unit string, house string, street string, building string"
POOLED = "id long, postcode_clean string, unit string, house string, street string, building string, pool string, pool_key string"
PARTS = ("unit", "house", "street", "building")


def brute(dwellings, sales):
    """id to (sale_id, score), every dwelling scored against every sale of its pool."""
    by_postcode = defaultdict(list)
    for s in sales:
        by_postcode[s["postcode_clean"]].append(s)
    out = {}
    for d in dwellings:
        near = by_postcode[d["postcode_clean"]] if d["postcode_clean"] else []
        pool = [s for s in near if d["unit"] and s["unit"] == d["unit"]] or [s for s in near if d["house"] and s["house"] == d["house"]] or near
        best = []
        for s in pool:
            score = 0
            for part, (equal, other) in (("unit", (6, -4)), ("house", (5, -3)), ("street", (3, -1)), ("building", (3, -1))):
                if d[part] is not None and d[part] == s[part]:
                    score += equal
                elif d[part] is not None and s[part] is not None:
                    score += other
            best.append((score, s["dkey"], -s["sale_id"], s["full_address"] or ""))
        highest = max(best, default=(0,))[0]
        top = [b for b in best if b[0] == highest]
        if top and top[0][0] >= 5 and len({b[3] for b in top}) == 1:
            out[d["id"]] = (-max(top)[2], top[0][0])
    return out


def described(spark, dwellings, sales):
    d = spark.createDataFrame([tuple(r[c] for c in ("id", "postcode_clean", *PARTS)) for r in dwellings], "id long, postcode_clean string, unit string, house string, street string, building string")
    s = spark.createDataFrame([(r["sale_id"], r["postcode_clean"], r["full_address"], r["dkey"], None, *[r[p] for p in PARTS]) for r in sales], SOLD)
    return d.where("postcode_clean is not null"), s


def rows(rng, n, postcodes, values):
    pick = lambda name: rng.choice([None, *(f"{name[0]}{i}" for i in range(values))])
    return [{"id": i, "sale_id": i, "postcode_clean": rng.choice(postcodes), "full_address": rng.choice([None, "A", "B", "C"]), "dkey": rng.choice(["", "2001", "2002"]), **{p: pick(p) for p in PARTS}} for i in range(n)]


@pytest.mark.parametrize("values", [2, 5])
def test_equals_scoring_every_candidate(spark, values):
    rng = random.Random(values)
    dwellings, sales = rows(rng, 600, ["P1", "P2", None], values), rows(rng, 300, ["P1", "P2", "P3", None], values)
    for s in sales:  # mostly one address for each set of parts, so that not all is ambiguous
        if rng.random() < 0.8:
            s["full_address"] = "-".join(str(s[p]) for p in PARTS)
    d, s = described(spark, dwellings, sales)
    found = matching.best_of_scores(matching.score_candidates(matching.choose_pools(d, s), s))
    want = brute(dwellings, sales)
    assert {r["id"]: (r["sale_id"], r["score"]) for r in found.collect()} == want and len(want) > 50


def test_a_postcode_with_all_rows(spark):
    """Ten thousand sales and a thousand dwellings in one postcode: lookups, not pairs."""
    rng = random.Random(9)
    sales = [{"sale_id": i, "postcode_clean": "P", "full_address": f"a{i % 7000}", "dkey": f"20{i % 20:02d}", "unit": f"u{i % 7}" if i % 3 else None, "house": f"h{i % 7000}", "street": f"s{i % 900}", "building": f"b{i % 1100}" if i % 2 else None} for i in range(10_000)]
    dwellings = []
    for i in range(1_000):
        like = rng.choice(sales)
        dwellings.append({"id": i, "postcode_clean": "P", "unit": None if i % 2 else f"v{i % 5}", "house": like["house"] if i % 3 == 0 else f"x{i}", "street": like["street"], "building": like["building"]})
    d, s = described(spark, dwellings, sales)
    pooled = matching.choose_pools(d, s)
    assert {r["pool"] for r in pooled.select("pool").distinct().collect()} == {"H", "P"}
    by_score = matching.score_candidates(pooled, s)
    assert by_score.count() <= 12 * len(dwellings)
    assert {r["id"]: (r["sale_id"], r["score"]) for r in matching.best_of_scores(by_score).collect()} == brute(dwellings, sales)
    plan = by_score._jdf.queryExecution().optimizedPlan().toString()
    assert "sale_id" in plan and "nulls" in plan


def test_masks_are_complete():
    """Every way in which parts can be equal, missing or different is looked up where it scores enough, once for each pool it fits."""
    asked = matching._asked_masks()
    assert len(asked) == len({a[:4] for a in asked}) < 400
    for pool, mine, equal, nulls, score in asked:
        assert equal & ~mine == 0 and equal & nulls == 0 and score >= matching.LEAST_SCORE
        want = 0
        for b, p in enumerate(PARTS):
            bit = 1 << b
            want += matching.POINTS[p][0] if equal & bit else matching.POINTS[p][1] if mine & bit and not nulls & bit else 0
        assert score == want
