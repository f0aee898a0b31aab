"""The audit of sources against a plain loop with whole numbers."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from hearthline.llm import divergence
from hearthline.llm.divergence import TOP, audit_sources, share, squeeze, tournament, unsqueeze

from . import helpers as H

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """Rows of the audit, from (text, lang, source) of every document."""
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(UPPER))
        groups[lang, source].update(terms)
        df[lang].update(set(terms))
    kept = {lang: [t for t, n in c.items() if n >= 3] for lang, c in df.items()}
    for lang, _ in groups:
        kept.setdefault(lang, [])

    def shares(count, terms):
        total = sum(count[t] for t in terms) + len(terms)
        return {t: 1 + 1_000_000_000 * (count[t] + 1) // total for t in terms}

    out = set()
    of = {g: shares(c, kept[g[0]]) for g, c in groups.items()}
    for lang, terms in kept.items():
        whole = Counter()
        for g, c in groups.items():
            if g[0] == lang:
                whole.update(c)
        q = shares(whole, terms)
        for g in groups:
            if g[0] != lang:
                continue
            pairs = [(-sum((p - of[o][t]) ** 2 // of[o][t] for t, p in of[g].items()), o[1].encode()) for o in groups if o[0] == lang and o != g]
            best = [(-((p - q[t]) ** 2 // q[t]), t.encode()) for t, p in of[g].items() if groups[g][t] and p > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:TOP])):
                out |= {(*g, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def rows_of(df):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(n, sources, seed, words):
    rng = random.Random(seed)
    return [(" ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "de", None]), rng.choice(sources)) for _ in range(n)]


WORDS = [f"{a}{b}" for a in ["Ab", "ä", "É", "日本", "z", "AB", "q"] for b in ["", "x", "é", "ß", "k1m", "-l", "日"]] + ["don't", "𝒳y", "\x7fo"]


@pytest.mark.parametrize("cells", [100_000, 40])
def test_equals_brute_force(spark, monkeypatch, cells):
    """In one block and in many; with fewer and more groups than stations."""
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    monkeypatch.setattr(divergence, "GROUP_CELLS", 1)
    rows = made(150, ["s1", "s2", None, "ß", "S1"], 1, WORDS) + made(80, [f"t{i}" for i in range(19)], 2, WORDS[:30])
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert rows_of(audit_sources(docs)) == brute(rows)


def test_given_table(spark):
    rows = [tuple(r) for r in H.documents(spark).select("text", "lang", "source").collect()]
    assert rows_of(audit_sources(H.documents(spark))) == brute(rows)


def test_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns; a language that keeps no term gives zeros."""
    rows = [(r[1], r[2], r[3]) for r in H.AWKWARD] + [("alone", "xx", "a"), (None, "xx", "b"), ("", "xx", None)]
    extra = spark.createDataFrame([(None, t, lang, s, 1, "x", "y", 1) for t, lang, s in rows[len(H.AWKWARD) :]], H.awkward(spark).schema)
    got = rows_of(audit_sources(H.awkward(spark).unionAll(extra)))
    assert got == brute(rows)
    assert {r[4] for r in got if r[0] == "xx"} == {0} and len([r for r in got if r[0] == "xx"]) == 6
    assert audit_sources(H.empty(spark)).count() == 0


def test_many_distinct_words_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 20)
    rows = made(200, ["a", "b"], 3, [f"w{i}" for i in "abcdefghijklmnopqrstuvwxyz"])
    rows = [(t.replace("1", "x"), lang, s) for t, lang, s in rows]
    assert rows_of(audit_sources(spark.createDataFrame(rows, "text string, lang string, source string"))) == brute(rows)


def test_every_two_stations_meet_once():
    for stations in (2, 4, 8, 12):
        rounds = tournament(stations)
        assert len(rounds) == stations - 1
        assert all(sorted(x for pair in r for x in pair) == list(range(stations)) for r in rounds)
        met = Counter(frozenset(pair) for r in rounds for pair in r)
        assert met == Counter(frozenset(pair) for pair in combinations(range(stations), 2))


def test_shares_stay_exact(spark):
    """Counts beyond what doubles or long products hold."""
    rng = random.Random(4)
    rows = [(c := rng.randrange(10**17), c + rng.randrange(10**17), rng.randrange(1, 10**9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "n long, total long, v long")
    for n, total, v, got in df.select("n", "total", "v", share("n", "total", "v")).collect():
        assert got == 1 + 1_000_000_000 * (n + 1) // (total + v)


def test_squeezed_vectors_come_back():
    ids, shares = np.array([0, 3, 4, 1_000_000]), np.array([1, 1_000_000_001, 7, 3])
    back = unsqueeze(squeeze(ids, shares))
    assert back[0].tolist() == ids.tolist() and back[1].tolist() == shares.tolist()
    assert [len(x) for x in unsqueeze(None)] == [0, 0]
