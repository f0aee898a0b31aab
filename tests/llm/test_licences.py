"""Licence scans: phrases and matching statistics against brute force."""

import random
import re

from hearthline.llm import licences as L

from . import helpers as H


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_places(words):
    return sorted((i, label) for phrase, label in L.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def test_automaton_gives_matching_statistics():
    """For each template the longest piece at every word, and all places of those that don't go on."""
    rng = random.Random(1)
    for _ in range(200):
        sequences = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        a = L.SuffixAutomaton(sequences)
        text = [rng.randint(1, 4) for _ in range(20)]
        want = []
        for k, s in enumerate(sequences):
            places = lambda p: [i for i in range(len(s) - len(p) + 1) if s[i : i + len(p)] == p]  # noqa: B023, E731
            for at in range(20):
                n = max(n for n in range(at + 2) if n == 0 or places(text[at + 1 - n : at + 1]))
                if n >= 2:
                    first = at + 1 - n
                    want += [(k, first, i, n) for i in places(text[first : at + 1]) if at == 19 or s[i + n : i + n + 1] != [text[at + 1]]]
        assert sorted(a.maximal_matches(text, 2)) == sorted(want)


def test_matches_of_one_template_do_not_mask_another():
    long = " ".join(f"w{i}" for i in range(30))
    other = " ".join(["x0", "x1", "x2", "w3", "w4", "w5", "w6"] + [f"y{i}" for i in range(20)])
    scan = L.LicenceScanner([("a", long), ("b", other)], []).scan
    text = "x0 x1 x2 w3 w4 w5 w6 z " + " ".join(f"y{i}" for i in range(20))
    assert scan(text)[2] == [(0, 28, "b", 1.0)]
    inside = long.replace("w8", "y0 y1 y2 y3 y4 w8")
    assert [x for _, _, x, _ in scan(inside)[2]] == ["a"]


def test_chains_against_brute_force():
    """The best chain over all subsets of matches, and what lies beside it is chained again."""
    rng = random.Random(5)

    def covered(chain):
        total, last = 0, None
        for a, t, n in chain:
            if last is None:
                total += n
            else:
                b, u, m = last
                fresh = n - max(0, b + m - a, u + m - t)
                if not (b < a and u < t and fresh > 0 and a - b - m <= 20):
                    return -1
                total += fresh
            last = (a, t, n)
        return total

    for _ in range(150):
        found = sorted({(rng.randint(0, 40), rng.randint(0, 14), rng.randint(4, 8)) for _ in range(rng.randint(1, 7))})
        best = max(covered([m for i, m in enumerate(found) if bits >> i & 1]) for bits in range(1, 1 << len(found)))
        spans = L.LicenceScanner._chain(found, 20)
        assert bool(spans) == (best >= L.COVERED * 20)
        assert not spans or max(c for _, _, c in spans) == min(1.0, best / 20)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(spans, spans[1:]))
    one = [(0, 0, 9), (9, 9, 11)]
    assert L.LicenceScanner._chain(one + [(a + 30, t, n) for a, t, n in one] + [(5, 2, 6)], 20) == [(0, 20, 1.0), (30, 50, 1.0)]
    # a chain that runs into a taken one is not lost: its own part is chained again
    assert L.LicenceScanner._chain([(0, 0, 20), (22, 4, 14)], 20) == [(0, 20, 1.0), (22, 36, 0.7)]


def test_documents(spark):
    scan = L.scanner().scan
    labelled = 0
    for r in H.documents(spark).collect():
        n, places, spans = scan(r["text"] or "")
        words = plain_words(r["text"] or "")
        assert n == len(words) and places == plain_places(words)
        labelled += bool(spans)
        assert bool(spans) == ("licen" in (r["text"] or "").lower())
    assert labelled


def test_spans_of_altered_templates():
    scan = L.scanner().scan
    for label, text in L.TEMPLATES:
        words = text.split()
        got = scan("before " + text + " after")[2]
        assert (label, 1.0) in [(x, c) for _, _, x, c in got]
        if len(words) > 30:
            words[12] = "otherwise"
            assert label in [x for _, _, x, c in scan("a b " + " ".join(words))[2] if c > 0.9]
    assert scan("under the license of the software that you may use")[2] == []


def test_tables(spark):
    df = spark.createDataFrame([(1, "Under the MIT License. APACHE LICENSE, Version 2; under the mit license"), (2, "This work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.licence_digests(df).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["score"]) == (3, 0, 8, "apache-2,mit", 1.0)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["labels"], got[2]["base_labels"]) == (0, None, "gpl-3", "")
    rows = L.licence_digests(H.awkward(spark)).collect()
    assert len(rows) == len(H.AWKWARD) and all(r["score"] == 0 and r["labels"] == "" for r in rows)
    assert L.licence_digests(H.empty(spark)).count() == 0
