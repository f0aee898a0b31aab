"""The trie of conversations against plain recursion over all nodes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from hearthline.llm import prefix_trie
from hearthline.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            found[conv].append(((turn is not None, turn or 0), name, (role, text)))
    own = {c: [t for *_, t in sorted(x)] for c, x in found.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in rebuild(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved, out = {}, {}, set()
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        leaves[node] = sum(leaves[k] for k in kids) or 1
        saved[node] = sum(saved[k] for k in kids) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.add((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), leaves[node], saved[node], digest))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed, convs=120, longest=9):
    """Conversations of few different turns: much is shared, some are copies, some end where others go on."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-150, 400), convs):
        n = rng.randint(1, longest)
        turns = [(rng.choice(["u", "u", "a", None]), rng.choice(["x", "yy", "日本", "", None, "😀"][: 2 + c % 3])) for _ in range(n)]
        rows += [(c, None if rng.random() < 0.05 else t, *x) for t, x in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [prefix_trie.SEGMENT, 2, 1])
def test_equals_brute_force(spark, monkeypatch, segment):
    """Conversations in one segment and in several; rows over many partitions, so that borders are compared."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    for seed in range(2):
        rows = made(seed)
        assert rows_of(conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


def test_one_conversation_over_several_partitions(spark, monkeypatch):
    """A long conversation, its copies and its beginnings: no step holds it as a whole."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 16)
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    turns = [("u", f"t{i % 50}") for i in range(700)]
    rows = [(c, t, *x) for c, n in ((7, 700), (1007, 700), (2000, 700), (2001, 333), (2002, 336), (2003, 1)) for t, x in enumerate(turns[:n])]
    rows += [(c, 0, "u", "same") for c in range(5000, 5040)]
    assert rows_of(conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(9))) == brute(rows)


def test_awkward_rows(spark):
    """Nulls anywhere, repeated rows, empty and long texts, conversations left without turns, clashing columns."""
    rows = [(None, 1, "u", "x"), (1, None, None, None), (1, None, None, None), (1, 2, "u", "y"), (2, 5, "u", "x" * 100_000), (100, 1, "u", "a"), (100, 2, "u", ""), (101, 1, "u", "a"), (102, 9, None, "a"), (-5, 1, "u", "a")]
    df = spark.createDataFrame([(*r, "p", 1, "q") for r in rows], SCHEMA + ", node string, depth int, key string")
    assert rows_of(conversation_trie(df)) == brute(rows)
    assert conversation_trie(df.limit(0)).count() == 0


def test_given_table(spark):
    from hearthline.llm.queries import op13_conversation_trie

    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert rows_of(op13_conversation_trie(spark, "/root/testdata/sf0.01")) == brute([tuple(r) for r in df.collect()])
