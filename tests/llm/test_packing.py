"""Packing: ids of the library, every id in one piece, gapless windows, best fit."""

import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthline.llm import packing as K

from . import helpers as H

NAME = "word_bpe_49k.json"


def test_ids_of_random_texts():
    rng, library, chunks = random.Random(2), Tokenizer.from_file(H.path(NAME)), K.ChunkIds(H.path(NAME))
    pieces = [*"aabcdeERs'tl 012,.!?\n\t\x1c\x1f\x85 　éßñİΣσ日한😀²ⅷ-_/́\u0000​", "<|endoftext|>", " the", "'ll", "HELLO", "hello", "***", " ́"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for text, ids in zip(texts, chunks.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_chunks():
    """Long chunks are encoded exactly and not kept."""
    rng, library, chunks = random.Random(4), Tokenizer.from_file(H.path(NAME)), K.ChunkIds(H.path(NAME))
    texts = ["".join(rng.choices(letters, k=size)) + end for letters, size in (("abcdefghij", 1_000_000), ("日本語中文字漢", 200_000), ("ab1", 50_000)) for end in ("", "!", " x.")]
    for text, ids in zip(texts, chunks.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, chunks.known)) <= K.LONGEST_CHUNK and chunks.held < 10_000


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(100):
        window = rng.choice([7, 16, 100])
        lengths = np.array([rng.randint(1, window) for _ in range(rng.randint(1, 60))])
        which, place, made = K.best_fit_decreasing(lengths, window)
        rooms: list[int] = []  # brute force: the tightest open window, for the longest piece first
        for n in sorted(lengths.tolist(), reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else window) - n)
        assert made == len(rooms)
        used = [sorted((int(p), int(n)) for p, n, w in zip(place, lengths, which) if w == k) for k in range(made)]
        assert sorted(window - sum(n for _, n in u) for u in used) == sorted(rooms)
        for u in used:
            assert [p for p, _ in u] == np.cumsum([0, *[n for _, n in u]])[:-1].tolist()


def test_tables(spark):
    library = Tokenizer.from_file(H.path(NAME))
    packed = K.pack_documents(H.awkward(spark), H.path(NAME)).cache()
    rows = packed.collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for row in H.AWKWARD:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[row[0]], key=lambda r: r["start"])
        if row[0] != 7:
            assert np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist() == ids
        assert {p["doc_tokens"] for p in pieces} == {len(ids)}
    assert len(by_doc[7]) == 2
    sequences = {r["sequence_id"]: r for r in K.packed_sequences(packed).collect()}
    assert max(r["n_tokens"] for r in sequences.values()) == K.WINDOW
    for r in rows:
        s = np.frombuffer(sequences[r["sequence_id"]]["ids"], "<u4")
        assert s[r["offset"] : r["offset"] + r["length"]].tobytes() == bytes(r["ids"])
        assert len(s) == sequences[r["sequence_id"]]["n_tokens"]
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in K.pack_documents(H.awkward(spark), H.path(NAME), checksum=True).collect()}
    assert sums == {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in rows}
    assert K.pack_documents(H.empty(spark), H.path(NAME)).count() == 0


def fill(packed):
    used, windows = packed.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    return used / (windows * K.WINDOW)


def test_little_padding(spark):
    assert fill(K.pack_documents(H.documents(spark).coalesce(1), H.path(NAME), checksum=True)) > 0.97


def test_little_padding_in_many_partitions(spark):
    """Five documents a task: windows that these can't fill are filled in the second round, whole and gapless."""
    rows = K.pack_documents(H.documents(spark).repartition(211), H.path(NAME), checksum=True).cache()
    assert fill(rows) > 0.97
    lengths, windows = {}, {}
    for r in rows.collect():
        lengths.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert rows.where("start = 0").count() == H.documents(spark).count()
    for runs, total in [(p, k[1]) for k, p in lengths.items()] + [(w, None) for w in windows.values()]:
        runs.sort()
        ends = np.cumsum([n for _, n in runs]).tolist()
        assert [a for a, _ in runs] == [0, *ends[:-1]] and ends[-1] == (total or ends[-1])
        assert total or ends[-1] <= K.WINDOW


def test_second_round_in_blocks(spark, monkeypatch):
    """Several blocks share no sequence, and nothing is lost between both rounds."""
    monkeypatch.setattr(K, "BLOCK_PIECES", 40)
    rows = K.pack_documents(H.documents(spark).repartition(211), H.path(NAME), checksum=True).cache()
    whole = K.pack_documents(H.documents(spark).coalesce(1), H.path(NAME), checksum=True)
    columns = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
    assert rows.select(columns).exceptAll(whole.select(columns)).isEmpty() and rows.count() == whole.count()
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > K.WINDOW).isEmpty()
    assert rows.where(F.col("sequence_id") >= K.SECOND_ROUND).selectExpr("count(distinct shiftright(sequence_id, 40))").first()[0] > 1


def test_what_a_worker_holds_is_bounded():
    """The cache of a worker whose pieces keep their ids leaves room for them, and a task begins without what the last one freed."""
    code = """
import random, re
import pyarrow as pa
from hearthline.llm import common, packing as K
from tests.llm import helpers as H
def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
common.begin_task()
first = held()
arrow = [pa.array(["x" * 1000] * 2000) for _ in range(20)]
values, later = [bytes(600 + i % 400) for i in range(200_000)], [bytes(700) for _ in range(10)]  # the latter lie above the former and stay
del arrow, values
common.begin_task()
print(held() - first)
small = K.chunk_ids(H.path("word_bpe_49k.json"), 100_000)
rng, most = random.Random(1), 0
for _ in range(40):
    small.encode([" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(100)) for _ in range(10)])
    most = max(most, small.held)
print(most)
"""
    root = Path(__file__).resolve().parents[2]
    rest, most = map(float, subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, check=True).stdout.split())
    assert rest < 60 and most < 100_000 + 1_000 * 250
