"""Packing of tokenised documents into training windows by best-fit decreasing.

A document is its ids and an end id. What is longer than the window is first cut
into full windows; the pieces left over are placed longest first, each into the
open window with the tightest room, which a segment tree indexed by remaining
capacity finds. There are two rounds. Each task packs its own rows, in groups of
bounded size, and what it made is written to the shared folder. The pieces of
windows that then still have room (a few of a large group, most where
partitions are small) are dealt over blocks of bounded size and packed anew; all
others stay where they are. Padding so doesn't follow the number of partitions.
Sequence ids hold the partition's number, or, over SECOND_ROUND, the block's.

Null and empty texts are documents of the end id alone. Ties in length keep the
order of the rows; repeated rows are packed once each; an empty table gives an
empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin_task, give_back, id_and_text, materialize, row_slices, ship_package, small_batches, worker_cache

WINDOW, END_ID = 4096, 2
#: Pieces, and bytes of them, that a task packs together.
GROUP_PIECES, GROUP_BYTES, PIECES_AT_A_TIME = 50_000, 32_000_000, 500
#: Windows that are filled less than this are open, and about this many of their pieces are packed together
#: in the second round, whose sequence ids begin here.
FILLED, BLOCK_PIECES, SECOND_ROUND = 0.99, 2_000, 1 << 62
#: Bytes of one generation of the cache of chunks; a worker keeps two. Where pieces keep their ids, GROUP_BYTES of
#: them take the place of as much of each generation. Longer chunks are not kept.
CACHE_BYTES, LONGEST_CHUNK = 80_000_000, 64
#: Texts whose unknown chunks are learned together.
TEXTS_AT_A_TIME = 128
PUNCTUATION = ".,;:!?*&%#$|"
#: Python takes these for white space; tokenizers does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


class ChunkIds:
    """Ids of whole texts as the tokenizers library gives them for a vocabulary
    whose pieces never span white space: chunks between white space are looked
    up, and those not seen yet are encoded together. The vocabulary marks the ends
    of words with </w>."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.cache_bytes = cache_bytes
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words = self._word_tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _word_tokenizer(path: str):
        """The same vocabulary for lower-case Latin words with blanks between
        them: those need neither the normaliser nor the splitting pattern."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, to_bytes]}}
        return Tokenizer.from_str(json.dumps(spec))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: set[str]) -> set[str]:
        """Words of Latin letters are encoded together, blanks between them, and
        told apart by the ids that end words; punctuation behind them is looked up.
        Returns the chunks and parts of chunks that are known now."""
        known, older, words, marked = self.known, self.older, set(), []
        for c in chunks:
            if c in older:
                known[c] = older[c]
                continue
            word = c.rstrip(PUNCTUATION)
            if not word.isalpha() or max(word) >= "\u0180" or "\u0130" in word:
                known[c] = self._whole(c)
                continue
            if len(word) < len(c):
                marked.append((c, word, c[len(word) :]))
            if word not in known:
                words.add(word)
        fresh = list(words)
        for at in range(0, len(fresh), 512):
            part = fresh[at : at + 512]
            ids = np.array(self.words.encode_batch_fast([" ".join(part).lower()], add_special_tokens=False)[0].ids, "<u4")
            data, stops = ids.tobytes(), ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            known.update((c, data[a:b]) for c, a, b in zip(part, [0, *stops[:-1]], stops, strict=True))
        for c, word, tail in marked:
            if tail not in known:
                known[tail] = self._whole(tail)
            known[c] = known[word] + known[tail]
        return chunks | words

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit numbers, little-endian."""
        return [ids for at in range(0, len(texts), TEXTS_AT_A_TIME) for ids in self._encode(texts[at : at + TEXTS_AT_A_TIME])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if any(s in t for s in self.special) or any(s in t for s in SEPARATORS) else t.split() for t in texts]
        distinct = set().union(*(c for c in cut if c))
        lacking = distinct.difference(self.known)
        if lacking:
            if self.held > self.cache_bytes:
                self.older, self.known, self.held = self.known, {}, 0
                lacking = distinct
            lacking = self._learn(lacking)
        get = self.known.__getitem__
        ids = [self._whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut)]
        for c in lacking:
            if len(c) > LONGEST_CHUNK:
                del self.known[c]
            else:
                self.held += 160 + 4 * len(c) + len(self.known[c])
        return ids


@worker_cache
def chunk_ids(path: str, cache_bytes: int = CACHE_BYTES) -> ChunkIds:
    return ChunkIds(path, cache_bytes)


class RoomTree:
    """Open windows by remaining capacity: leaves hold stacks of windows, inner
    nodes whether anything lies below."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, which: int) -> None:
        stack = self.open.setdefault(room, [])
        stack.append(which)
        node = room + self.leaves
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns a window with the smallest room of at least this much, and its room."""
        some, node = self.some, least + self.leaves
        if not some[node]:
            while node > 1 and (node & 1 or not some[node + 1]):  # up, until something lies to the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if some[2 * node] else 2 * node + 1
        room = node - self.leaves
        which = self.open[room].pop()
        if not self.open[room]:
            while node and not (node < self.leaves and (some[2 * node] or some[2 * node + 1])):
                some[node] = 0
                node >>= 1
        return which, room


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For pieces of 1 to window tokens: each one's window and place in it, and the number of windows."""
    which, place = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths >= window).sum())
    which[order[:full]] = np.arange(full)
    tree, made = RoomTree(window), full
    for i in order[full:].tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found, made = (made, window), made + 1
        w, room = found
        which[i], place[i] = w, window - room
        if room > n:
            tree.add(room - n, w)
    return which, place, made


def pack_documents(docs: DataFrame, path: str, checksum: bool = False, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most a window and where they lie: doc_id, start, length,
    doc_tokens, ids (binary, unsigned 32-bit little-endian; or instead of them
    ids_crc32, their checksum), sequence_id and offset. Only a document's last
    piece is shorter than a window."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    last = pa.field("ids_crc32", pa.int64()) if checksum else pa.field("ids", pa.binary())
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens")] + [last] + [(n, pa.int64()) for n in ("sequence_id", "offset")] + [("open", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(chunk_ids)
        encode, end, size = chunk_ids(path, CACHE_BYTES if checksum else CACHE_BYTES - GROUP_BYTES).encode, np.array([end_id], "<u4").tobytes(), 4 * window
        made, first, held = 0, TaskContext.get().partitionId() << 40, 0
        pieces: list[tuple] = []

        def placed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            lengths = np.array([p[2] for p in pieces], np.int64)
            which, place, count = best_fit_decreasing(lengths, window)
            unfilled = (np.bincount(which, lengths, count) < FILLED * window)[which]
            which, made = which + first + made, made + count
            for at in range(0, len(pieces), PIECES_AT_A_TIME):
                stop = at + PIECES_AT_A_TIME
                columns = [*zip(*pieces[at:stop]), which[at:stop], place[at:stop], unfilled[at:stop]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for rows in row_slices(batches):
            for doc_id, ids in zip(rows["doc_id"], encode(rows["text"])):
                ids += end
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    pieces.append((doc_id, at // 4, len(piece) // 4, len(ids) // 4, zlib.crc32(piece) if checksum else piece))
                    held += 0 if checksum else len(piece)
            if len(pieces) >= GROUP_PIECES or held >= GROUP_BYTES:
                yield from placed()
                pieces, held = [], 0
                give_back()
        if pieces:
            yield from placed()

    columns = "doc_id long, start long, length long, doc_tokens long, " + ("ids_crc32 long" if checksum else "ids binary")
    packed = materialize(id_and_text(docs).mapInArrow(run, f"{columns}, sequence_id long, offset long, open boolean"), "packed")
    return packed.where("not open").drop("open").unionByName(_pack_again(packed.where("open").drop("open"), window))


def _pack_again(pieces: DataFrame, window: int) -> DataFrame:
    """The second round: pieces of open windows, dealt over blocks by where they
    lie now (no two lie at one place, so no key is hot), get new places."""
    blocks = max(1, math.ceil(pieces.count() / BLOCK_PIECES))
    columns = pieces.columns

    def again(table: pa.Table) -> pa.Table:
        begin_task()
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        which, place, _ = best_fit_decreasing(table["length"].to_numpy(), window)
        first = SECOND_ROUND + (table["block"][0].as_py() << 40)
        placed = {"sequence_id": pa.array(which + first), "offset": pa.array(place)}
        return pa.table([placed.get(c, table[c]) for c in columns], columns)

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(again, pieces.schema)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, and ids (binary) of the
    pieces in order. A sequence has a window's tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
