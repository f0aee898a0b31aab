"""Byte-level BPE against the tokenizers library."""

import hashlib
import random
import time

import pytest
from tokenizers import Tokenizer

from hearthline.llm.byte_bpe import Encoder, decode_ids, encode_texts, round_trip_digests, text_codec, vocabulary
from hearthline.llm.common import BoundedCache
from hearthline.llm.token_counts import count_tokens, token_counter, whole_tokens

from . import helpers as H

NAME = "byte_bpe_50k.json"
PIECES = [*"aabbcdeERs'tllvemd 0123,.!?\n\t\x1c\x85 　éßñ日한😀²ⅷ١-_/́\u0000​", "<|endoftext|>", " the", "'ll", "don't", "  ", "\n\n", "   x", "***"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(H.path(NAME))
    t.no_truncation()
    t.no_padding()
    return t


def test_random_texts(library):
    rng, codec, counter = random.Random(1), text_codec(H.path(NAME)), token_counter(H.path(NAME), whole_tokens(H.path(NAME)))
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids
        assert counter.count(text) == len(ids)
        assert codec.decode(codec.encode(text)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_backtracking_equals_merging():
    vocab, rng = vocabulary(H.path(NAME)), random.Random(2)
    encoder = Encoder(vocab)
    for _ in range(2000):
        piece = "".join(rng.choice("abcdest hin") for _ in range(rng.randint(1, 30)))
        assert encoder.encode(piece) == vocab.merge(piece)


def test_whole_tokens_are_single(library):
    table = whole_tokens(H.path(NAME))
    assert 49_000 < sum(table) <= 50_257
    assert table[library.encode(" the", add_special_tokens=False).ids[0]] == 1


def test_long_words(library):
    """Words of a million letters without a blank: exact, in linear time, and not kept."""
    rng, codec, counter = random.Random(3), text_codec(H.path(NAME)), token_counter(H.path(NAME), whole_tokens(H.path(NAME)))
    for letters, size in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("a", 1_000_000), ("日本語中文字漢", 300_000), ("ab1 ,", 100_000)):
        text = "".join(rng.choices(letters, k=size))
        start = time.process_time()
        ids = codec.encode(text)
        assert counter.count(text) == len(ids)
        assert codec.decode(ids).decode() == text
        assert time.process_time() - start < 30  # replaying merges over the whole word at each step took hours
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert all(len(k) <= 64 for c in (codec.later, codec.first, codec.piece, counter.later, counter.first, counter.merged) for k in c)


def test_cache_is_bounded_by_bytes():
    cache = BoundedCache(str.upper, 10_000)
    for i in range(5000):
        assert cache[f"key {i}"] == f"KEY {i}"
    assert len(cache) + len(cache.older) <= 2 * 10_000 // 200
    assert cache["x" * 100] == "X" * 100 and "x" * 100 not in cache


def test_tables(spark, library):
    want = {}
    for row in H.AWKWARD:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        want[row[0]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = round_trip_digests(H.awkward(spark), H.path(NAME)).collect()
    assert len(got) == len(H.AWKWARD)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    counts = count_tokens(H.awkward(spark), H.path(NAME)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in counts} == {k: v[0] for k, v in want.items()}
    assert {r["doc_id"] for r in counts if r["over_limit"]} == {5}
    assert round_trip_digests(H.empty(spark), H.path(NAME)).count() == 0
    back = decode_ids(encode_texts(H.awkward(spark).where("doc_id = 4"), H.path(NAME)), H.path(NAME)).first()
    assert back["text"] == H.AWKWARD[4][1]
