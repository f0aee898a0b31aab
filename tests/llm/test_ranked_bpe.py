"""Byte-level BPE by ranks against the tiktoken library."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthline.llm import ranked_bpe
from hearthline.llm.byte_bpe import PRETOKEN
from hearthline.llm.ranked_bpe import decode_by_ranks, encode_by_ranks, ranked_codec, ranked_digests, read_ranks

from . import helpers as H

NAME = "byte_bpe_50k.tiktoken"
PIECES = [*"aabbcdeERs'tllvemd 0123,.!?\n\t\x1c\x85 　éßñ日한😀²ⅷ١-_/́\u0000​", "<|endoftext|>", " the", "'ll", "don't", "  ", "\n\n", "   x", "***", "\r\n", " 😀"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=read_ranks(H.path(NAME)), special_tokens={})


def test_pattern_is_the_public_one():
    import public_tokenizers

    assert public_tokenizers.PATTERN == PRETOKEN


def test_random_texts(library):
    rng, codec = random.Random(1), ranked_codec(H.path(NAME))
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        assert "".join(codec.pieces(ids)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    codec = ranked_codec(H.path(NAME))
    lib = tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=read_ranks(H.path(NAME)), special_tokens={}) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = lib
    assert codec.encode([text])[0].tolist() == lib.encode_ordinary(text)


def test_every_character_counts_as_the_library_says(library):
    codec = ranked_codec(H.path(NAME))
    texts = [f"a{c}{c} {c}b 1{c}. {c}  {c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000, 3)])]
    assert all(ids.tolist() == library.encode_ordinary(t) for t, ids in zip(texts, codec.encode(texts)))


def test_spans_are_those_of_the_library():
    """Offsets from byte lengths are the ones that the tokenizers library tracks through its letters."""
    rng, codec = random.Random(2), ranked_codec(H.path(NAME))
    for _ in range(1000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25)))
        ids = codec.encode([text])[0]
        starts, ends = codec.spans(text, ids)
        assert list(zip(starts.tolist(), ends.tolist())) == codec.library.encode(text, add_special_tokens=False).offsets


def test_split_characters():
    codec = ranked_codec(H.path(NAME))
    text = "x 𝒳y日"
    ids = codec.encode([text])[0]
    split = codec.split_tokens(text.encode(), ids)
    assert split >= 2  # the script letter has no token of its own
    pieces = codec.pieces(ids)
    assert "".join(pieces) == text and pieces.count("") >= 1
    cut = codec.pieces(ids[: len(ids) - 1]) if len(codec.table[ids[-1]]) < 3 else []
    assert all("𝒳" not in p or p.endswith("𝒳") for p in cut)
    first = next(i for i in range(len(ids)) if codec.pieces(ids)[i] == "")
    assert codec.pieces(ids[: first + 1])[-1].endswith("�")


def test_long_texts(library, monkeypatch):
    """Long irregular texts are cut where the pattern cuts anyway; long words too give the library's ids."""
    rng, codec = random.Random(3), ranked_codec(H.path(NAME))
    monkeypatch.setattr(ranked_bpe, "LONG_TEXT", 50)
    for _ in range(300):
        text = "  " + "".join(rng.choice(PIECES) for _ in range(200))
        assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)
    for text in ("日本語" * 100_000, "".join(rng.choices("abcdefgh", k=300_000)), " \n" * 100_000):
        ids = codec.encode([text])[0]
        assert ids.tolist() == library.encode_ordinary(text)
    assert all(len(w) <= ranked_bpe.LONGEST_WORD for w in codec.known)


def test_cache_is_bounded(monkeypatch, library):
    codec = ranked_bpe.RankedCodec(H.path(NAME))
    monkeypatch.setattr(ranked_bpe, "CACHE_BYTES", 20_000)
    texts = [f"w{i} w{i + 1} w{i // 2}" for i in range(20_000)]
    got = codec.encode(texts)
    assert len(codec.known) + len(codec.older) < 2 * (20_000 // ranked_bpe.ENTRY_BYTES + 600)
    assert got[17].tolist() == library.encode_ordinary(texts[17]) and got[-1].tolist() == library.encode_ordinary(texts[-1])


def test_tables(spark, library):
    got = ranked_digests(H.awkward(spark), H.path(NAME)).collect()
    assert len(got) == len(H.AWKWARD)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for doc_id, text, *_ in H.AWKWARD:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        rows = {tuple(r)[:4] for r in got if r["doc_id"] == doc_id}
        assert rows == {(doc_id, len(ids), sha(ids.tobytes()), sha((text or "").encode()))}
    assert ranked_digests(H.empty(spark), H.path(NAME)).count() == 0
    one = encode_by_ranks(H.awkward(spark).where("doc_id = 4"), H.path(NAME))
    row = one.first()
    assert len(row["ids"]) == len(row["starts"]) == len(row["ends"]) and row["ends"][-1] == len(H.AWKWARD[4][1])
    back = decode_by_ranks(one, H.path(NAME)).first()
    assert back["text"] == H.AWKWARD[4][1] == "".join(back["pieces"]) and bytes(back["bytes"]) == back["text"].encode()
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {(r["doc_id"], r["text"]) for r in decode_by_ranks(odd, H.path(NAME)).collect()} == {(1, None), (2, "")}


def test_whole_table(spark, library):
    """Every document of the given table equals the other library's ids."""
    from hearthline.llm.queries import op11_ranked_round_trip

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op11_ranked_round_trip(spark, H.SF).collect()}
    docs = H.documents(spark).select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        assert got[doc_id] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
