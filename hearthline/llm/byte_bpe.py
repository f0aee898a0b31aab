"""Byte-level BPE: exact encoding by backtracking, decoding by an offset table.

The encoder never replays merges. An Aho-Corasick automaton gives, for each
position of a pre-token, the longest vocabulary entry that starts there. The
encoder takes the longest one, checks it against its left neighbour in the
pair-compatibility table, and falls back to shorter entries or steps back when
none fits; positions from which no encoding exists are marked, so each is left
at most once. A sequence in which all neighbours are compatible is the one that
the merges give.

Texts: null counts as empty and encodes to no ids. Special strings inside a text
become their ids, as the tokenizers library does by default. Equal texts give
equal rows; repeated rows stay repeated; an empty table gives an empty table;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct

import numpy as np
from pyspark.sql import DataFrame

from .common import BoundedCache, id_and_text, map_rows, worker_cache

#: The pattern that splits text before byte-level merges.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space next to white space, or at an end: there the pattern must see the whole text.
_IRREGULAR = re.compile(r"\s\s|^\s|\s$|[^\S \n]")
#: Signs that end words and form one pre-token together; none starts a contraction.
PUNCTUATION = ".,;:!?*&%#$|"
#: Bytes of one generation of a cache of words; a worker keeps two.
CACHE_BYTES = 100_000_000
_FOREVER = 1 << 60
#: Makes bytes of so many ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the tables made from them. Strings here are bytes read as Latin-1."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: chr(b) for b, c in enumerate(byte_letters())}
        named = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*named.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for text, i in named.items():
            self.token[i] = "".join(to_byte[c] for c in text)
        for text, i in self.special.items():
            self.token[i] = text.encode().decode("latin-1")
        self.ids = {self.token[i]: i for i in named.values()}
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.order = [0] * size  # when a token is formed; bytes are there from the start
        self.join: dict[tuple[int, int], int] = {}
        self.formed: dict[tuple[int, int], int] = {}
        for when, pair in enumerate(spec["model"]["merges"], 1):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, ab = named[left], named[right], named[left + right]
            self.join[a, b], self.formed[a, b] = when, ab
            if self.parts[ab] is None:
                self.parts[ab], self.order[ab] = (a, b), when

    def merge(self, piece: str) -> list[int]:
        """The ids of a pre-token by replaying its merges, earliest rule first. For
        short pieces: each step looks at all that is left."""
        ids, get = [self.ids[c] for c in piece], self.join.get
        when = [get(pair, _FOREVER) for pair in zip(ids, ids[1:])]
        while when and (first := min(when)) < _FOREVER:
            at = when.index(first)
            ids[at : at + 2] = [self.formed[ids[at], ids[at + 1]]]
            del when[at]
            if at:
                when[at - 1] = get((ids[at - 1], ids[at]), _FOREVER)
            if at < len(when):
                when[at] = get((ids[at], ids[at + 1]), _FOREVER)
        return ids

    @staticmethod
    def bare_word(text: str) -> tuple[str, bool]:
        """A text without the punctuation behind it, and whether that is a run of Latin letters."""
        word = text.rstrip(PUNCTUATION)
        return word, word.isalpha() and max(word) < "\u0250"

    def pretokens(self, text: str) -> list[str]:
        """What the pattern cuts a text into. The usual word, a run of Latin
        letters with punctuation behind it, needs no pattern."""
        word = text.rstrip(PUNCTUATION)
        bare = word[1:] if word[:1] == " " else word
        if bare.isalpha() and max(bare) < "\u0250":
            found = [word, text[len(word) :]] if len(word) < len(text) else [word]
        else:
            found = _splitter().findall(text)
        return [p.encode().decode("latin-1") for p in found]


@functools.cache
def _splitter():
    import regex

    return regex.compile(PRETOKEN)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Backtracking encoder over one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.vocab = vocab
        self.size = [len(t) for t in vocab.token]
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.ids.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(vocab.token)  # a token's longest proper prefix in the vocabulary
        for text, i in vocab.ids.items():
            self.shorter[i] = next((vocab.ids[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in vocab.ids), -1)
        self.fits = BoundedCache(self._compatible, 3 * CACHE_BYTES // 2)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merges leave the border between two tokens alone. The two
        tokens at the border are taken apart again, the last formed first; at
        no time may a rule join them before one of them is used up inside its own token."""
        (a, b), v = pair, self.vocab
        used_a = used_b = _FOREVER
        while True:
            when = v.join.get((a, b))
            if when is not None and when < used_a and when <= used_b:
                return False
            if v.parts[a] is not None and v.order[a] > v.order[b]:
                used_a, a = v.order[a], v.parts[a][1]
            elif v.parts[b] is not None:
                used_b, b = v.order[b], v.parts[b][0]
            else:
                return True

    def encode(self, piece: str) -> list[int]:
        n, size, fits, shorter = len(piece), self.size, self.fits, self.shorter
        longest = [0] * n
        for end, token in self.automaton.iter(piece):  # ends ascend, so the longest stays
            longest[end + 1 - size[token]] = token
        last = longest[0]
        at = size[last]
        out = [last]
        dead: set[int] = set()
        while at < n:
            token = longest[at]
            end = at + size[token]
            while end in dead or (out and not fits[last, token]):
                token = shorter[token]
                if token < 0:  # nothing fits here: shorten what came before
                    dead.add(at)
                    token = out.pop()
                    at -= size[token]
                    last = out[-1] if out else -1
                end = at + size[token]
            out.append(token)
            last, at = token, end
        return out


class TextCodec:
    """Encodes and decodes whole texts, with caches of what words encode to."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.encoder = Encoder(self.vocab)
        self.piece = BoundedCache(lambda p: np.array(self.encoder.encode(p), "<u4").tobytes(), CACHE_BYTES // 8)
        self.first = BoundedCache(self._chunk, CACHE_BYTES // 8)
        self.later = BoundedCache(self._word, CACHE_BYTES)
        self.newline = self._chunk("\n")
        specials = sorted(self.vocab.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        blob = [t.encode("latin-1") for t in self.vocab.token]
        self.bytes = np.frombuffer(b"".join(blob), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.int64)
        self.decimal = [str(i) for i in range(len(blob))]

    def _chunk(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.vocab.pretokens(text)))

    def _word(self, chunk: str) -> bytes:
        """Of a chunk with a space before it. A word keeps its ids in the cache
        of chunks, where the same word with punctuation behind it finds them."""
        word, bare = self.vocab.bare_word(chunk)
        if not bare:
            return self._chunk(" " + chunk)
        if len(word) < len(chunk):
            return self.later[word] + self.piece[chunk[len(word) :]]
        ids = self.encoder.encode((" " + word).encode().decode("latin-1"))
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit numbers, of a text without special strings.
        A lone space before a word starts a pre-token and a lone line break is
        one, so regular texts can be cut there and looked up word by word."""
        if not text:
            return b""
        if _IRREGULAR.search(text):
            return self._chunk(text)
        later, lines = self.later.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.first[words[0]] + b"".join(map(later, words[1:])))
        return self.newline.join(lines)

    def encode(self, text: str) -> np.ndarray:
        if self.special is None or not self.special.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.vocab.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids: each byte's place is its token's offset plus its place in the token."""
        start, length = self.offset[ids], self.offset[ids.astype(np.int64) + 1] - self.offset[ids]
        total = int(length.sum())
        if not total:
            return b""
        place = np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)
        return self.bytes[place].tobytes()


@worker_cache
def text_codec(path: str) -> TextCodec:
    """One codec in each Python worker; workers are used again by later tasks."""
    return TextCodec(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def make():
        codec = text_codec(path)
        return lambda rows: {"doc_id": rows["doc_id"], "ids": [codec.encode(t).astype(np.int32) for t in rows["text"]]}

    return map_rows(id_and_text(docs), "doc_id long, ids array<int>", make, (text_codec,))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; broken UTF-8 becomes U+FFFD, null ids a null text."""

    def make():
        codec = text_codec(path)
        say = lambda ids: None if ids is None else codec.decode(np.array(ids, "<u4")).decode("utf-8", "replace")
        return lambda rows: {"doc_id": rows["doc_id"], "text": [say(x) for x in rows["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, text string", make, (text_codec,))


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns digests of both."""

    def make():
        codec = text_codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def step(rows):
            out = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in rows["text"]:
                ids = codec.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha(",".join(map(codec.decimal.__getitem__, ids.tolist())).encode()))
                out["decoded_sha256"].append(sha(codec.decode(ids).decode("utf-8", "replace").encode()))
            return out

        return step

    return map_rows(id_and_text(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, (text_codec,))
