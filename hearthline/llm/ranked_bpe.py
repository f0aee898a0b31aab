"""Byte-level BPE by a table of ranks, with the tokenizers library over Arrow batches.

The library works on letters, one for each byte, so the rank table becomes a
vocabulary of letters and a list of merges: a token's two parts are what the
ranks below its own leave of its bytes. A pre-token that is itself a token is
taken as it is. Each batch sends the library its distinct unknown words, and
whole texts where white space is irregular (long ones cut at lone blanks, where
the pattern always cuts). Ids carry their byte lengths, so that offsets in
characters follow from sums and from the number of characters before each byte.
Decoding turns letters back to bytes; a character whose bytes are split over
tokens appears with the token that completes it.

Null texts count as empty and have no ids; special strings are ordinary text.
Equal texts give equal rows, repeated rows stay repeated, an empty table gives an
empty table; columns other than doc_id and text are not read. Ids outside the
table make decoding fail; null ids decode to null.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re

import numpy as np
from pyspark.sql import DataFrame

from .byte_bpe import _IRREGULAR, PRETOKEN, byte_letters
from .common import id_and_text, map_rows, worker_cache

#: Bytes of one generation of the cache of words (a worker keeps two); longer words are not kept.
CACHE_BYTES, LONGEST_WORD, ENTRY_BYTES = 120_000_000, 64, 200
#: Characters of an irregular text that the library gets at once, if there is a blank to cut at.
LONG_TEXT = 1 << 16
_LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Signs that end words and form one pre-token together; none starts a contraction.
PUNCTUATION = ".,;:!?*&%#$|"
#: Unknown words that the library gets as one text.
WORDS_AT_A_TIME = 512
#: Texts whose unknown words are learned together.
TEXTS_AT_A_TIME = 128


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def two_parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """What is left of a token's bytes once all lower ranks are merged, lowest and
    leftmost first; None if that isn't two parts (then no merge ever forms the token)."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class RankedCodec:
    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, letters = read_ranks(path), byte_letters()
        say = lambda token: "".join(map(letters.__getitem__, token))
        pairs = [two_parts(token, ranks) for token in sorted(ranks, key=ranks.__getitem__) if len(token) > 1]
        merges = [(say(p[0]), say(p[1])) for p in pairs if p]
        self.library = Tokenizer(models.BPE(vocab={say(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        to_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(PRETOKEN), "isolated"), to_letters])
        to_byte = {letter: b for b, letter in enumerate(letters)}
        table = [b""] * (max(ranks.values()) + 1)
        for letters_of, i in self.library.get_vocab().items():
            table[i] = bytes(to_byte[c] for c in letters_of)
        self.table, self.known_ids = table, np.array([bool(t) for t in table])
        self.length = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.after_blank = np.array([t[:1] == b" " for t in table])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.newline = self._by_library(["\n"])[0]

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _irregular(self, text: str) -> bytes:
        """A text as a whole; a long one in parts that end before lone blanks."""
        parts, at = [], 0
        while len(text) - at > LONG_TEXT and (cut := _LONE_BLANK.search(text, at + LONG_TEXT)):
            parts.append(self._by_library([text[at : cut.start()]])[0])
            at = cut.start()
        return b"".join([*parts, self._by_library([text[at:]])[0]])

    def _learn(self, words: list[str]) -> set[str]:
        """Looks up what unknown words encode to. Punctuation behind a letter or
        digit is a pre-token of its own and looked up apart; words with a blank
        before them go to the library together, and only their first ids begin with
        one. Returns the words and parts of words that became known."""
        known, older, marked, parts = self.known, self.older, [], set()
        for word in words:
            if word in older:
                known[word] = older[word]
                continue
            bare = word.rstrip(PUNCTUATION)
            if len(bare) < len(word) and bare[-1:].isalnum() and bare[-1] < "\u0250":
                marked.append((word, bare, word[len(bare) :]))
                parts |= {bare, word[len(bare) :]}
            else:
                parts.add(word)
        parts = {w for w in parts if w not in known}
        known.update((w, older[w]) for w in parts if w in older)
        fresh = [w for w in parts if w not in known]
        later, first = [w for w in fresh if w[:1] == " "], [w for w in fresh if w[:1] != " "]
        known.update(zip(first, self._by_library(first)))
        for at in range(0, len(later), WORDS_AT_A_TIME):
            some = later[at : at + WORDS_AT_A_TIME]
            ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            data, starts = ids.tobytes(), (np.flatnonzero(self.after_blank[ids]) * 4).tolist()
            known.update((w, data[a:b]) for w, a, b in zip(some, starts, [*starts[1:], len(data)], strict=True))
        known.update((word, known[bare] + known[tail]) for word, bare, tail in marked)
        return parts.union(words)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, little-endian unsigned 32-bit numbers."""
        return [ids for at in range(0, len(texts), TEXTS_AT_A_TIME) for ids in self._encode(texts[at : at + TEXTS_AT_A_TIME])]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        # words with the blank before them; a line's first word has none
        cut = [None if _IRREGULAR.search(t) else [line.replace(" ", "\0 ").split("\0") for line in t.split("\n")] if "\0" not in t else None for t in texts]
        distinct = {word for lines in cut if lines for line in lines for word in line}
        lacking = [w for w in distinct if w not in self.known]
        if lacking and self.held > CACHE_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
            lacking = list(distinct)
        lacking = self._learn(lacking)
        get = self.known.__getitem__
        out = [self._irregular(t) if lines is None else self.newline.join([b"".join(map(get, line)) for line in lines]) for t, lines in zip(texts, cut)]
        for word in lacking:
            if len(word) > LONGEST_WORD:
                del self.known[word]
            else:
                self.held += ENTRY_BYTES + len(word) + len(self.known[word])
        return [np.frombuffer(x, "<u4") for x in out]

    def byte_ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes end in the bytes of all."""
        return np.cumsum(self.length[ids])

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each id in characters: from the character of its first byte
        to behind the character of its last."""
        ends = self.byte_ends(ids)
        character = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        return character[ends - self.length[ids]], character[ends - 1] + 1

    def split_tokens(self, data: bytes, ids: np.ndarray) -> int:
        """How many ids begin or end within a character of the text whose bytes are data."""
        ends = self.byte_ends(ids)
        inside = np.append((np.frombuffer(data, np.uint8) & 0xC0) == 0x80, False)
        return int(np.count_nonzero(inside[ends] | inside[ends - self.length[ids]]))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids; any that the table lacks is an error."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.table) or not self.known_ids[ids].all()):
            raise ValueError("an id is not in the table of ranks")
        length = self.length[ids]
        place = np.arange(int(length.sum())) + np.repeat(self.start[ids] - (np.cumsum(length) - length), length)
        return self.bytes[place].tobytes()

    def pieces(self, ids: np.ndarray) -> list[str]:
        """What each id adds to the text: a split character comes with the id that
        completes it; what is no UTF-8 becomes U+FFFD, at the last id at the latest."""
        decoder, last = codecs.getincrementaldecoder("utf-8")("replace"), len(ids) - 1
        return [decoder.decode(self.table[i], k == last) for k, i in enumerate(ids.tolist())]


@worker_cache
def ranked_codec(path: str) -> RankedCodec:
    """One codec in each Python worker. Spark runs the tasks side by side, so the library needs no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return RankedCodec(path)


def encode_by_ranks(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and of each id the characters from starts to ends (exclusive) that it holds or is part of."""

    def make():
        codec = ranked_codec(path)

        def step(rows):
            ids = codec.encode(rows["text"])
            spans = [codec.spans(t, i) for t, i in zip(rows["text"], ids)]
            return {"doc_id": rows["doc_id"], "ids": [i.astype(np.int32) for i in ids], "starts": [s.astype(np.int32) for s, _ in spans], "ends": [e.astype(np.int32) for _, e in spans]}

        return step

    return map_rows(id_and_text(docs), "doc_id long, ids array<int>, starts array<int>, ends array<int>", make, (ranked_codec,))


def decode_by_ranks(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes, text and pieces (what each id adds to the text) of doc_id and ids."""

    def make():
        codec = ranked_codec(path)

        def step(rows):
            ids = [None if x is None else np.array(x, "<u4") for x in rows["ids"]]
            data = [None if x is None else codec.decode(x) for x in ids]
            return {
                "doc_id": rows["doc_id"],
                "bytes": data,
                "text": [None if b is None else b.decode("utf-8", "replace") for b in data],
                "pieces": [None if x is None else codec.pieces(x) for x in ids],
            }

        return step

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, bytes binary, text string, pieces array<string>", make, (ranked_codec,))


def ranked_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns digests of both, and how many ids split a character."""

    def make():
        codec = ranked_codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def step(rows):
            ids = codec.encode(rows["text"])
            back = [codec.decode(i) for i in ids]
            return {
                "doc_id": rows["doc_id"],
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [sha(i.tobytes()) for i in ids],
                "decoded_sha256": [sha(b) for b in back],
                "split_tokens": [codec.split_tokens(b, i) for b, i in zip(back, ids)],
            }

        return step

    return map_rows(id_and_text(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, split_tokens long", make, (ranked_codec,))
