"""Token counts without encoding.

Before the job, every vocabulary string is put through the merges once; those that
come back as a single token form the whole-token table, which is sent to the tasks.
Pre-tokens found in it count as one directly; only the rest are merged, and only
their number is kept. Long ones (over LONG bytes) are merged by the backtracking
encoder, which gives the same tokens in linear time.

Null texts count as empty (no tokens, not over the limit). Special strings count
as one token. Rows are returned one for one, in any order; an empty table gives
an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame

from .byte_bpe import CACHE_BYTES, _IRREGULAR, Encoder, Vocabulary, vocabulary
from .common import BoundedCache, id_and_text, map_rows, worker_cache


LONG = 64


@functools.cache
def whole_tokens(path: str) -> bytes:
    """A flag for each token id: 1 where its string alone encodes as it, proved by merging each."""
    vocab = vocabulary(path)
    flags = bytearray(len(vocab.token))
    for text, i in vocab.ids.items():
        flags[i] = vocab.merge(text) == [i]
    return bytes(flags)


class TokenCounter:
    def __init__(self, path: str, whole: bytes):
        self.vocab: Vocabulary = vocabulary(path)
        self.whole = frozenset(text for text, i in self.vocab.ids.items() if whole[i])
        self.merged = BoundedCache(self._merged, CACHE_BYTES // 8)
        self.first = BoundedCache(self._chunk, CACHE_BYTES // 8)
        self.later = BoundedCache(self._word, CACHE_BYTES)
        self.special = re.compile("|".join(map(re.escape, sorted(self.vocab.special, key=len, reverse=True))) or r"(?!)")

    @functools.cached_property
    def encoder(self) -> Encoder:
        return Encoder(self.vocab)

    def _merged(self, piece: str) -> int:
        return len(self.vocab.merge(piece) if len(piece) <= LONG else self.encoder.encode(piece))

    def _chunk(self, text: str) -> int:
        whole, merged = self.whole, self.merged
        return sum(1 if p in whole else merged[p] for p in self.vocab.pretokens(text))

    def _word(self, chunk: str) -> int:
        """Of a chunk with a space before it; with punctuation behind, the word's own count is looked up."""
        word, bare = self.vocab.bare_word(chunk)
        if not bare:
            return self._chunk(" " + chunk)
        if len(word) < len(chunk):
            return self.later[word] + self._chunk(chunk[len(word) :])
        piece = (" " + word).encode().decode("latin-1")
        return 1 if piece in self.whole else self._merged(piece)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if _IRREGULAR.search(text):
            return self._chunk(text)
        lines = text.split("\n")
        n, later = len(lines) - 1, self.later.__getitem__
        for line in lines:
            words = line.split(" ")
            n += self.first[words[0]] + sum(map(later, words[1:]))
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@worker_cache
def token_counter(path: str, whole: bytes) -> TokenCounter:
    return TokenCounter(path, whole)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every text."""

    whole = whole_tokens(path)

    def make():
        counter = token_counter(path, whole)

        def step(rows):
            n = [counter.count(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_bytes": [len(t.encode()) for t in rows["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return step

    return map_rows(id_and_text(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make, (token_counter,))
