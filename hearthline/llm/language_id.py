"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector is the product
of its letters' vectors, each permuted (rotated) by its place; a document's
vector bundles (adds) those of its trigrams; a language's prototype bundles its
documents' unit vectors. A document gets the language whose prototype has the
largest cosine, and that cosine, 0 at least, as its score. Ties go to the first
label in alphabetical order.

To keep or drop a text, its score is held against the lowest that labelled texts of
its length get for their own language (a low quantile, each text left out of its
prototype). Texts of fewer than SHORT trigrams say too little and are kept; where
nothing was learned, all with a letter are kept.

Texts that are null or hold no letter are `und` with a score of 0, and so is all
where nothing could be learned. Prototypes and limits come from all labelled texts. A
caller may ask for about train_texts of them: then each language gives all its texts
where it has few, else an equal share (LANGUAGE_TEXTS at least), chosen by a hash of
doc_id. Every language is learned. Of documents that share an id (or have none) one is
learned from, the first by language and text. In the result repeated rows stay repeated; an
empty table gives an empty table; further columns, whatever their names, are
kept by `keep_languages` and not read by the rest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.quantiles import exact_quantiles

from .common import begin_task, column_udf, id_remainder, map_rows, materialize, row_slices, ship_package, small_batches, sum_vectors

DIMENSIONS = 1024
#: How many labelled texts are learned from (None: all), and how many of a language at least where they are bounded.
TRAIN_TEXTS: int | None = None
LANGUAGE_TEXTS = 500
#: Languages whose sums a task holds at a time.
SUMS_HELD = 1024
UNKNOWN = "und"
#: Texts of fewer trigrams are never rejected by their score; bands of length are powers of two up to the last.
SHORT, LAST_BAND = 16, 12
#: The quantile that is the limit, and how many labelled texts it takes.
LOW_QUANTILE, FEWEST = 0.001, 20
#: Letters have signs of their own up to Latin Extended-A; others share the rest.
_OWN, _BITS = 0x180, 10
_CODES = 0x40000


@functools.cache
def _sign_table() -> np.ndarray:
    """The sign of each character: 0 for what is no letter, else that of its lower case."""
    table = np.zeros(_CODES, np.int64)
    for code in range(_CODES):
        c = chr(code)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[code] = low if low < _OWN else _OWN + low * 2654435761 % (1 << 32) % ((1 << _BITS) - _OWN)
    return table


@functools.cache
def _letters(seed: int = 5) -> list[np.ndarray]:
    """Letter vectors as they stand in the first, second and third place."""
    v = (np.random.default_rng(seed).integers(0, 2, (1 << _BITS, DIMENSIONS)) * 2 - 1).astype(np.int8)
    return [np.roll(v, 2 - k, axis=1) for k in range(3)]


def trigrams(text: str) -> np.ndarray:
    """Codes of the trigrams of letters, runs of anything else being one gap."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sign = np.zeros(len(code) + 2, np.int64)
    sign[1:-1] = _sign_table()[np.minimum(code, _CODES - 1)]
    sign = sign[np.append(True, (sign[1:] > 0) | (sign[:-1] > 0))]
    if len(sign) < 3:
        return np.empty(0, np.int64)
    return (sign[:-2] << 2 * _BITS) | (sign[1:-1] << _BITS) | sign[2:]


def _vectors_and_sizes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts (zeros where there is no letter), and their numbers of trigrams."""
    grams = [trigrams(t) if t else np.empty(0, np.int64) for t in texts]
    sizes = np.array([len(g) for g in grams])
    if not sizes.sum():
        return np.zeros((len(texts), DIMENSIONS), np.float32), sizes
    key, count = np.unique((np.repeat(np.arange(len(texts)), sizes) << 3 * _BITS) | np.concatenate(grams), return_counts=True)
    gram, place = np.unique(key & ((1 << 3 * _BITS) - 1), return_inverse=True)
    mask, (one, two, three) = (1 << _BITS) - 1, _letters()
    bound = one[gram >> 2 * _BITS] * two[(gram >> _BITS) & mask] * three[gram & mask]
    edges = np.searchsorted(key >> 3 * _BITS, np.arange(len(texts) + 1))
    weight, out = count.astype(np.float32), np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        for at in range(a, b, 4096):
            stop = min(b, at + 4096)
            out[i] += weight[at:stop] @ bound[place[at:stop]].astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), sizes


def document_vectors(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of the texts; zeros where there is no letter."""
    return _vectors_and_sizes(texts)[0]


def _band(sizes: np.ndarray) -> np.ndarray:
    """The band of each length; -1 for texts that are too short to be rejected."""
    return np.where(sizes < SHORT, -1, np.minimum(np.log2(np.maximum(sizes, 1)).astype(np.int64), LAST_BAND))


def _labelled(docs: DataFrame, may_learn: Column, train_texts: int | None) -> DataFrame:
    """Documents with a label where may_learn holds, one of each id: all, or a bounded number of each language."""
    labelled = docs.select(F.col("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang")).where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if train_texts is not None:
        known = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
        each = max(LANGUAGE_TEXTS, train_texts // max(1, len(known)))
        shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, each / r["n"]) * (1 << 30))) for r in known], "lang string, share long")
        labelled = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share"))
    return _one_of_each_id(labelled)


def _one_of_each_id(labelled: DataFrame) -> DataFrame:
    """Of the rows of an id (or without one) the first by language and text. Where ids that
    repeat are few, no text moves but theirs."""
    counted = labelled.groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = materialize(counted.where("n > 1").select(F.col("doc_id").alias("id")), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    first = labelled.join(repeated, same, "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r"))
    return labelled.join(repeated, same, "left_anti").select("text", "lang").unionByName(first.select("r.text", "r.lang"))


def _label_sums(chosen: DataFrame) -> dict[str, np.ndarray]:
    """The sum of the unit vectors of each label that has a letter."""
    ship_package(chosen.sparkSession)
    small_batches(chosen.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        sums: dict[str, np.ndarray] = {}

        def held() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "vector"])

        for rows in row_slices(batches):
            vectors = document_vectors(rows["text"])
            found, which = np.unique(np.array(rows["lang"], object), return_inverse=True)
            for k, x in enumerate(found):
                sums[x] = sums.get(x, 0) + vectors[which == k].sum(0, dtype=np.float64)
            if len(sums) > SUMS_HELD:
                yield held()
                sums.clear()
        if sums:
            yield held()

    sums = sum_vectors(chosen.mapInArrow(run, "lang string, vector array<double>"), "lang", "vector")
    return {k: np.array(sums[k]) for k in sorted(sums) if np.any(sums[k])}


def _prototypes(sums: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    p = np.array(list(sums.values()), np.float32).reshape(len(sums), DIMENSIONS)
    return list(sums), p / np.linalg.norm(p, axis=1, keepdims=True) if sums else p


def _limits(chosen: DataFrame, sums: dict[str, np.ndarray]) -> dict[int, float]:
    """The least score of each band: the low quantile of labelled texts' cosine with the
    prototype of the others of their language; over all bands where a band has too few,
    none where all have."""

    def make():
        def step(rows):
            vectors, sizes = _vectors_and_sizes(rows["text"])
            band, cosine = _band(sizes), np.full(len(sizes), np.nan)
            for i in np.flatnonzero(band >= 0):
                others = sums[rows["lang"][i]] - vectors[i]
                norm = np.linalg.norm(others)
                if norm > 1e-3:  # else it is the only text of its language
                    cosine[i] = others @ vectors[i] / norm
            known = ~np.isnan(cosine)
            return {"band": band[known].tolist(), "cosine": cosine[known].tolist()}

        return step

    own = materialize(map_rows(chosen, "band long, cosine double", make), "cosines")  # two numbers of each text
    number = {r["band"]: r["count"] for r in own.groupBy("band").count().collect()}
    number[None] = sum(number.values())
    each = own.select(F.explode(F.array(F.col("band").cast("string"), F.lit("None"))).alias("feature"), F.col("cosine").alias("x"))
    found = exact_quantiles(each, [LOW_QUANTILE])
    low = {b: max(0.0, found[str(b)][0]) for b, n in number.items() if n >= FEWEST}
    return {b: low.get(b, low.get(None, 0.0)) for b in range(int(np.log2(SHORT)), LAST_BAND + 1)}


def learn_prototypes(docs: DataFrame, may_learn: Column, train_texts: int | None = TRAIN_TEXTS) -> tuple[list[str], np.ndarray]:
    """Labels, sorted, and unit prototypes, from documents with a label where may_learn holds."""
    return _prototypes(_label_sums(_labelled(docs, may_learn, train_texts)))


def learn_prototypes_and_limits(docs: DataFrame, may_learn: Column, train_texts: int | None = TRAIN_TEXTS) -> tuple[tuple[list[str], np.ndarray], dict[int, float]]:
    """The prototypes, and the least score by band that keep_languages takes."""
    chosen = _labelled(docs, may_learn, train_texts)
    sums = _label_sums(chosen)
    return _prototypes(sums), _limits(chosen, sums) if sums else {}


def _predict(labels: list[str], prototypes: np.ndarray, texts: list[str | None]) -> tuple[list[str], list[float]]:
    return _predict_vectors(labels, prototypes, document_vectors(texts))


def _predict_vectors(labels: list[str], prototypes: np.ndarray, vectors: np.ndarray) -> tuple[list[str], list[float]]:
    if not labels:
        return [UNKNOWN] * len(vectors), [0.0] * len(vectors)
    cosine = vectors @ prototypes.T
    best = cosine.argmax(1)
    some = vectors.any(1)
    score = np.where(some, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
    return [labels[b] if s else UNKNOWN for b, s in zip(best, some)], score.astype(float).tolist()


def predict_language(docs: DataFrame, learned: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""

    def make():
        def step(rows):
            lang, score = _predict(*learned, rows["text"])
            return {"doc_id": rows["doc_id"], "lang_pred": lang, "score": score}

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, lang_pred string, score double", make)


def keep_languages(docs: DataFrame, learned: tuple[list[str], np.ndarray], least: float = 0.0, limits: dict[int, float] | None = None) -> DataFrame:
    """The rows, with all columns, that have a letter and whose language is known with the
    least score or more; limits by band of length hold besides. Where nothing was learned, all with a letter."""

    def make():
        def step(texts):
            vectors, sizes = _vectors_and_sizes(texts.to_pylist())
            _, score = _predict_vectors(*learned, vectors)
            floor = [max(least, (limits or {}).get(b, 0.0)) for b in _band(sizes).tolist()]
            return [bool(some and (not learned[0] or s >= f)) for some, s, f in zip(vectors.any(1), score, floor)]

        return step

    return docs.where(column_udf("boolean", make)(F.col("text")))


def language_of_held_out(docs: DataFrame, divisor: int = 3, held: int = 1) -> DataFrame:
    """Learns from documents whose id's remainder isn't held, and predicts all."""
    learned = learn_prototypes(docs, id_remainder(F.col("doc_id"), divisor) != held)
    return predict_language(docs, learned).select("doc_id", (id_remainder(F.col("doc_id"), divisor) == held).alias("held_out"), "lang_pred", "score")
