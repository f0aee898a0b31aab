"""The language stage: texts of no learned language go, all others stay."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from hearthline.llm import language_id as L

from . import helpers as H


def test_unlearned_texts_go(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto " * 4
    docs = H.documents(spark)
    strange = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate([noise(400), noise(3000), finnish])], H.SCHEMA).select(docs.columns)
    short = spark.createDataFrame([(2 * 10**9, "Zyx qua.", None, "s", 8)], H.SCHEMA).select(docs.columns)
    kept = {r["doc_id"] for r in P.language(spark, docs.unionByName(strange).unionByName(short), H.SF).collect()}
    assert not {10**9, 10**9 + 1, 10**9 + 2} & kept and 2 * 10**9 in kept
    before = {r["doc_id"] for r in docs.collect()}
    assert len(before & kept) >= 0.99 * len(before)


def test_without_labels_all_with_a_letter_stay(spark):
    docs = H.awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = [r["doc_id"] for r in P.language(spark, docs, H.SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [None, 4, 5, 6, 7, 7, 8]))


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    words = {k: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(600)}
    rows = [(1000 * n + k, " ".join(rng.choices(words[k], k=40)), f"l{k:03}", "s", 1) for k in range(600) for n in range(2)]
    labels, _ = learned = L.learn_prototypes(spark.createDataFrame(rows, H.SCHEMA).where("doc_id < 1000"), F.lit(True))
    assert labels == sorted(f"l{k:03}" for k in range(600))
    told = {r["doc_id"]: r["lang_pred"] for r in L.predict_language(spark.createDataFrame(rows, H.SCHEMA), learned).collect()}
    assert sum(told[d] == lang for d, _, lang, _, _ in rows) >= 0.99 * len(rows)


def test_repeated_ids_give_one_example(spark):
    rows = [(1, f"text number {i} of one id", "en", "s", 1) for i in range(300)] + [(2, "ein anderer Text", "de", "s", 1), (None, "no id", "en", "s", 1), (None, "none either", "en", "s", 1)]
    chosen = L._labelled(spark.createDataFrame(rows, H.SCHEMA), F.lit(True), L.TRAIN_TEXTS).collect()
    assert sorted((r["lang"], r["text"]) for r in chosen) == [("de", "ein anderer Text"), ("en", "no id"), ("en", "text number 0 of one id")]


def test_all_labelled_texts_are_learned_from(spark):
    """Prototypes and limits are those of every labelled text, computed here again without Spark."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=12)), "en", "s", 1) for i in range(21_000)] + [(7, "aaa", "en", "s", 1), (None, "none", "en", "s", 1), (None, "no id", "de", "s", 1)]
    docs = spark.createDataFrame(rows, H.SCHEMA)
    own = ["aaa" if i == 7 else t for i, t, *_ in rows[:21_000]]  # the first of the two of id 7
    vectors, sizes = L._vectors_and_sizes(own)
    total = vectors.sum(0, dtype=np.float64)
    (labels, prototypes), limits = L.learn_prototypes_and_limits(docs, F.lit(True))
    assert labels == ["de", "en"] and np.abs(prototypes[1] - total / np.linalg.norm(total)).max() < 1e-6
    others = total - vectors
    cosine, band = (others * vectors).sum(1) / np.linalg.norm(others, axis=1), L._band(sizes)
    for b in set(band.tolist()) - {-1}:
        if (band == b).sum() >= L.FEWEST:
            assert abs(limits[b] - np.quantile(cosine[band == b], L.LOW_QUANTILE)) < 1e-6
