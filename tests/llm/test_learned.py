"""Language and quality: held-out accuracy, awkward rows, nothing learned from held-out labels."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from hearthline.llm import language_id as L
from hearthline.llm import quality as Q

from . import helpers as H

SF = "/root/testdata/sf0.01"


def test_language_of_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.language_of_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert len(rows) == docs.count() and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)
    blind = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.col("lang")))
    again = {r["doc_id"]: r["lang_pred"] for r in L.language_of_held_out(blind).collect()}
    assert again == {r["doc_id"]: r["lang_pred"] for r in rows}


def test_document_vectors_are_bundles():
    one, two, three = L._letters()
    s = lambda c: ord(c)
    v = L.document_vectors(["Ab", None, "12", "ab"])
    gap = 0
    plain = [(gap, s("a"), s("b")), (s("a"), s("b"), gap)]
    want = sum(one[a].astype(float) * two[b] * three[c] for a, b, c in plain)
    assert np.allclose(v[0], want / np.linalg.norm(want), atol=1e-6) and np.allclose(v[0], v[3])
    assert not v[1].any() and not v[2].any()


def test_language_of_awkward_rows(spark):
    got = L.language_of_held_out(H.awkward(spark)).collect()
    assert len(got) == len(H.AWKWARD)
    by_id = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3, 9):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[6]["lang_pred"] == "en"
    assert L.language_of_held_out(H.empty(spark)).count() == 0
    unlabelled = L.language_of_held_out(H.awkward(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    kept = L.keep_languages(H.awkward(spark), L.learn_prototypes(H.awkward(spark), F.lit(True)))
    assert kept.columns == H.awkward(spark).columns
    assert {1, 2, 3, 9}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_quality_of_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = Q.quality_of_held_out(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert scored.count() == docs.count() and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    good = [r["score"] for r in held if r["quality"]]
    assert np.mean([g > b for g in good for b in [r["score"] for r in held if not r["quality"]]]) > 0.98
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in Q.quality_of_held_out(docs, other).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-12 for r in rows)


def test_discriminant_is_a_density_ratio():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (4000, 2)), rng.normal([1, 0], [2, 0.5], (4000, 2))])
    y = np.repeat([0.0, 1.0], 4000)
    m = Q.Discriminant.fit(x, y)
    log = lambda p, mean, std: -0.5 * (((p - mean) / std) ** 2).sum(1) - np.log(std).sum()
    truth = log(x, np.array([1, 0]), np.array([2, 0.5])) - log(x, np.array([0, 0]), np.array([1, 1]))
    assert np.corrcoef(m.difference(x), truth)[0, 1] > 0.95


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.where("false"), labels.where("doc_id = 6")):
        got = Q.quality_of_held_out(H.awkward(spark), given).collect()
        assert len(got) == len(H.AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert Q.quality_of_held_out(H.empty(spark), labels).count() == 0
    model = Q.learn_quality(H.awkward(spark), labels, F.lit(True))
    assert Q.keep_quality(H.awkward(spark), model, 0.0).count() == len(H.AWKWARD)


def test_rare_languages_are_learned(spark):
    """A language of three texts among thousands gives all of them, a frequent one its share."""
    rows = [(i, f"the plain words of number {'abcdefghij'[i % 10] * 3} again", "en") for i in range(3000)]
    rows += [(10_000 + i, "żółw źdźbło gęślą jaźń łąka ćma", "pl") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = {r["lang"]: r["count"] for r in L._labelled(docs, F.lit(True), 1000).groupBy("lang").count().collect()}
    assert chosen["pl"] == 3 and 350 < chosen["en"] < 650
    learned = L.learn_prototypes(docs, F.lit(True), 1000)
    assert learned[0] == ["en", "pl"]
    assert L.predict_language(docs.where("doc_id >= 10000"), learned).first()["lang_pred"] == "pl"


def test_repeated_ids_give_one_example_each(spark):
    docs = spark.createDataFrame([(1, f"good text number {i}.") for i in range(500)] + [(2, "BAD!!! 777 bad bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = Q.learn_quality(docs, labels, F.lit(True))
    assert model.share == 0.5 and model.score(np.array([Q.statistics("good text number 3."), Q.statistics("BAD!!! 777 bad bad")]))[0] > 0.5


def test_statistics_against_a_plain_reading():
    """The statistics, computed again from their description, word by word."""
    text = "Good words here. Good words THERE!\nGood words here. 12 % of it\n12 % of it"
    words, lines, size = text.split(), text.split("\n"), len(text.encode())
    share = lambda part, whole, usual, weight=20: np.log((p := (part + usual * weight) / (whole + weight)) / (1 - p))
    n, sizes = len(words), [len(w) for w in words]
    mean = (sum(sizes) + 50) / (n + 10)
    count = lambda kinds: sum(c in kinds for c in text)
    letters = sum(c.isalpha() for c in text)
    want = [
        np.log(mean),
        np.log1p(max(0, (sum(x * x for x in sizes) + 350) / (n + 10) - mean**2)),
        np.log((n + 90) / (len(lines) + 3)),
        np.log((len(set(words)) + 20) / (n + 20) ** 0.9),
        share(max(words.count(w) for w in words), n, 0.06),
        share(sum(a == b for a, b in zip(words, words[1:])), n, 0.01),
        share(n - 1 - len({(a, b) for a, b in zip(words, words[1:])}), n, 0.02),
        share(len(lines) - len(set(lines)), len(lines), 0.02),
        share(sum(c.isupper() for c in text), letters, 0.03, 100),
        share(sum(c.isdigit() for c in text), size, 0.004, 100),
        share(count(".,;:'\"-()?!"), size, 0.03, 100),
        share(count("%"), size, 0.001, 100),
        share(count("!?"), size, 0.001, 100),
        share(text.count(". ") + text.count(".\n"), n, 0.08),
    ]
    assert np.allclose(Q.statistics(text), want)


def test_predictions_against_brute_force(spark):
    """Every prototype and cosine again from whole trigram vectors, one text at a time."""
    docs = H.documents(spark).where("doc_id < 120")
    rows = docs.collect()
    one, two, three = L._letters()

    def vector(text):
        signs = [0]
        for c in text or "":
            s = int(L._sign_table()[min(ord(c), L._CODES - 1)])
            if s or signs[-1]:
                signs.append(s)
        if signs[-1]:
            signs.append(0)
        total = np.zeros(L.DIMENSIONS)
        for a, b, c in zip(signs, signs[1:], signs[2:]):
            total += one[a].astype(float) * two[b] * three[c]
        return total / (np.linalg.norm(total) or 1)

    vectors = {r["doc_id"]: vector(r["text"]) for r in rows}
    sums: dict = {}
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vectors[r["doc_id"]]
    langs = sorted(sums)
    prototypes = np.array([sums[x] / np.linalg.norm(sums[x]) for x in langs])
    for r in L.language_of_held_out(docs).collect():
        cosine = prototypes @ vectors[r["doc_id"]]
        assert abs(max(0, cosine.max()) - r["score"]) < 1e-4
        assert r["lang_pred"] == langs[cosine.argmax()] or np.sort(cosine)[-1] - np.sort(cosine)[-2] < 1e-4 or not vectors[r["doc_id"]].any()


def test_all_labels_are_learned_from(spark):
    """More labels than a sample would take: shares, means and covariances are those of all, computed here again."""
    rng = np.random.default_rng(6)
    texts = [" ".join(w) for w in rng.choice(["plain", "words", "OF", "many", "sorts!", "12"], (300, 9))]
    rows = [(i, texts[(i * 7 + i // 300) % 300]) for i in range(41_000)]
    quality = [int(t.count("OF") + rng.integers(0, 3) < 3) for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.learn_quality(docs, spark.createDataFrame([(i, q) for (i, _), q in zip(rows, quality)], "doc_id long, quality int"), F.lit(True))
    known = {t: Q.statistics(t) for t in texts}
    x, y = np.array([known[t] for _, t in rows]), np.array(quality, float)
    want = Q.Discriminant.fit(x, y)
    assert model.share == y.mean() and all(np.abs(a - x[y == c].mean(0)).max() < 1e-5 for c, a in enumerate(model.mean))
    assert np.abs(model.score(x) - want.score(x)).max() < 1e-3
