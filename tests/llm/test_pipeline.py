"""The pipeline's stages: what goes, what stays, and awkward rows."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from hearthline.llm.common import materialize

from . import helpers as H
from .test_near_duplicates import brute_force


def test_stages(spark):
    docs = H.documents(spark)
    assert [n for n, _ in P.STAGES] == ["language", "quality", "near_duplicates", "secrets", "packing"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{H.SF}/labels.parquet").collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, H.SF)
        if name != "packing":
            assert out.columns == docs.columns
            out = out.cache()
            before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language":
            assert len(after) >= 0.97 * len(before)
        if name == "quality":
            known = [i for i in before if i in labels]
            assert sum((i in after) == (labels[i] == 1) for i in known) > 0.95 * len(known)
        if name == "near_duplicates":
            assert set(after) == {i for i, (_, c) in brute_force(before.items(), 5, 80).items() if i == c} and len(after) < len(before)
        if name == "secrets":
            assert set(after) == set(before) and any("[SECRET]" in t for t in after.values())
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(before)
        docs = out
    assert P.run(spark, H.SF).count() == docs.count()


def test_awkward_rows(spark):
    docs = H.awkward(spark)
    for name, stage in P.STAGES:
        out = stage(spark, docs, H.SF)
        assert stage(spark, docs.where("false"), H.SF).count() == 0
        out.count()


def test_further_columns(spark):
    """Columns of any name and type are carried along and keep their values."""
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 7 == 0, F.lit("\npassword = abcdefgh12345678")).otherwise(""))
    docs = H.documents(spark).where("doc_id < 60").withColumn("text", text).withColumn("n_chars", F.concat(F.lit("about "), F.col("n_chars")))
    docs = docs.selectExpr("doc_id AS `a``b`", "named_struct('a b', doc_id, 'c', array(1)) AS box", "INTERVAL '1-2' YEAR TO MONTH AS span", "doc_id * 2 AS redacted", "1 AS score", "map('k', doc_id) AS m", "CAST(source AS BINARY) AS raw", "*")
    told = lambda df: df.withColumn("span", F.col("span").cast("string")).collect()
    before = {r["doc_id"]: r for r in told(docs)}
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, H.SF), name)
    rows = told(docs)
    assert docs.columns == ["a`b", "box", "span", "redacted", "score", "m", "raw", "doc_id", "text", "lang", "source", "n_chars"] and len(rows) > 20
    assert all(tuple(r)[:8] == tuple(before[r["doc_id"]])[:8] and r["n_chars"] == before[r["doc_id"]]["n_chars"] for r in rows)
    assert any("[SECRET]" in r["text"] for r in rows)
    assert P.STAGES[-1][1](spark, docs, H.SF).count() >= len(rows)
