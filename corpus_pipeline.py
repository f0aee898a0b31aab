"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. Rows with null or empty
text, text without a letter or of a language that was not learned, end at the first stage. Null doc_ids pass
through: they are never near-duplicates. Rows that repeat a doc_id stay or go
together. Further columns are carried along, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import materialize, read_table
from hearthline.llm.language_id import keep_languages, learn_prototypes_and_limits
from hearthline.llm.near_duplicates import keep_one_of_each
from hearthline.llm.packing import pack_documents
from hearthline.llm.quality import keep_quality, learn_quality
from hearthline.llm.queries import vocabulary_path
from hearthline.llm.secrets import redact_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled ones taught, with a score that labelled ones of
    their length reach; the rest go. Very short ones stay, as do all where there are no labels."""
    learned, limits = learn_prototypes_and_limits(docs, F.lit(True))
    return keep_languages(docs, learned, limits=limits)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels of kept documents, accepts."""
    labels = read_table(spark, sf_dir, "labels")
    return keep_quality(docs, learn_quality(docs, labels, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group over five-word shingles at 0.8."""
    return keep_one_of_each(docs, shingle=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with ids and places in their windows."""
    return pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL says what these models keep.
ORACLE_SQL = None
