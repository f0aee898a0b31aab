"""Small document tables with awkward rows."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"

LONG = "lorem ipsum dolor " * 40_000
AWKWARD = [
    (None, "no id here", "en", "s", 1),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \t\n ", "en", "s", 4),
    (4, "Ünï çødé 日本語 😀 \u0000 \x1c x", "en", "s", 9),
    (5, LONG, "en", "s", len(LONG)),
    (6, "same text twice over again", "en", "s", 5),
    (7, "same text twice over again", "en", "s", 5),
    (7, "same text twice over again", "en", "s", 5),
    (8, "don't <|endoftext|> stop  \n\n now", "en", "s", 5),
    (9, "12345 67", "en", "s", 5),
]


def awkward(spark):
    """Rows with nulls, extremes and repeats, and columns whose names clash with results."""
    rows = [r + ("x", "y", 1) for r in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA + ", ids string, score string, spans int")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)
