"""Small tables with every awkward case."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "end"


def words(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    """Random words."""
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with nulls, empty and long texts, exact and near copies, repeated rows and odd characters."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(20, 200)) for _ in range(n)]
    texts += [texts[0], texts[1], texts[2] + " tail", "Up " + texts[3]]
    texts += [None, "", " \t\n", "one", "one two three", LONG, "Ñandú ÄÖ 日本語 🎉  x▁y", "a\x1fb\x85c <|endoftext|> it's", texts[5].upper()]
    rows = [(i, x, ("en", "de", None)[i % 3], "s", len(x or "")) for i, x in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "no id at all here", "en", "s", 0)]


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """As the documents table, over several partitions."""
    return spark.createDataFrame(rows, DOCS).repartition(4, "n_chars")
