"""A corpus pipeline: toxicity, quality rules, near copies, benchmark leaks, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
``docs`` (doc_id, text, lang, ...) as they are, whatever the others are called.

Nulls: a null text counts as empty, and the quality rules drop it; a row without id is judged by its text and is nobody's copy;
a null language is one of its own. Empty texts go, long ones are read whole. Of equal texts, and of repeated rows, one stays
(by the least id). An empty input passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryline.llm import decontamination, fertility, pieces, queries, simhash, toxicity
from pantryline.llm.common import apart, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay; a null text scores as the intercept does. Equal texts are judged alike."""
    plain, back = apart(docs, "doc_id", "text")
    model = queries.toxicity_model(spark, plain.select("doc_id", "text"), sf_dir)
    return back(toxicity.score(plain, model).filter("score < 0.5"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that pass the base rules and lie within the fertility bands of their language.

    Null and empty texts fail. A null language has bands of its own. Equal texts of one language are judged alike.
    """
    plain, back = apart(docs, "text", "lang")
    return back(fertility.quality(plain, queries.vocabularies()).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the least id: shingles of five words, a similarity of 0.8.

    Null and empty texts are copies of each other. Rows without id stay; repeated rows leave one.
    """
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item stay; null and empty texts hold none."""
    return decontamination.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's best segmentation, with the scores of its four best; one of no pieces for a null or empty text."""
    best = pieces.encode(docs, queries.PIECES, 4)
    return best.select("doc_id", F.col("ids")[0].alias("ids"), F.col("n_pieces")[0].alias("n_pieces"), F.col("scores").alias("nbest_scores"), F.col("ids_crc32").alias("nbest_crc32"), "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near copies", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("pieces", to_pieces),
]
#: SQL cannot express the classifier, the fingerprints or the lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
