"""All registered queries of the library, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryline.functions import text
from pantryline.operators import metrics
from pantryline.plans import groups, landing, menus, pages, places, serving, tagging  # noqa: F401  they register themselves
from pantryline.plans.base import QUERIES, SQL, Tables

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as menu items: the ten most frequent categories."""
    named = Tables(spark, sf_dir).part.select(text.category(F.col("p_name"), tagging.CATS).alias("category"))
    return metrics.top_counts(metrics.value_counts(named, F.col("category"), "category"), "category")
