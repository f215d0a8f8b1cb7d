"""Writing: reports, partitions, keyed upserts, dimensions, logs. Nothing is overwritten that is being read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_report(rows: DataFrame, stats: DataFrame, path: str) -> None:
    """SNK1. Rows and their one row of statistics as JSON, below ``path``."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/statistics")


def write_by_city(df: DataFrame, city: str, path: str) -> None:
    """SNK2. A folder for each city."""
    df.write.mode("overwrite").partitionBy(city).parquet(path)


def surrogate(*columns: str) -> Column:
    """A key that follows from the natural key."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def upsert_by_key(old: DataFrame, new: DataFrame, key: str, updated: str, created: str) -> DataFrame:
    """SNK3. The latest row of each key, with the earliest ``created``. Write it to a new snapshot.

    Of equally late rows the new side's wins, and within a side the greatest by its other columns. One aggregate, merged from partial ones.
    """
    sides = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    comparable = [c for c in old.columns if c not in (key, updated) and not isinstance(old.schema[c].dataType, T.MapType | T.VariantType)]
    order = F.struct(updated, "_side", *comparable)
    row = F.struct(*(c for c in old.columns if c != key))
    out = sides.groupBy(key).agg(F.max_by(row, order).alias("_row"), F.min(created).alias("_created"))
    return out.select(*((F.col("_created") if c == created else F.col(c) if c == key else F.col(f"_row.{c}")).alias(c) for c in old.columns))


def get_or_create_dim(facts: DataFrame, dim: DataFrame, natural: list[str], key: str) -> DataFrame:
    """SNK4. The dimension with a row for each natural key of the facts."""
    new = facts.select(*natural).distinct().join(dim, natural, "left_anti").withColumn(key, surrogate(*natural))
    return dim.unionByName(new, allowMissingColumns=True)


def normalise_items(items: DataFrame, key: str, place: str, category: str, labels: dict[str, str]) -> dict[str, DataFrame]:
    """SNK5. Nested items as tables: ``items`` with a category key, and a link table for each (name: list column)."""
    base = items.withColumn("category_id", surrogate(place, category))
    out = {"items": base.drop(*labels.values()), "categories": base.select("category_id", place, F.col(category).alias("name")).distinct()}
    return out | {name: base.select(key, F.explode(column).alias("label")).distinct() for name, column in labels.items()}


def append_log(df: DataFrame, path: str) -> None:
    """SNK6. Rows added to a log."""
    df.write.mode("append").parquet(path)


def stream_log(rows: DataFrame, path: str, checkpoint: str, call: str, at: str, late: str = "1 hour", every: str | None = None):
    """SNK6. Starts a stream of log rows into files below ``path``; a call that is logged again within ``late`` counts once.

    ``call``: the column that names a call; ``at``: its time, the watermark's. State is bounded by the calls of that time. The file
    sink commits each batch once, so a stream that starts again from ``checkpoint`` adds nothing twice. Reads of ``path`` through Spark see
    committed files alone. Rows without a time are dropped: they have no place in the window; times become timestamps of the session's zone.
    """
    once = rows.withColumn(at, F.col(at).cast("timestamp")).filter(F.col(at).isNotNull()).withWatermark(at, late).dropDuplicatesWithinWatermark([call])
    writer = once.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def session_rows(df: DataFrame, session: list[str], success: Column, started: str, ended: str) -> DataFrame:
    """SNK7. A row for each run: start, end, rows, successes, status."""
    out = df.groupBy(*session).agg(F.min(started).alias("started_at"), F.max(ended).alias("ended_at"), F.count("*").alias("n_rows"), F.count_if(success).alias("n_successes"))
    return out.withColumn("status", F.when(F.col("n_successes") > 0, "completed").otherwise("failed"))


def export_place(places: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """SNK8. Each place with its items as a list, for ``write.json``; a place's menu fits a row."""
    row = F.struct(*(c for c in items.columns if c != key))
    return places.join(items.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("menu_items")), key, "left").withColumn("menu_items", F.coalesce("menu_items", F.array()))


def export_csv(places: DataFrame, items: DataFrame, key: str, path: str) -> None:
    """SNK8. A flat CSV with a header below ``path``: a line for each item with its place's columns, and one for a place without items.

    An item's columns are called ``item_<name>``; lists are joined by ``;``, other nested values are JSON. Quotes are doubled, and a
    null is an empty field.
    """

    def flat(field: T.StructField, name: str) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType) and not isinstance(field.dataType.elementType, T.StructType | T.ArrayType | T.MapType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
        elif isinstance(field.dataType, T.StructType | T.ArrayType | T.MapType):
            c = F.to_json(c)
        return c.alias(name)

    left = places.select(*(flat(f, f.name) for f in places.schema))
    right = items.select(F.col(key).alias("_key"), *(flat(f, f"item_{f.name}") for f in items.schema if f.name != key))
    rows = left.join(right, left[key].eqNullSafe(right["_key"]), "left").drop("_key")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
