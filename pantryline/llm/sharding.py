"""Two-pass external shuffle into shards. DataFrame functions only.

Pass 1 scatters the records uniformly into buckets that fit a task's memory, by a seeded hash of the whole record; the
files of Spark's exchange are the buckets. Pass 2 puts each bucket in a fixed order, shuffles it with Spark's seeded
``shuffle`` (a Fisher-Yates permutation) and writes it. Bucket sizes are counted beforehand over thin rows, so each
record knows its place in the whole order: shard ``k`` of ``n`` holds the places from ``k/n`` to ``(k+1)/n``, which is
the law ``rows`` (counts at most one apart), and slots have no gaps.

A bucket can outgrow its size only by records that are equal in every column. If one does, equal records are numbered from 0,
and the number is hashed too, so they spread; which copy gets which number makes no difference. So the seed and the records
fix the order, however the input is dealt to tasks.

Nulls: hashed as such; a null text has no bytes. Empty and long texts, ties and repeated rows are records like any other. Other
columns come back as they are, whatever their names; one called shard or slot gives way to the shuffle's. An empty input
writes no shard and gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pantryline.llm.common import apart, new_path, text_bytes, written


def external_shuffle(df: DataFrame, path: str, shards: int = 8, seed: int = 42, bucket_bytes: int = 32 << 20, least_buckets: int = 64, text: str = "text") -> DataFrame:
    """Writes ``df`` to ``path`` as ``shard=K`` folders of Parquet in shuffled order; returns the rows as read again.

    Columns: those of ``df``, then slot (long, from 0 in each shard) and shard (int).
    """
    df, back = apart(df, text, own=("slot", "shard"))
    buckets = max(least_buckets, math.ceil(text_bytes(df, text) / bucket_bytes))
    record = df.select(F.struct(*df.columns).alias("_row"), F.lit(0).cast("long").alias("_copy"))
    sizes = written(_sizes(record, text, seed, buckets), "bucket-sizes")  # the records are hashed once for both uses
    largest = sizes.agg(F.max("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    if largest["bytes"] and largest["bytes"] > 4 * bucket_bytes and buckets > 1:
        record = _numbered(record)
        sizes = written(_sizes(record, text, seed, buckets), "bucket-sizes")
    total = largest["n"] or 0
    # a row for each bucket, so the ordered sum stays small
    offsets = sizes.selectExpr("_bucket", "sum(n) over (order by _bucket) - n as first")
    # a task for each bucket
    dealt = record.withColumn("_bucket", _bucket(seed, buckets)).repartitionById(buckets, F.col("_bucket"))
    arrays = dealt.groupBy("_bucket").agg(F.sort_array(F.collect_list(F.struct("_row", "_copy"))).alias("rows"))
    if buckets <= 1 << 20:  # 16 bytes each
        offsets = F.broadcast(offsets)
    # a task has one bucket, so the permutation follows from the seed and the bucket's number alone
    mixed = arrays.join(offsets, "_bucket").select("first", F.shuffle("rows", F.lit(seed)).alias("rows"))
    out = mixed.select("first", F.posexplode("rows").alias("at", "_r")).withColumn("at", F.col("first") + F.col("at"))
    shard = F.expr(f"(at * {shards} + {shards} - 1) div {max(total, 1)}")
    start = F.expr(f"(shard * {total}) div {shards}")
    # the shard k with floor(k*total/shards) <= at < floor((k+1)*total/shards)
    out = out.withColumn("shard", F.least(shard, F.lit(shards - 1))).withColumn("shard", F.when(start > F.col("at"), F.col("shard") - 1).otherwise(F.col("shard")))
    out = out.withColumn("slot", F.col("at") - start).withColumn("shard", F.col("shard").cast("int"))
    out = back(out.select(*(F.col("_r")["_row"][x].alias(x) for x in df.columns), "slot", "shard"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def _numbered(record: DataFrame) -> DataFrame:
    """``record`` with ``_copy`` from 0 among equal rows: numbers within each input partition, plus those of the ones before it."""
    parts = written(record.withColumns({"_h": F.xxhash64("_row"), "_p": F.spark_partition_id()}), "equal-rows")
    counts = parts.groupBy("_h", "_p").agg(F.count("*").alias("n"))
    # a row for each partition that has the record
    first = counts.withColumn("_first", F.sum("n").over(Window.partitionBy("_h").orderBy("_p")) - F.col("n")).drop("n")
    inside = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_h", "_p").orderBy("_h")) - 1)
    return written(inside.join(first, ["_h", "_p"]).select("_row", (F.col("_first") + F.col("_at")).cast("long").alias("_copy")), "numbered")


def _bucket(seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "_row", "_copy"), F.lit(buckets)).cast("int")


def _sizes(record: DataFrame, text: str, seed: int, buckets: int) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col("_row")[text]), F.lit(0)).cast("long")
    return record.select(_bucket(seed, buckets).alias("_bucket"), size.alias("size")).groupBy("_bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def shard_rows(documents: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """The digest of a sharding of ``documents`` (doc_id, text): one row per record, from the shards as written."""
    out = external_shuffle(documents.select("doc_id", "text"), new_path(documents.sparkSession, "shards"), shards, seed)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
