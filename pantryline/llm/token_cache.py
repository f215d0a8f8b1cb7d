"""Token counts with a digest cache.

The cache is a Parquet table (content, tokenizer, n_tokens): the SHA-256 of a text with each run of ASCII white space
as one space, the SHA-256 of the vocabulary file, and the count. ``cached_counts`` digests each text once, into thin
rows, takes those digests that the cache lacks for this tokenizer, encodes one text for each and appends the counts; then
every row gets its count by its digest. Where all digests are stored, no text is read again. The white-space form counts alike
because the vocabulary drops white space and no token spans it; for another kind of vocabulary pass ``normalise=None``, and
the text itself is digested.

Nulls: a null text counts as empty, with no tokens; a null id stays null. A long text is encoded whole. Equal texts are encoded
once, whatever their ids (of equals the row with the least id as text); repeated rows stay. Other columns come back as they
are, whatever their names; one called n_tokens gives way to the count. An empty table appends nothing and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantryline.llm.common import apart, text_batches, written

CACHE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])
#: Words, and bytes of them, whose counts a worker keeps; then it starts anew.
KEPT_WORDS, KEPT_BYTES = 400_000, 24 << 20


def single_spaced(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


@cache
def file_digest(path: str) -> str:
    """SHA-256 of a vocabulary file: the tokenizer's version."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@cache
def word_counter(path: str) -> Callable[[list[bytes]], list[int]]:
    """Counts of texts by a ``tokenizers`` file, through the counts of their words, which a worker keeps.

    White space ends every token of such a file (it is dropped before the merges), so a text's count is the sum of
    its words' counts.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, known = Tokenizer.from_file(path), {}

    def count(texts: list[bytes]) -> list[int]:
        if len(known) > KEPT_WORDS or sum(map(len, known)) > KEPT_BYTES:
            known.clear()
        split = [x.split() for x in texts]  # of bytes: ASCII white space alone
        if new := list({w for x in split for w in x if w not in known}):
            known.update(zip(new, (len(e) for e in tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)), strict=True))
        return [sum(map(known.__getitem__, x)) for x in split]

    return count


#: Of so many ids at most a set is broadcast (some 8 MB).
FEW = 100_000
ROW = ("_key", "_a", "_b")


def _row(key: str, text: str) -> list[Column]:
    """What tells a row with its text: the id and 128 bits of hashes."""
    return [F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_key"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b")]


def cached_counts(docs: DataFrame, vocabulary: str, cache_path: str, text: str = "text", key: str = "doc_id", normalise: Callable[[Column], Column] | None = single_spaced) -> DataFrame:
    """``docs`` with n_tokens (long) in place of its text; the counts of new texts are appended to ``cache_path``.

    ``vocabulary``: a ``tokenizers`` file whose pre-tokenizer drops white space, at one path on every machine.
    """
    spark, version = docs.sparkSession, file_digest(vocabulary)
    plain, back = apart(docs, text, key, own=("n_tokens",))

    def stored() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(cache_path)
    full = plain.withColumn(text, F.coalesce(text, F.lit("")))
    content = F.unhex(F.sha2((normalise(F.col(text)) if normalise else F.col(text)).cast("binary"), 256)).alias("_content")
    # the one pass that digests; what follows joins thin rows by digest
    thin = written(full.select("*", content, *_row(key, text)).drop(text), "digests")
    firsts = thin.groupBy("_content").agg(F.min(F.struct(*ROW)).alias("_row")).join(stored(), F.col("_content") == F.col("content"), "left_anti")
    misses = written(firsts.select("_content", "_row.*"), "misses")
    if (n := misses.count()):
        texts = full.select(*_row(key, text), F.col(text).cast("binary").alias("_text"))
        # one row stands for each missing digest: its text is encoded where it is scanned if the set of rows to take, or that of
        # rows to leave, is small; else texts meet the set by a shuffle
        if n <= FEW:
            taken = texts.join(F.broadcast(misses.select(*ROW)), list(ROW), "left_semi")
        else:
            rest = thin.select(*ROW).join(misses.select(*ROW), list(ROW), "left_anti").distinct().limit(FEW + 1)
            rest = written(rest, "leave")
            taken = texts.join(F.broadcast(rest), list(ROW), "left_anti") if rest.count() <= FEW else texts.join(misses.select(*ROW), list(ROW), "left_semi")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = word_counter(vocabulary)
            for batch in text_batches(batches, "_text", 4 << 20):
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(count(batch.column(3).to_pylist()), pa.int64())], names=[*ROW, "n_tokens"])

        counted = taken.mapInArrow(encode, "_key string, _a long, _b long, n_tokens long").groupBy(*ROW).agg(F.max("n_tokens").alias("n_tokens"))
        new = counted.join(misses, list(ROW)).select(F.col("_content").alias("content"), F.lit(version).alias("tokenizer"), "n_tokens")
        new.write.mode("append").parquet(cache_path)
    # as a table of its own, so that a join whose one content has many rows can be split
    found = thin.join(written(stored(), "counts"), F.col("_content") == F.col("content"), "left")
    return back(found)
