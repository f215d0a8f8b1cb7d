"""The registered queries of the operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryline.llm import decontamination, fertility, negatives, ngram, periods, pieces, sharding, simhash, suffixes, token_cache, toxicity, url_filter, warc
from pantryline.llm.common import WORD, fold, new_path, written

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabularies() -> fertility.Vocabularies:
    """The two vocabularies of the quality rules."""
    return fertility.Vocabularies(PIECES, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by trigrams; fold 1 teaches nothing, and fold 2 is deleted from the counts to learn the weights."""
    docs, of = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"))
    scores = ngram.interpolated_scores(docs, of != 1, of == 2)
    return scores.select("doc_id", (of == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the base rules and the fertility bands of its language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = written(fertility.measure(docs, vocabularies()).drop("text"), "measured")
    judged = fertility.judge(measured, written(fertility.bands(measured), "bands"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *base, "base_failed", "kept", "chars_per_piece", "chars_per_byte_token", "byte_share", "entropy")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from labels of ids outside fold 0."""
    return toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).drop("text")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page to WARC archives and back through the chunked record table."""
    path = new_path(spark, "archives")
    files = written(warc.write_archives(warc.decide_records(table(spark, sf_dir, "pages")), path), "archive-files")
    return warc.page_records(files.repartition(max(1, files.count())), path)


def op5_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document."""
    best = pieces.encode(table(spark, sf_dir, "documents"), PIECES, 4, ids_of=0)
    each = best.select("doc_id", "round_trip", F.posexplode(F.arrays_zip("scores", "n_pieces", "ids_crc32")).alias("at", "one"))
    return each.select("doc_id", (F.col("at") + 1).alias("rank"), F.col("one.scores").alias("score"), "one.n_pieces", "one.ids_crc32", "round_trip")


def op6_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each benchmark item that it holds."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a cache that starts empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counts = token_cache.cached_counts(docs, WORD_BPE, new_path(spark, "token-counts"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op8_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies among all documents: shingles of four words, 64 bits, at most four of them different."""
    found = written(simhash.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, simhash.Ring(1, 4, 5)), "near-copies")
    number = F.concat(*(F.substring("fp", i, 1) for i in range(8, 0, -1)))  # the bytes are little-endian
    return found.select("doc_id", F.lower(F.hex(number)).alias("fingerprint"), "component_id")


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into eight shuffled shards."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; listed are the keys of pages that came with a tracking parameter."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), F.col("url").contains("utm_source="), RULES)


def op11_clustered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; where an id is divisible by 7 the label is the next one."""
    df = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.usable(df, "vec_id", label, "embedding", 256)
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, n_positives=5, n_negatives=10, low=30, high=90)


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents all words from some place on repeat those that come first there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", "text", h.alias("h"), words.alias("w"))
    rows = rows.withColumns({"n": F.size("w").cast("long"), "g": F.floor(F.col("h") / 10)})
    rows = rows.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.flatten(F.array_repeat(F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.expr("cast((n - a) div p + 1 as int)")))
    periodic = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again), F.lit(1), F.col("n").cast("int"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def op12_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of which is made periodic, and digests of the runs and of what they leave."""
    found = periods.periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    first = F.aggregate(
        "runs",
        F.col("runs")[0],
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    one = F.when(F.size("runs") > 0, first)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        one["start"].alias("start"),
        one["length"].alias("length"),
        one["period"].alias("period"),
        F.floor(one["length"] * 1000 / one["period"]).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that start elsewhere too."""
    found = suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), listed AS (
  SELECT DISTINCT host || path AS key FROM h WHERE url LIKE '%utm_source=%'
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM h
)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN r.rule IN ('org/', 'com/fr/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block' WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN listed l ON l.key = r.host || r.path
"""

OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
w AS (SELECT payload_digest, payload_bytes, max(page_id) AS winner FROM d WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN w.winner IS NOT NULL AND w.winner IS DISTINCT FROM d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN w.winner IS DISTINCT FROM d.page_id THEN w.winner END AS refers_to
FROM d LEFT JOIN w USING (payload_digest, payload_bytes)
"""

OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS mine, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = mine QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> mine AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_deleted_interpolation, op2_fertility, op3_warc_chunks, op4_toxicity, op5_nbest_pieces, op6_simhash_windows, op7_token_counts, op8_pigeonring, op9_external_shuffle, op10_url_cascade, op11_clustered_lists, op12_suffix_trees, op13_two_stage)}
SQL: dict[str, str] = {"op3_warc_chunks": OP3_SQL, "op10_url_cascade": OP10_SQL, "op11_clustered_lists": OP11_SQL}
