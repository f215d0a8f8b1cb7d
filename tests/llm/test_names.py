"""Columns of every name that an operator uses inside stay as they are, and change no result."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pantryline.llm import decontamination, fertility, ngram, periods, pieces, queries, sharding, simhash, suffixes, token_cache, toxicity, url_filter, warc
from pantryline.llm.common import fold, new_path
from tests.llm.fixtures import corpus, docs, words

NAMES = """_id _text _train _out _part dest unit kind level part check ids p0 p1 p2 p3 cell bucket k w s1 _row _content _key _a _b content
tokenizer n_tokens n_words word_chars n_symbols n_dup_lines n_repeat_words n_pieces n_byte_pieces n_byte_tokens entropy entropy_rate
byte_share chars_per_piece chars_per_byte_token byte_share_low byte_share_high _lang length_class _class _near _language _every _n
base_failed kept score _score _y x y f node fp keys root leader _first _m _own start a b m most h component_id _node _r _c0 _c1 _copy
_bucket _h _p _at rows at first shard slot bytes n sha1 n_bytes payload winner host path rule verdict _rule _listed _block _p1
_pass listed key _end _from item_id first_word distance similarity round_trip scores ids_crc32 _salt label toxic quality Doc_Ids runs collapsed spans n_removed size starts piece crowded""".split()


@pytest.fixture(scope="module")
def tables(spark):
    """Documents plain and with all the names; labels; items."""
    rng = random.Random(21)
    item = words(rng, 40, 3000)
    rows = [*corpus(), *((500 + i, words(rng, 120, 3000), "en", "s", 0) for i in range(40)), (600, item + " " + words(rng, 60, 3000), "en", "s", 0)]
    plain = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    return plain, plain.withColumns({x: F.lit(f"mine {x}") for x in NAMES}), labels, spark.createDataFrame([(1, item)], "item_id long, text string")


def mine(df, names=NAMES):
    """Rows with a named column changed."""
    return df.filter(~F.forall(F.array(*(F.col(x) == f"mine {x}" for x in names)), lambda ok: F.coalesce(ok, F.lit(False)))).count()


def key(r):
    return str(r)


def run(name, df, labels, items, spark):
    """(result, columns that it adds)."""
    fertile = (*fertility.LONGS, "entropy", *fertility.JUDGED)
    if name == "measure":
        return fertility.measure(df, queries.vocabularies()), fertile[:9]
    if name == "quality":
        return fertility.quality(df, queries.vocabularies()), fertile
    if name == "toxicity":
        return toxicity.score(df, toxicity.train(df, labels, F.lit(True))), ("score",)
    if name == "counts":
        return token_cache.cached_counts(df, queries.WORD_BPE, new_path(spark, "c")), ("n_tokens",)
    if name == "shuffle":
        return sharding.external_shuffle(df.select("doc_id", "text", *NAMES) if "_row" in df.columns else df.select("doc_id", "text"), new_path(spark, "s")), ("slot", "shard")
    if name == "copies":
        return simhash.one_of_each(df), ()
    if name == "leaks":
        return decontamination.without_leaks(df, items), ()
    if name == "runs":
        return periods.periodic_runs(df, least_words=6, repeats=2), ("n_words", "runs", "collapsed")
    if name == "repeats":
        return suffixes.without_repeats(df, length=60), ("n_bytes", "n_removed", "spans", "kept")
    if name == "decode":
        return pieces.decode(df.withColumn("numbers", F.array(F.lit(300))), queries.PIECES, "numbers", "score"), ("score",)
    if name == "listed":
        universe = df.select(F.col("source").alias("key"), F.lit(True).alias("listed"))
        return url_filter.is_listed(df, F.col("source"), url_filter.build_cascade(universe), "verdict"), ("verdict",)
    raise KeyError(name)


@pytest.mark.parametrize("name", ["measure", "quality", "toxicity", "counts", "shuffle", "copies", "leaks", "runs", "repeats", "decode", "listed"])
def test_operators_that_return_the_rows(spark, tables, name):
    plain, named, labels, items = tables
    want, added = run(name, plain, labels, items, spark)
    got, _ = run(name, named, labels, items, spark)
    kept = [x for x in NAMES if x not in added]
    assert got.columns == [x for x in got.columns if x not in added] + list(added) and set(kept) <= set(got.columns)
    assert mine(got, kept) == 0
    if name == "shuffle":  # other columns are part of a record, so the order is another
        assert got.count() == want.count()
        return
    shown = ["doc_id", *([] if name in ("counts", "repeats") else ["text"]), *added]
    assert sorted(map(key, got.select(*shown).collect())) == sorted(map(key, want.select(*shown).collect()))


def digest(name, df, items, spark):
    """Of operators that return rows of their own."""
    flags = fold(F.col("doc_id")) != 1, fold(F.col("doc_id")) == 2
    if name == "ngram":
        return ngram.interpolated_scores(df, *flags, unit_bytes=4000).withColumn("score", F.round("score", 6)).withColumn("base_score", F.round("base_score", 6))
    if name == "near":
        return simhash.near_copies(df)
    if name == "found":
        return decontamination.leaks(df, items)
    if name == "pieces":
        return pieces.encode(df, queries.PIECES, 2)
    pages = df.withColumns({"page_id": F.col("doc_id"), "url": F.concat(F.lit("http://a.org/"), F.col("doc_id").cast("string")), "html": F.col("text")})
    if name == "urls":
        return url_filter.judge_urls(pages, F.col("page_id") % 2 == 0, queries.RULES)
    return warc.decide_records(pages)


@pytest.mark.parametrize("name", ["ngram", "near", "found", "pieces", "urls", "warc"])
def test_operators_that_return_their_own(spark, tables, name):
    plain, named, _, items = tables
    want, got = (sorted(map(key, digest(name, df, items, spark).collect())) for df in (plain, named))
    assert got == want


@pytest.mark.parametrize("number", range(4))
def test_stages(spark, tables, number, tmp_path):
    import corpus_pipeline

    plain, named, labels, items = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[number][1]
    got, want = stage(spark, named, str(tmp_path)), stage(spark, plain, str(tmp_path))
    assert got.columns == named.columns and want.columns == plain.columns and mine(got) == 0
    assert sorted(map(key, got.select(plain.columns).collect())) == sorted(map(key, want.collect()))
