"""URL verdicts and shards."""

from __future__ import annotations

import time
import zlib

import pytest
from pyspark.sql import functions as F

from pantryline.llm import sharding, url_filter
from pantryline.llm.common import new_path
from pantryline.llm.queries import RULES
from tests.llm.fixtures import corpus, docs


@pytest.mark.parametrize("max_words", [1 << 20, 1])
def test_cascade_is_exact(spark, max_words):
    rows = [(f"k{i}", i % 7 == 0) for i in range(40_000)] + [("k0", False), (None, True), ("k1", None)]
    universe = spark.createDataFrame(rows, "key string, listed boolean")
    levels = url_filter.build_cascade(universe, bits_per_key=2.0, max_words=max_words)
    assert len(levels) > 2
    got = {r["key"]: r["found"] for r in url_filter.is_listed(universe.distinct(), F.col("key"), levels, "found").collect()}
    want = {}
    for k, v in rows:
        want[k or ""] = want.get(k or "", False) or bool(v)
    assert {k or "": v for k, v in got.items()} == want
    named = universe.limit(5).withColumns({x: F.lit(x) for x in ("_key", "_p1", "__pass_at", "found", "block", "words")})
    assert url_filter.is_listed(named, F.col("key"), levels, "found").columns == ["key", "listed", "_key", "_p1", "__pass_at", "block", "words", "found"]


def test_judge_urls(spark):
    urls = ["http://Blog.Example.org/es/1", "https://example.org/en/12?x", "http://a.org", "http://a.org/", "http://x.com/de/1", "http://x.com/fr/", "http://notexample.org/es/", "no scheme", None, "", "http://y.net/p?utm_source=a", "http://y.net/p#z", "http://com/de/", "ftp://h?/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, F.col("url").contains("utm_source="), RULES).collect()}
    assert got[0] == ("blog.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("a.org", "", None, "allow")
    assert got[3] == ("a.org", "/", "org/", "allow")
    assert got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow") and got[12][2:] == ("com/de/", "block")
    assert got[6][2:] == ("org/", "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10] == got[11] == ("y.net", "/p", None, "block")
    assert got[13][:2] == ("h", "")
    assert url_filter.judge_urls(pages.limit(0), F.lit(True), RULES).count() == 0
    # many rules meet the urls in a join
    many = [*RULES, *(("block", f"h{i}.test/") for i in range(url_filter.IN_PLAN)), ("allow", "a.org")]
    joined = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, F.col("url").contains("utm_source="), many).collect()}
    assert joined == got | {2: ("a.org", "", "a.org", "allow"), 3: ("a.org", "/", "a.org", "allow")}
    some = url_filter.judge_urls(pages, F.lit(False), [*RULES, ("allow", "a.org")]).filter("page_id in (2, 3)").select("rule").distinct().collect()
    assert some == [("a.org",)]


@pytest.mark.parametrize("n", [0, 5, 50, 200, 201, 1000, 5000])
def test_any_number_of_rules(spark, n):
    """Rules of all lengths, in the plan and in a table, against a loop; the plan does not grow faster than the list."""
    rules = [(("allow", "block")[i % 2], f"h{i % 17}.{'x.' * (i % 3)}net/{'p' * (i % 11)}{i // 40 or ''}") for i in range(n)]
    rows = [(i, f"{'sub.' * (i % 2)}h{i % 19}.{'x.' * (i % 4)}net", f"/{'p' * (i % 13)}{i % 130}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, host string, path string")
    out = url_filter.with_rules(df, rules)
    began = time.time()
    got = {r["id"]: r["_rule"] and tuple(r["_rule"]) for r in out.select("id", "_rule").collect()}
    assert time.time() - began < 20 and len(out._jdf.queryExecution().optimizedPlan().toString()) < 2000 + 200 * min(n, 200)
    for i, host, path in rows:
        best = None
        for verdict, rule in rules:
            end, slash, rest = rule.partition("/")
            if (host == end or host.endswith("." + end)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        assert got[i] == best


def check_shards(rows, got, n):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(by.get(k, [])) for k in range(n)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(n))


def test_shards(spark):
    rows = corpus()
    df = docs(spark, rows)
    got = sharding.shard_rows(df).collect()
    check_shards(rows, got, 8)
    again = sharding.shard_rows(df).collect()
    place = lambda x: sorted((r["doc_id"] or -1, r["shard"], r["slot"]) for r in x)
    assert place(got) == place(again)
    assert place(got) != place(sharding.shard_rows(df, seed=7).collect())
    assert sharding.shard_rows(df.limit(0)).count() == 0
    check_shards(rows[:3], sharding.shard_rows(docs(spark, rows[:3])).collect(), 8)


def test_shards_of_equal_records(spark):
    rows = [(1, "same text", "en", "s", 9)] * 400 + corpus(2, 20)
    out = sharding.external_shuffle(docs(spark, rows), new_path(spark, "t"), 8, 3, bucket_bytes=200, least_buckets=4)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    got = out.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard", "slot").collect()
    check_shards(rows, got, 8)
    other = sharding.external_shuffle(docs(spark, rows).repartition(7, "text"), new_path(spark, "t"), 8, 3, bucket_bytes=200, least_buckets=4)
    order = lambda x: sorted((r["shard"], r["slot"], str(r["doc_id"]), r["text"] or "") for r in x.collect())
    assert order(other) == order(out)  # however rows are dealt to tasks
    clash = docs(spark, rows).withColumns({x: F.lit(x) for x in ("Slot", "_bucket", "_row", "_salt", "rows", "at", "first")})
    named = sharding.external_shuffle(clash, new_path(spark, "t"))
    assert named.columns == ["doc_id", "text", "lang", "source", "n_chars", "_bucket", "_row", "_salt", "rows", "at", "first", "slot", "shard"]
    assert named.filter("first = 'first' and rows = 'rows'").count() == len(rows) and named.agg(F.max("slot")).first()[0] < len(rows)
