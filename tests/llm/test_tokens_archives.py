"""Token cache, archives, pieces."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pantryline.llm import pieces, token_cache, warc
from pantryline.llm.common import new_path, written
from pantryline.llm.queries import PIECES, WORD_BPE
from tests.llm.fixtures import corpus, docs


def test_token_counts(spark):
    rows = corpus()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    cache = new_path(spark, "cache")
    df = docs(spark, rows).select("doc_id", "text", F.lit("x").alias("n_tokens"))
    got = token_cache.cached_counts(df, WORD_BPE, cache)
    assert got.columns == ["doc_id", "n_tokens"]
    want = sorted((r[0] is None, r[0] or 0, len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got.collect()) == want
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("content").distinct().count() == len({" ".join((r[1] or "").replace("\x0b", " ").split(" ")).strip() if False else hashlib.sha256(__import__("re").sub(r"[\x20\x09-\x0D]+", " ", r[1] or "").encode()).digest() for r in rows})
    # all known: nothing is encoded or appended
    again = token_cache.cached_counts(df, WORD_BPE, cache).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in again) == want
    assert spark.read.parquet(cache).count() == n
    more = docs(spark, [*rows, (900, "quite new words", "en", "s", 1), (901, "quite  new\twords", "en", "s", 1)])
    assert token_cache.cached_counts(more, WORD_BPE, cache).filter("doc_id >= 900").select("n_tokens").distinct().count() == 1
    assert spark.read.parquet(cache).count() == n + 1
    assert token_cache.cached_counts(df.limit(0), WORD_BPE, cache).count() == 0


def test_archives(spark, monkeypatch):
    big, small = "b" * 1000, "s" * 999
    huge = "héllo wörld\r\n\r\n" * 20_000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "u\r\nX: y", small), (5, "u", small), (6, "u", None), (7, "u", ""), (8, "u", huge), (8, "u", huge), (9, "u", huge), (9, "u", huge), (None, "u", big), (None, "u", "x" * 2000), (None, "u", "x" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).repartition(3)
    path = new_path(spark, "archives")
    files = written(warc.write_archives(warc.decide_records(pages), path), "files")
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    got = sorted((str(r[0]), *r[1:]) for r in warc.page_records(files, path).collect())
    top = {}
    for i, _, x in rows:
        x = (x or "").encode()
        if len(x) >= 1000:
            top[x] = max(top.get(x, -1), -1 if i is None else i)
    want = []
    for i, _, x in rows:
        x = (x or "").encode()
        winner = top.get(x, -1)
        revisit = winner != -1 and winner != i
        want.append((str(i), len(x), hashlib.sha1(x).hexdigest(), "revisit" if revisit else "response", winner if revisit else None))
    assert got == sorted(want)
    chunks = warc.read_chunks(files, path, chunk_bytes=1000).filter("page_id = 9").orderBy("chunk").collect()
    whole = huge.encode()
    one = [c for c in chunks if c["chunk"] == 3]
    assert len(one) == 2 and one[0]["sha1_so_far"] == hashlib.sha1(whole[:4000]).hexdigest() and one[0]["bytes_so_far"] == 4000
    assert max(len(c["data"]) for c in chunks) <= 1000
    body = {c["chunk"]: bytes(c["data"]) for c in chunks}
    assert b"".join(body[k] for k in sorted(body)) == whole
    assert sum(c["is_last"] for c in chunks) == 2
    assert warc.read_chunks(files, path).filter("is_last and record_type = 'response'").select("verified").distinct().collect() == [(True,)]
    monkeypatch.setattr(warc, "FEW", 0)
    by_shuffle = new_path(spark, "archives")
    again = written(warc.write_archives(warc.decide_records(pages), by_shuffle), "files")
    assert sorted((str(r[0]), *r[1:]) for r in warc.page_records(again, by_shuffle).collect()) == got
    none = written(warc.write_archives(warc.decide_records(pages.limit(0)), new_path(spark, "none")), "none")
    assert none.count() == 0


def brute(lattice: pieces.Lattice, text: str) -> list[float]:
    """Scores of all segmentations, best first."""
    edges = lattice.edges(text)
    scores = {0: [0.0]}
    for j in range(1, len(text) + 1):
        scores[j] = [s + x for i, _, x in edges[j] for s in scores[i]]
    return sorted(scores[len(text)], reverse=True)


def test_lattice_search_is_exact():
    lattice, rng = pieces.lattice(PIECES), random.Random(3)
    for _ in range(60):
        text = " " * rng.randrange(3) + "".join(rng.choice("theinaré日") for _ in range(rng.randrange(1, 9)))
        n = rng.choice([1, 3, 7])
        got = lattice.best(text, n)
        assert [s for s, _ in got] == brute(lattice, text)[:n]
        assert all(b"".join(lattice.bytes_of[i] for i in ids).decode() == text for _, ids in got)
        assert len({ids for _, ids in got}) == len(got)
        score, ids, loss = lattice.viterbi(text)
        two = brute(lattice, text)[:2]
        assert score == two[0] and loss == (two[0] - two[1] if len(two) > 1 else float("inf"))
        assert b"".join(lattice.bytes_of[i] for i in ids).decode() == text


def test_many_parts_at_once():
    lattice, rng = pieces.lattice(PIECES), random.Random(5)
    names = ["".join(rng.choice("theinarést日") for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["x" * 40, "日本語"]
    for name, (score, ids, loss) in zip(names, lattice.viterbi_of(names), strict=True):
        want = lattice.viterbi(name)
        assert (score, loss) == (want[0], want[2])
        numbers = [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]
        assert b"".join(lattice.bytes_of[i] for i in numbers).decode() == name


def test_texts_parts_combine_exactly():
    lattice, rng = pieces.lattice(PIECES), random.Random(4)
    for _ in range(30):
        text = " ".join("".join(rng.choice("thein\n") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4)))
        n = rng.choice([1, 2, 5])
        kept = pieces.Words(lattice, n)
        got = [s for s, _ in kept.segmentations(kept.add([text])[0])]
        assert got == brute(lattice, " " + text)[:n], text


def test_ids_of_the_best_are_segmentations_of_their_scores(spark):
    lattice, rng = pieces.lattice(PIECES), random.Random(6)
    texts = [" ".join("".join(rng.choice("theinaé\n") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 3))) for _ in range(40)] + ["", "日本 the"]

    def every(text):
        ways = {0: [(0.0, ())]}
        for j in range(1, len(text) + 1):
            ways[j] = [(s + x, (*p, *ids)) for i, ids, x in lattice.edges(text)[j] for s, p in ways[i]]
        return ways[len(text)]

    got = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES, 5, ids_of=5).collect()
    for r in got:
        ways = every(" " + texts[r["doc_id"]] if texts[r["doc_id"]] else "")
        score = {p: s for s, p in ways}
        assert [round(x, 6) for x in r["scores"]] == [round(s, 6) for s, _ in sorted(ways, key=lambda w: -w[0])[:5]]
        assert len({tuple(x) for x in r["ids"]}) == len(r["ids"]) == len(r["scores"])
        for ids, s, n, crc in zip(r["ids"], r["scores"], r["n_pieces"], r["ids_crc32"], strict=True):
            assert abs(score[tuple(ids)] - s) < 1e-6 and n == len(ids) and crc == zlib.crc32(pieces.packed(tuple(ids)))


def test_encode_and_decode(spark):
    rows = corpus()
    df = docs(spark, rows)
    got = pieces.encode(df, PIECES, 3, ids_of=2)
    back = pieces.decode(got.select("doc_id", F.explode("ids").alias("ids"), F.lit(0).alias("text")), PIECES).collect()
    want = {r[0]: r[1] or "" for r in rows}
    assert back and all(r["text"] == want[r["doc_id"]] for r in back)
    assert all(r["round_trip"] and list(r["scores"]) == sorted(r["scores"], reverse=True) for r in got.collect())
    assert got.count() == len(rows)
    empty = got.filter("doc_id is not null").join(df.filter("coalesce(text, '') = ''"), "doc_id").select("scores", "n_pieces").collect()
    assert all(list(r["scores"]) == [0.0] and list(r["n_pieces"]) == [0] for r in empty)
    assert pieces.encode(df.limit(0), PIECES).count() == 0


def test_pieces_never_hold_a_space_behind_a_letter():
    assert all(" " not in p.lstrip(" ") for p in pieces.lattice(PIECES).pieces)
    assert all(len(c) == 1 for c in itertools.islice(pieces.lattice(PIECES).pieces, 0, 0))


def test_counts_where_texts_meet_misses_by_a_shuffle(spark, monkeypatch):
    rows = corpus()
    df = docs(spark, rows)
    want = sorted((str(r[0]), r[-1]) for r in token_cache.cached_counts(df, WORD_BPE, new_path(spark, "c")).collect())
    for few in (0, 65):  # neither set is small; only that of the rows to leave
        monkeypatch.setattr(token_cache, "FEW", few)
        clash = df.withColumns({x: F.lit("clash") for x in ("content", "_content", "_key", "_a", "_row", "tokenizer", "n_tokens")})
        got = token_cache.cached_counts(clash, WORD_BPE, new_path(spark, "c"))
        assert got.columns == ["doc_id", "lang", "source", "n_chars", "content", "_content", "_key", "_a", "_row", "tokenizer", "n_tokens"]
        assert sorted((str(r[0]), r[-1]) for r in got.collect()) == want and got.filter("content = 'clash'").count() == len(rows)


def test_archives_of_others(spark, tmp_path):
    import gzip

    def record(head, block):
        lines = ["WARC/1.0", *head, f"content-length: {len(block)}"]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    page, sha1 = b"<p>x</p>" * 50, hashlib.sha1(b"<p>x</p>" * 50).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    body = record(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:1>"], b"software: x\r\n\r\nmore")
    body += record(["warc-type: request", "warc-record-id: <urn:2>", "content-type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n")
    body += record(["WARC-TYPE: response", "WARC-Record-ID: <urn:3>", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Target-URI: http://a/?q=1:2"], http + page)
    body += record(["WARC-Type: response", "WARC-Record-ID: <urn:4>", "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + "A" * 32], http + page)
    body += record(["WARC-Type: resource", "WARC-Record-ID: <urn:5>", "WARC-Payload-Digest: md5:00"], b"")
    (tmp_path / "o.warc.gz").write_bytes(body)
    files = spark.createDataFrame([(str(tmp_path / "o.warc.gz"),)], "path string")
    got = {r["record_id"]: r for r in warc.read_chunks(files, str(tmp_path), chunk_bytes=64).filter("is_last").collect()}
    assert [got[f"<urn:{i}>"]["bytes_so_far"] for i in range(1, 6)] == [19, 0, 400, 400, 0]
    assert [got[f"<urn:{i}>"]["verified"] for i in range(1, 6)] == [None, None, True, False, None]
    assert got["<urn:3>"]["url"] == "http://a/?q=1:2" and got["<urn:3>"]["page_id"] is None and got["<urn:3>"]["chunk"] == 6
    with pytest.raises(Exception, match="damaged payload"):
        warc.page_records(files, str(tmp_path)).collect()
