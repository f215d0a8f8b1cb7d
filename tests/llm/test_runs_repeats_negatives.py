"""Periodic runs, repeated strings and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pantryline.llm import negatives, periods, queries, suffixes
from tests.llm.fixtures import corpus, docs, words


def slow_runs(s, least, repeats):
    """All runs by comparing each period's places."""
    found = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i >= q and not any(a <= i and i + n >= j + q - i + i and a + n >= j + q and b < q for a, n, b in found):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(r for r in found if r[1] >= least and r[1] >= repeats * r[2])


def test_runs_of_sequences():
    rng = random.Random(4)
    for _ in range(600):
        s = [rng.randrange(1, rng.choice([2, 3, 3, 5])) for _ in range(rng.randrange(60))]
        if s and rng.random() < 0.5:
            p = rng.randrange(1, len(s) + 1)
            s = [s[i % p] for i in range(len(s))]
        assert sorted(map(tuple, periods.runs_of(s).tolist())) == slow_runs(s, 2, 2)
        for least, repeats in ((24, 3), (5, 2), (9, 4)):
            assert sorted(periods.text_runs([b"%d" % x for x in s], least, repeats)) == slow_runs(s, least, repeats)


def periodic_texts():
    rng = random.Random(8)
    rows = [(d, t and t[:2000], *r) for d, t, *r in corpus(3, 40)]
    for i in range(60):
        ws = words(rng, rng.randrange(1, 90), 400).split()
        p = rng.randrange(1, 40)
        text = words(rng, rng.randrange(0, 30), 4).split() + [ws[k % min(p, len(ws))] for k in range(rng.randrange(1, 150))]
        rows.append((1000 + i, rng.choice([" ", "\n", " \t"]).join(text), "en", "s", 0))
    return rows


def test_suffix_tree_query(spark, tmp_path):
    docs(spark, periodic_texts()).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_suffix_trees(spark, str(tmp_path)).collect()]
    want, some = [], 0
    for doc, text, *_ in periodic_texts():
        ws = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        g, n = h // 10, len(ws)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        runs = slow_runs(ws, 24, 3)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        some += bool(runs)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()), sha(b" ".join(w for i, w in enumerate(ws) if i not in gone))))
    assert some > 20 and sorted(map(str, got)) == sorted(map(str, want))


def slow_repeats(texts, length):
    """(bytes removed, kept) of each text."""
    every = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in every for i in range(len(b) - length + 1))
    out = []
    for b in every:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((gone, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def repeating_texts():
    rng = random.Random(6)
    passages = [words(rng, 60, 5000) for _ in range(4)] + ["a" * 450, "ab" * 170, "日本語テキスト" * 40]
    rows = [(d, t and t[:9000], *r) for d, t, *r in corpus(5, 30)]
    for i in range(120):
        text = words(rng, rng.randrange(0, 90), 5000)
        for p in rng.sample(passages, rng.randrange(0, 3)):
            k = rng.randrange(0, 80)
            text += " " + p[k : k + rng.choice([198, 199, 200, 201, 260, 900])] + words(rng, rng.randrange(1, 30), 5000)
        rows.append((2000 + i, text, "en", "s", 0))
    return rows


@pytest.mark.parametrize("kinds", [suffixes.KINDS, 2])
@pytest.mark.parametrize("length", [200, 37])
def test_repeated_strings(spark, length, kinds):
    rows = repeating_texts()
    got = suffixes.without_repeats(docs(spark, rows).select("doc_id", "text", F.lit("mine").alias("unit"), F.lit(1).alias("KEPT")), "text", length, kinds)
    assert got.columns == ["doc_id", "unit", "n_bytes", "n_removed", "spans", "kept"]
    want = []
    for (doc, text, *_), (gone, kept) in zip(rows, slow_repeats([r[1] for r in rows], length), strict=True):
        spans = [i for i in range(len(gone) + 1) if (i < len(gone) and gone[i]) != (i > 0 and gone[i - 1])]
        want.append((doc, len((text or "").encode()), sum(gone), list(zip(spans[::2], spans[1::2], strict=True)), kept))
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got.collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert sum(r[2] for r in want) > 1000


def test_long_texts_and_parts(spark, monkeypatch):
    """Blocks and flushes of any size give the same."""
    rng = random.Random(2)
    shared = words(rng, 500, 9000)
    rows = [(i, words(rng, 300, 9000) + shared[i * 7 :] + words(rng, 900, 9000), "en", "s", 0) for i in range(4)]
    want = [(len(g), sum(g)) for g, _ in slow_repeats([r[1] for r in rows], 200)]
    data = suffixes.bytes_of(pa.array([r[1] for r in rows]))
    assert len(list(suffixes.pieces_of(*data, 200))) == 1
    monkeypatch.setattr(suffixes, "PLACE", 11)
    monkeypatch.setattr(suffixes, "BLOCK", 100)
    assert len(list(suffixes.pieces_of(*data, 200))) > 10
    got = suffixes.without_repeats(docs(spark, rows).select("doc_id", "text")).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == sorted(want)


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(200):
        pieces = [bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randrange(12, 40))) for _ in range(rng.randrange(1, 6))]
        sizes = [len(x) - 11 for x in pieces]
        got = suffixes.repeated_starts(pieces, sizes, [1] * len(pieces), 12)
        n = Counter(x[i : i + 12] for x, m in zip(pieces, sizes, strict=True) for i in range(m))
        assert [list(x) for x in got] == [[n[x[i : i + 12]] > 1 for i in range(m)] for x, m in zip(pieces, sizes, strict=True)]


def test_empty_tables(spark):
    none = docs(spark, corpus(1, 10)).limit(0)
    assert periods.periodic_runs(none).count() == 0 and suffixes.without_repeats(none).count() == 0
    rows = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(negatives.usable(rows, "vec_id", F.col("label"), "embedding", 256), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(none, repeats=1)


def vectors(rng, n, scale=1.0):
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.randrange(4), [rng.gauss(0, scale) for _ in range(6)]) for i in range(n)]
    rows += [(n + i, 1, list(rows[3][2])) for i in range(40)] + [rows[5], rows[5]]
    odd = [None, [], [nan] * 6, [0.1, None, 0.0, 0.0, 0.0, 0.0], [inf] * 6, [0.0] * 6, [0.3, 0.2], [scale] * 8]
    return rows + [(1000 + 10 * i, 2, x) for i, x in enumerate(odd)] + [(2000, None, [0.1] * 6), (None, 1, [0.1] * 6)]


def slow_negatives(rows, every, n_positives, n_negatives, low, high):
    import math

    good, seen = [], set()
    for i, label, x in rows:
        if i is None or label is None or x is None or any(y is None or not math.isfinite(y) for y in x):
            continue
        r = (i, label, tuple(math.floor(y * 256) for y in x))
        if r not in seen:
            seen.add(r)
            good.append(r)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in good:
        if a[0] % every:
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b[1]) for b in good if b[0] != a[0]))
        for p in [s for s in scored if s[2] == a[1]][:n_positives]:
            fit = [s for s in scored if s[2] != a[1] and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:n_negatives]
            out += [(a[0], p[1], k, s[1], -p[0], -s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize(("scale", "clusters", "members"), [(1.0, 4, 256), (1.0, 3, 2), (0.004, 1, 7), (2e5, 4, 256)])
def test_hard_negatives(spark, monkeypatch, scale, clusters, members):
    monkeypatch.setattr(negatives, "BLOCK", 50)
    rows = vectors(random.Random(7), 300, scale)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    used = negatives.usable(df, "vec_id", F.col("label"), "embedding", 256)
    got = negatives.hard_negatives(used, F.col("vec_id") % 10 == 0, 5, 10, 30, 90, clusters, members)
    assert sorted(map(tuple, got.collect())) == slow_negatives(rows, 10, 5, 10, 30, 90)


def test_walks_stop_early(spark, tmp_path):
    """Members that lie close stop long before the end of their list."""
    rng = random.Random(1)
    rows = [(i, i % 2, [100.0 * (i % 5 == 0) + rng.random(), rng.random(), 50.0 * (i % 5 != 0)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives.hard_negatives(negatives.usable(df, "vec_id", F.col("label"), "embedding", 1), F.col("vec_id") % 500 == 0, 3, 3, 10, 99)
    assert sorted(map(tuple, got.collect())) == slow_negatives([(i, y, [v / 256 for v in map(int, x)]) for i, y, x in rows], 500, 3, 3, 10, 99)
