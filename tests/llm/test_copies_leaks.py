"""Near copies and benchmark leaks, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pantryline.llm import decontamination, simhash
from tests.llm.fixtures import corpus, docs, words


def fingerprint(text: str | None, k: int = 4) -> int:
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: dict[int, list[int]], radius: int) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and any((a ^ b).bit_count() <= radius for a in prints[i] for b in prints[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [4096, 3])
def test_classes_are_exact(spark, block):
    rng, rows = random.Random(5), corpus()
    base = words(rng, 150)
    for i in range(40):  # a family, each one word away from the one before
        w = base.split()
        w[rng.randrange(len(w))] = f"x{i}"
        base = " ".join(w)
        rows.append((1000 + i, base, "en", "s", 0))
    rows.append((1005, "another text of the same id " + base, "en", "s", 0))
    got = simhash.near_copies(docs(spark, rows), 4, simhash.Ring(1, 4, 5), block).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        assert len(r["fp"]) == 8
    for r in rows:
        if r[0] is not None:
            prints.setdefault(r[0], []).append(fingerprint(r[1]))
    have = {(r["doc_id"], int.from_bytes(r["fp"], "little")) for r in got}
    assert have == {(r[0], fingerprint(r[1])) for r in rows}
    want = components(prints, 4)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), *want.items()}


def test_every_link_shares_a_key_and_passes_its_chain():
    rng, ring = random.Random(6), simhash.Ring(1, 4, 5)
    keys = ring.keys()
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        x = np.array([a ^ b], np.uint64)
        met = [i for i, mask in keys if not (x & mask).any()]
        assert any(all(np.bitwise_count(x & m).sum() <= most for m, most in ring.chains(i)) for i in met)


def test_every_pair_within_the_radius_has_a_chain():
    rng, ring = np.random.default_rng(6), simhash.Ring(words=4, radius=80, segments=8)
    x = np.zeros((4000, 256), np.uint8)
    for row in x:
        row[rng.choice(256, rng.integers(40, 140), replace=False)] = 1
    x = np.packbits(x, axis=1, bitorder="little").view(np.uint64)
    bits, chained = np.bitwise_count(x).sum(1), ring.chained(x)
    assert chained[bits <= 80].all() and (~chained)[bits > 110].mean() > 0.9
    for row, found in zip(x[:300], chained[:300], strict=True):
        n = [int(np.bitwise_count(row & ring.mask(32 * i, 32 * i + 32)).sum()) for i in range(8)] * 2
        assert found == any(all(sum(n[i : i + k]) * 8 <= k * 80 for k in range(1, 9)) for i in range(8))


def test_ids_as_text_and_repeated_ids(spark):
    rng = random.Random(15)
    base = [words(rng, 300, 3000) for _ in range(6)]
    near = lambda x: x.replace(" ", " zz ", 1)
    rows = [("a", base[0]), ("a", base[1]), ("b", near(base[1])), ("c", base[2]), ("c", base[2]), ("c", near(base[2])), ("d", base[3]), (None, base[3]), ("e", near(base[3])), ("f", base[4])]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({x: F.lit(x) for x in ("node", "fp", "_first", "leader", "_node", "_n", "K")})
    got = simhash.one_of_each(df)
    assert got.columns == df.columns and got.filter("fp = 'fp' and leader = 'leader' and k = 'K'").count() == got.count()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect() if r["doc_id"] != "c") == sorted([("a", base[0]), ("a", base[1]), ("d", base[3]), ("None", base[3]), ("f", base[4])])
    assert [r["text"] for r in got.filter("doc_id = 'c'").collect()][0] in (base[2], near(base[2])) and got.filter("doc_id = 'c'").count() == 1
    again = simhash.one_of_each(df.repartition(5, "text")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.collect()))
    named = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(df).collect()}
    assert {i for i, _ in named} == {"a", "b", "c", "d", "e", "f", None} and (None, None) in named


def test_near_copies_go(spark):
    rng = random.Random(7)
    base = [words(rng, 400, 3000) for _ in range(12)]
    rows = [(i, x, "en", "s", 0) for i, x in enumerate(base)]
    copies = []
    for i, x in enumerate(base):
        w = x.split()
        w[20], w[200] = "changed", "words"
        copies.append((100 + i, " ".join(w), "de", "t", 0))
    odd = [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (502, "short", "en", "s", 0), (502, "short", "en", "s", 0), (None, "no id", "en", "s", 0), (None, "no id", "en", "s", 0)]
    got = simhash.one_of_each(docs(spark, [*rows, *copies, *odd]))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got.collect()) == [-1, -1, *range(12), 500, 502]
    assert simhash.one_of_each(docs(spark, rows).limit(0)).count() == 0


def shingle_counts(w: list[str]) -> Counter:
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute_leaks(rows, items, least):
    out = {}
    for d, text, *_ in rows:
        w = decontamination.TOKEN.findall((text or "").lower())
        for i, item in items:
            v = decontamination.TOKEN.findall((item or "").lower())
            n = min(len(w), len(v))
            if not n:
                continue
            y = shingle_counts(v)
            best = 0.0
            for s in range(len(w) - n + 1):
                x = shingle_counts(w[s : s + n])
                best = max(best, (x & y).total() / (x | y).total())
            if best >= least:
                out[d, i] = best
    return out


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.randrange(12, 60), 500)) for i in range(12)] + [(20, "Tiny item"), (21, "word"), (22, ""), (23, None), (24, "a b a b a b a b a b a b a b")]
    rows = []
    for k in range(60):
        w = words(rng, rng.randrange(5, 200), 500).split()
        if k % 2:
            v = items[k % 12][1].split()
            for _ in range(k % 4):
                v[rng.choice([0, -1, len(v) // 2])] = f"z{k}"
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in v]
        rows.append((k, " ".join(w), "en", "s", 0))
    rows += [(100, "tiny ITEM", "en", "s", 0), (101, "xx tiny. item yy", "en", "s", 0), (102, None, "en", "s", 0), (103, "", "en", "s", 0), (104, "b a b a b a b a b a b a b a b", "en", "s", 0), (105, "word " * 3000, "en", "s", 0), (106, items[0][1], "en", "s", 0), (106, items[0][1], "en", "s", 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows)
    want = brute_leaks(rows, items, 0.8)
    got = decontamination.leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert sum(r["doc_id"] == 106 and r["item_id"] == 0 for r in got) == 2
    in_blocks = decontamination.leaks(df, bench, item_bytes=500).select("doc_id", "item_id").distinct()
    assert {tuple(r) for r in in_blocks.collect()} == set(want)
    clean = decontamination.without_leaks(df, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in rows if r[0] not in {d for d, _ in want})
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(df, bench, item_bytes=500).collect()) == sorted(r["doc_id"] for r in clean.collect())
    assert decontamination.leaks(df, bench.limit(0)).count() == 0 and decontamination.without_leaks(df.limit(0), bench).count() == 0
    assert decontamination.without_leaks(df, bench.limit(0)).count() == len(rows)
    assert decontamination.leaks(df.withColumn("item_id", F.lit("clash")), bench).count() == len(got)


def test_slices_change_nothing(monkeypatch):
    rng = random.Random(16)
    items = [(f"i{k}", words(rng, rng.choice([12, 30]), 40)) for k in range(40)] + [("tiny", "w1 w2"), ("long", words(rng, 300, 400))]
    texts = [words(rng, 400, 40) + " " + items[k][1] + " " + words(rng, 50, 40) for k in range(0, 40, 5)] + [items[-1][1] + " x", "w1 w2", "w1"]
    index = decontamination.Items(items)
    find = lambda: [index.find(decontamination.WordHashes().of(x), 0.8) for x in texts]
    want = find()
    assert all(any(i == items[5 * k][0] and j == 1 for i, *_, j in want[k]) for k in range(8)) and want[8][0][0] == "long"
    monkeypatch.setattr(decontamination, "SPAN", 7)
    monkeypatch.setattr(decontamination, "CELLS", 50)
    index = decontamination.Items(items)
    assert find() == want


def test_item_ids_of_any_type(spark):
    rng = random.Random(17)
    item = words(rng, 30)
    df = spark.createDataFrame([("a", item + " tail"), ("b", "clean " * 20), (None, item)], "doc_id string, text string").withColumns({x: F.lit("x") for x in ("_text", "item_id", "similarity", "key")})
    for kind in ("string", "short", "decimal(5,0)", "date"):
        value = F.lit("2024-01-01") if kind == "date" else F.lit("7")
        bench = spark.createDataFrame([(item,)], "text string").withColumn("item_id", value.cast(kind))
        got = decontamination.leaks(df, bench)
        assert got.schema["item_id"].dataType == bench.schema["item_id"].dataType and {r["doc_id"] for r in got.collect()} == {"a", None}
    clean = decontamination.without_leaks(df, bench)
    assert clean.columns == df.columns and [r["doc_id"] for r in clean.collect()] == ["b"]


def jaccard(x: str, y: str, k: int = 5) -> float:
    a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (x.split(), y.split()))
    return len(a & b) / len(a | b)


def edited(rng: random.Random, text: str, at_most: float) -> str:
    """Words changed one by one until the similarity is ``at_most`` or less."""
    w, n = text.split(), 0
    free = list(range(4, len(w) - 4))
    rng.shuffle(free)
    while jaccard(text, " ".join(w)) > at_most:
        w[free[n]] = f"z{n}"
        n += 1
    return " ".join(w)


def test_texts_that_are_less_similar_stay(spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        x = words(rng, rng.choice([100, 300]), 3000)
        y = edited(rng, x, rng.choice([0.5, 0.6, 0.7, 0.76, 0.78]))
        rows += [(i, x, "en", "s", 0), (1000 + i, y, "en", "s", 0)]
        assert 0.4 < jaccard(x, y) < 0.8
    base = words(rng, 300, 3000)
    chain = [base, edited(rng, base, 0.88), edited(rng, base, 0.87), edited(rng, base, 0.86)]  # each like the first
    rows += [(2000 + i, x, "en", "s", 0) for i, x in enumerate(chain)]
    got = {r["doc_id"] for r in simhash.one_of_each(docs(spark, rows)).collect()}
    assert got == {r[0] for r in rows} - {2001, 2002, 2003}


def test_bitmaps_prune_no_pair_that_counts():
    rng = np.random.default_rng(4)
    for n in (5, 150, 3000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for share in (0.0, 0.05, 0.1, 0.11, 0.3):
            y = x.copy()
            y[: int(share * n)] = rng.integers(0, 1 << 63, int(share * n)).astype(np.uint64)
            same = len(np.intersect1d(x, y))
            bits = [np.frombuffer(simhash.parity(z), np.uint64) for z in (x, y)]
            apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert apart <= 2 * (n - same)
            if same / (2 * n - same) >= 0.8:
                assert 9 * apart <= 2 * n


@pytest.mark.parametrize("block", [4096, 8])
def test_a_dense_family_falls_into_its_exact_classes(spark, block):
    """Copies of one text with many edits each: some alike, most not; blocks of a key are met by each other."""
    rng, base = random.Random(18), words(random.Random(17), 120, 3000)
    rows = [(i, edited(rng, base, rng.choice([0.95, 0.9, 0.85, 0.8, 0.75, 0.7])), "en", "s", 0) for i in range(90)]
    sets = {i: {tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)} for i, x, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"] for r in simhash.one_of_each(docs(spark, rows), block=block).collect()}
    assert got == {i for i in sets if find(i) == i} and 1 < len(got) < 80


def test_every_isolated_pair_over_the_limit_is_found(spark):
    rng, rows = random.Random(13), []
    for i in range(400):
        x = words(rng, rng.choice([60, 100, 300]), 3000)
        w = x.split()
        for n, k in enumerate(rng.sample(range(len(w)), 30)):  # down to just over 0.8
            v = [*w[:k], f"y{n}", *w[k + 1 :]]
            w = v if jaccard(x, " ".join(v)) >= 0.8 else w
        assert 0.8 <= jaccard(x, " ".join(w)) < 0.9
        rows += [(i, x, "en", "s", 0), (1000 + i, " ".join(w), "en", "s", 0)]
    got = {r["doc_id"] for r in simhash.one_of_each(docs(spark, rows)).collect()}
    assert got == set(range(400))
