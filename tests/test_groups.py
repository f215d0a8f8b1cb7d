"""Order-dependent operators against plain loops."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from pantryline.functions import geo
from pantryline.operators import dedupe, resolve, serve
from pantryline.sources import store


def test_similarity_dedupe_is_the_greedy_loop(spark):
    rng = random.Random(1)
    rows = [(g, i, list({rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))})) for g in range(6) for i in range(30)]
    rows += [(9, 0, ["a", "b", "c", "d"]), (9, 1, ["a", "b", "c", "d", "e"]), (8, 0, []), (8, 1, []), (8, 2, ["a"])]  # exactly 0.8: kept; of empty ones the first
    rows = [(g, 100 * g + i, w) for g, i, w in rows]
    got = {(r["g"], r["i"]) for r in dedupe.similarity_dedupe(spark.createDataFrame(rows, "g int, i int, w array<string>"), ["g"], "w", "i").collect()}
    want, kept = set(), {}
    for g, i, w in rows:
        if not any(len(set(w) & set(v)) / max(1, len(set(w) | set(v))) > 0.8 or not w and not v for v in kept.setdefault(g, [])):
            kept[g].append(w)
            want.add((g, i))
    assert got == want and (9, 901) in got and (8, 801) not in got


def test_merge_candidates(spark):
    rows = [(1, "x", 0.5, 4, 1, None, "5", ["a"]), (1, "x", 0.9, 1, 2, "", "7", ["b"]), (1, "x", 0.9, 2, 3, "desc", None, ["a"]), (1, "y", 0.95, 0, 4, None, None, [])]
    df = spark.createDataFrame(rows, "page int, name string, conf double, prio int, o int, description string, price string, labels array<string>")
    got = {r["name"]: r for r in dedupe.merge_candidates(df, ["page", "name"], ["description", "price"], "prio", "conf", "labels", "o").collect()}
    assert (got["x"]["description"], got["x"]["price"], got["x"]["labels"], got["x"]["n_candidates"]) == ("desc", "7", ["a", "b"], 3)
    assert got["x"]["conf"] == 1.0 and got["y"]["conf"] == 0.95
    skipped = dedupe.merge_candidates(df, ["page"], ["description"], "prio", "conf", "labels", "o", skip={"description": "desc"}).first()
    assert skipped["description"] == "desc" and skipped["labels"] == ["a", "b"] and skipped["n_candidates"] == 4


def test_independent_set_is_the_greedy_pass(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(i, i + 1) for i in range(100, 110)}
    nodes = [(i, f"k{i % 45 if i < 60 else i}") for i in (*range(60), *range(100, 111), 500, 501)] + [(502, "k501")]
    got = {r["id"] for r in resolve.independent_set(spark.createDataFrame(nodes, "id long, key string"), spark.createDataFrame(list(edges), "lo long, hi long")).collect()}
    kept, keys = [], set()
    for i, k in nodes:
        if k not in keys and not any((j, i) in edges for j in kept):
            kept.append(i)
            keys.add(k)
    assert got == set(kept)


PLACE = "id string, pos long, name string, lat double, lon double, phone string"


def test_union_dedupe_is_the_loop(spark):
    rng = random.Random(3)
    names = ["Luna", "Luna Cafe", "Cafe Sol", "Sol", "Red-Lion", "red lion", "Bob's", "Bobs & Co"]
    place = lambda p, i: (f"{p}{i}", i, rng.choice(names) + rng.choice(["", "", f" {i}"]), None if rng.random() < 0.1 else 41 + rng.randrange(8) * 0.0004, -87 + rng.randrange(8) * 0.0004, "")
    a, b = [place("a", i) for i in range(25)], [place("b", i) for i in range(60)]
    key = lambda n: n.lower().strip().replace("'", "").replace("-", " ").replace("&", "and")

    def same(x, y):
        k, m = key(x[2]), key(y[2])
        near = x[3] is not None and y[3] is not None and abs(x[3] - y[3]) < 0.001 and abs(x[4] - y[4]) < 0.001
        return k == m or near and (k in m or m in k)

    kept = list(a)
    for x in b:
        if not any(same(x, y) for y in kept):
            kept.append(x)
    got = resolve.union_dedupe(spark.createDataFrame(a, PLACE), spark.createDataFrame(b, PLACE))
    assert sorted(r["id"] for r in got.collect()) == sorted(x[0] for x in kept)


def test_geo_match_is_the_loop(spark):
    rng = random.Random(4)
    row = lambda p, i: (f"{p}{i:03d}", i, rng.choice(["Luna Cafe", "Luna", "Sol Bar", "Sole", ""]), 60 + rng.random() * 0.01, -179 + rng.random() * 0.02, rng.choice(["", "3125550001", "13125550001", "3125550002"]))
    a, b = [row("a", i) for i in range(80)], [row("b", i) for i in range(80)]
    a.append(("a999", 999, "Luna", None, 1.0, ""))

    def far(x, y):
        h = math.sin(math.radians(y[3] - x[3]) / 2) ** 2 + math.cos(math.radians(x[3])) * math.cos(math.radians(y[3])) * math.sin(math.radians(y[4] - x[4]) / 2) ** 2
        return 2 * geo.EARTH_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    got = resolve.geo_fuzzy_match(spark.createDataFrame(a, PLACE), spark.createDataFrame(b, PLACE), least=0.0).collect()
    want = {(x[0], y[0]) for x in a for y in b if x[3] is not None and far(x, y) <= 100}
    assert {(r["a_id"], r["b_id"]) for r in got} == want and len(want) > 20
    # across the 180th meridian, beside the pole and on it, and a row far from all that changes no cell
    spots = [(0.0, 179.9998), (0.0, -179.9998), (12.0, 180.0), (12.0003, -179.9999), (89.9, 10.0), (89.9, 10.4), (89.9999, 0.0), (89.9999, 170.0), (-89.9995, -90.0), (-89.9999, 95.0), (-45.0, 0.0)]
    edge = [(f"e{i}", i, "Luna", lat, lon, "") for i, (lat, lon) in enumerate(spots)]
    found = resolve.geo_fuzzy_match(spark.createDataFrame([*a, *edge], PLACE), spark.createDataFrame([*edge, *b], PLACE), least=0.0).collect()
    want |= {(x[0], y[0]) for x in edge for y in edge if far(x, y) <= 100}
    assert {(r["a_id"], r["b_id"]) for r in found} == want and {("e0", "e1"), ("e2", "e3"), ("e4", "e5"), ("e6", "e7"), ("e8", "e9")} <= want
    pairs = resolve.geo_fuzzy_match(spark.createDataFrame(a, PLACE), spark.createDataFrame(b, PLACE))
    best, taken = {}, {}
    for r in sorted(pairs.collect(), key=lambda r: (r["a_pos"], -r["confidence"], r["b_pos"])):
        best.setdefault(r["a_id"], r["b_id"])
    for x in a:
        if best.get(x[0]) and best[x[0]] not in taken:
            taken[best[x[0]]] = x[0]
    assert {(r["a_id"], r["b_id"]) for r in resolve.assign_one_to_one(pairs).collect()} == {(x, y) for y, x in taken.items()}


@pytest.mark.parametrize("least", [0.5, 0.35, 0.45, 0.62])
def test_crowded_cells_lose_no_pair(spark, least):
    """All cells as crowded ones against all pairs."""
    rng = random.Random(11)
    names = ["luna", "luna x", "lune", "moonlight diner", "moonlit diner", "monlight dine", "ab", "abc", "b", "", "the golden dragon palace", "golden dragon palaces"]

    def name():
        x = list(rng.choice(names))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(x) + 1)
            x[k : k + rng.randrange(2)] = rng.choice(["a", "", "zz", " "])
        return "".join(x)

    row = lambda p, i: (f"{p}{i}", i, name(), 41 + rng.randrange(3) * 0.0004, -87 + rng.randrange(3) * 0.0004, rng.choice(["", "", "3125550001", "3125550002"]))
    a, b = (spark.createDataFrame([row(p, i) for i in range(120)], PLACE) for p in "ab")
    every, some = (sorted(map(str, resolve.geo_fuzzy_match(a, b, least=least, crowded=n).collect())) for n in (10**9, 0))
    assert every == some and len(every) > 100


def test_ten_thousand_places_on_one_spot(spark):
    letters = F.lower(F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "[^A-Za-z]", ""))
    place = F.concat_ws(" ", F.substring(letters, 1, 9), F.substring(letters, 10, 8))
    a = spark.range(10_000).select(F.concat(F.lit("a"), "id").alias("id"), F.col("id").alias("pos"), place.alias("name"), F.lit(41.0).alias("lat"), F.lit(-87.0).alias("lon"), F.lit("").alias("phone"))
    b = a.withColumns({"id": F.concat(F.lit("b"), F.col("pos").cast("string")), "name": F.when(F.col("pos") % 2 == 0, F.concat(F.lit("x"), F.substring("name", 2, 99))).otherwise(F.reverse("name")), "phone": F.lit("")})
    got = resolve.geo_fuzzy_match(a, b)
    began = time.time()
    found = got.filter(F.col("a_pos") == F.col("b_pos")).count()
    assert found >= 5_000 and time.time() - began < 240


def test_cascade_and_fallback(spark):
    rows = [("p", 0, i) for i in range(2)] + [("p", 1, i) for i in range(2)] + [("p", 2, 0)] + [("q", 1, 0), ("q", 2, 0), ("r", 0, 0), ("r", 0, 1), ("r", 0, 2), ("r", 1, 0)]
    got = dedupe.cascade(spark.createDataFrame(rows, "page string, s int, i int"), ["page"], "s", [0, 3, 2]).groupBy("page", "s").count().collect()
    assert {(r["page"], r["s"]): r["count"] for r in got} == {("p", 0): 2, ("p", 1): 2, ("q", 1): 1, ("q", 2): 1, ("r", 0): 3}
    both = [("a", "primary", str(i), "1", i) for i in range(5)] + [("a", "fallback", "z", "1", 9)] + [("b", "primary", "x", "1", 0), ("b", "fallback", "x", "1", 1)] + [("c", "fallback", "x", "1", 1)] + [("d", "primary", "x", "1", 1)]
    out = dedupe.source_fallback(spark.createDataFrame(both, "k string, s string, n string, p string, o int"), "k", "s", "n", "p", "o")
    assert sorted((r["k"], r["label"], r["o"]) for r in out.collect()) == [*[("a", "primary_url", i) for i in range(5)], ("b", "combined", 0), ("c", "fallback_website", 1), ("d", "primary_url_only", 1)]


def test_labels_with_empty_lists(spark):
    items = spark.createDataFrame([(1, "soup"), (2, "cake"), (3, "tea")], "id int, name string")
    a = spark.createDataFrame([(1, "milk"), (1, "eggs"), (1, "milk"), (2, None)], "id int, allergen string")
    b = spark.createDataFrame([(1, "vegan"), (1, "keto")], "id int, tag string")
    got = {r["id"]: r for r in serve.items_with_details(items, [(a, "allergen"), (b, "tag")], "id").collect()}
    assert got[1]["allergens"] == ["eggs", "milk"] and got[1]["tags"] == ["keto", "vegan"]
    assert got[2]["allergens"] == [] and got[3]["tags"] == []
    labelled = serve.items_with_details(items, [(a, "allergen")], "id")
    assert {r["id"] for r in serve.exclude_labels(labelled, "allergens", ["milk"]).collect()} == {2, 3}
    stats = serve.place_stats(spark.createDataFrame([("p",), ("q",)], "place string"), items.withColumns({"place": F.lit("p"), "price": F.col("id") * 1.0}), a.withColumn("place", F.lit("p")), "place", ["id"], "price", "allergen")
    p, q = stats.orderBy("place").collect()
    assert (p["n_items"], p["n_labelled"], p["n_labels"], p["avg_price"], p["breakdown"]) == (3, 1, 2, 2.0, {"eggs": 1, "milk": 1})
    assert (q["n_items"], q["n_labels"], q["breakdown"]) == (0, 0, None)


def test_batches_over_partitions(spark):
    got = dedupe.batches(spark.range(1000).repartition(7), ["id"], 30).orderBy("id").collect()
    assert all((r["batch"], r["position"]) == (r["id"] // 30 + 1, r["id"] % 30 + 1) for r in got)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_batches_keep_wide_rows(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = spark.range(40_000).repartition(7).select("id", F.sha2(F.col("id").cast("string"), 256).alias("a"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int")).alias("b"))
        got = dedupe.batches(rows, ["id"], 30)
        assert got.columns == ["id", "a", "b", "batch", "position"] and got.count() == 40_000
        assert got.filter((F.col("batch") != F.expr("id div 30 + 1")) | (F.col("position") != F.col("id") % 30 + 1) | (F.col("a") != F.sha2(F.col("id").cast("string"), 256))).isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_keys_are_a_key(spark):
    rows = [(None, 0, 1), (None, 1, 2), (None, 2, 3), ("p", 0, 4)]
    got = dedupe.cascade(spark.createDataFrame(rows, "page string, s int, i int"), ["page"], "s", [0, 2, 1]).collect()
    assert sorted(r["i"] for r in got) == [1, 2, 4]
    both = [(None, "primary", "x", "1", 0), (None, "fallback", "x", "1", 1), (None, "fallback", "y", "1", 2)]
    out = dedupe.source_fallback(spark.createDataFrame(both, "k string, s string, n string, p string, o int"), "k", "s", "n", "p", "o")
    assert sorted((r["label"], r["o"]) for r in out.collect()) == [("fallback_website", 1), ("fallback_website", 2)]
    fill = dedupe.first_wins_backfill(spark.createDataFrame([(None, 1, "unknown"), (None, 2, "thai"), ("a", 1, None)], "k string, o int, c string"), ["k"], "o", "c")
    assert {(r["k"], r["c"]) for r in fill.collect()} == {(None, "thai"), ("a", None)}
    words = [(None, 1, ["a", "b", "c", "d", "e", "f"]), (None, 2, ["a", "b", "c", "d", "e", "f", None]), ("x", 3, ["a", "b", "c", "d", "e", "f"])]
    kept = dedupe.similarity_dedupe(spark.createDataFrame(words, "k string, i int, w array<string>"), ["k"], "w", "i")
    assert sorted(r["i"] for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("limit", [1_000_000, 12, 1])
def test_greedy_by_component(spark, limit):
    """In one task, component by component, and in rounds."""
    rng = random.Random(limit)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(40)} | {(i, i + 1) for i in range(100, 109)}
    nodes = [(i, f"k{i % 50 if i < 60 else i}") for i in (*range(60), *range(100, 110), 500, 501)] + [(502, "k501"), (503, None), (504, None)]
    got = {r["id"] for r in resolve.independent_set(spark.createDataFrame(nodes, "id long, key string"), spark.createDataFrame(list(edges), "lo long, hi long"), limit).collect()}
    kept, keys = [], set()
    for i, k in nodes:
        if k not in keys and not any((j, i) in edges for j in kept):
            kept.append(i)
            keys.add(k)
    assert got == set(kept)


def test_components(spark):
    rng = random.Random(5)
    links = [tuple(sorted(rng.sample(range(200), 2))) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = resolve.components(spark.createDataFrame(links, "lo long, hi long")).collect()
    assert len(got) == len(root) and {r["id"]: r["root"] for r in got} == root


def test_long_chains_of_duplicates(spark):
    """Ten thousand places in a row, each near the next only; every name contains every second one."""
    rows = [(f"b{i}", i, "Luna" if i == 0 else f"Luna {i}" if i % 2 else f"Luna {i - 1} Luna {i} Luna {i + 1}", 41 + i * 0.0006, -87.0, "") for i in range(10_000)]
    kept = []
    for x in rows:
        key = x[2].lower()
        if not any(abs(x[3] - y[3]) < 0.001 and (key in y[2].lower() or y[2].lower() in key) for y in kept[-3:]):
            kept.append(x)
    got = resolve.union_dedupe(spark.createDataFrame([], PLACE), spark.createDataFrame(rows, PLACE))
    assert len(kept) < 6000 and sorted(r["id"] for r in got.collect()) == sorted(x[0] for x in kept)


def test_upsert_ties(spark):
    old = spark.createDataFrame([(1, 5, 1, "old"), (2, 5, 1, "old"), (3, 9, 2, "old"), (None, 1, 1, "old")], "k int, updated int, created int, v string")
    new = spark.createDataFrame([(1, 5, 3, "new"), (2, 4, 0, "new"), (3, 9, 1, "a"), (3, 9, 1, "b"), (4, None, None, "new")], "k int, updated int, created int, v string")
    got = {r["k"]: (r["v"], r["created"]) for r in store.upsert_by_key(old, new, "k", "updated", "created").collect()}
    assert got == {1: ("new", 1), 2: ("old", 0), 3: ("b", 1), 4: ("new", None), None: ("old", 1)}
