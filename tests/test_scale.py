"""Steps that must grow no faster than their input: no move of all words, no pairs of equal places, nothing computed once a keyword."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pantryline.functions import geo, profiles, text
from pantryline.operators import extract, resolve, serve
from pantryline.plans import menus
from pantryline.plans.base import Tables
from pantryline.streaming import changes


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrases_move_no_words(spark: SparkSession) -> None:
    """Words stay in their rows; blocks of phrases find what one block does; repeats, overlaps, null and empty lists."""
    texts = {1: "a b c d a b", 2: "", 3: None, 4: "b c d e b c", 5: "x y", 6: "d"}
    rows = spark.createDataFrame([(k, None if t is None else t.split(" ")) for k, t in texts.items()], "id long, words array<string>")
    phrases = spark.createDataFrame([(p,) for p in ("a b", "b c d e", "c", "b", "d a", "d", "", "y z", "a b")], "phrase string")
    found = serve.phrase_matches(rows, "id", "words", phrases)
    assert "Exchange" not in _plan(found)
    want = {(1, 0, 2, "a b"), (1, 2, 1, "c"), (1, 3, 2, "d a"), (1, 5, 1, "b"), (4, 0, 4, "b c d e"), (4, 4, 1, "b"), (4, 5, 1, "c"), (6, 0, 1, "d")}
    assert {tuple(r) for r in found.collect()} == want
    assert {tuple(r) for r in serve.phrase_matches(rows, "id", "words", phrases, in_task=2).collect()} == want
    assert sorted(r.phrase for r in serve.phrase_matches(rows.filter("id = 4"), "id", "words", phrases, once=True).collect()) == ["b", "b c d e", "c"]
    assert serve.phrase_matches(rows, "id", "words", phrases.filter(F.lit(False))).count() == 0


def test_phrases_in_blocks_shuffle_nothing(spark: SparkSession) -> None:
    """Several blocks of phrases are met by one pass over the texts, without a shuffle of what each finds; a null word is no phrase's."""
    rows = spark.createDataFrame([(1, ["a", "b", None, "a", "b", "c"]), (2, None), (3, ["c"])], "id long, words array<string>")
    phrases = spark.createDataFrame([(p,) for p in ("a b", "b", "b c", "c", "a", "b  a")], "phrase string")
    found = serve.phrase_matches(rows, "id", "words", phrases, in_task=2)
    assert "Exchange" not in _plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, 0, 2, "a b"), (1, 3, 2, "a b"), (1, 5, 1, "c"), (3, 0, 1, "c")}
    first = serve.phrase_matches(rows, "id", "words", phrases, once=True, in_task=2)
    assert "Exchange" not in _plan(first)
    assert {tuple(r) for r in first.collect()} == {(1, 0, 2, "a b"), (1, 5, 1, "c"), (3, 0, 1, "c")}


def test_leftmost_matches_are_those_of_a_plain_loop(spark: SparkSession) -> None:
    """Chains of overlapping matches, longer and more than are gone through at once, and matches that touch or lie apart."""
    dice = np.random.default_rng(7)
    for size, most in ((0, 1), (1, 9), (5_000, 2), (5_000, 9), (20_000, 3)):
        places = np.flatnonzero(dice.random(size) < 0.7)
        n = dice.integers(1, most + 1, len(places))
        end, want = 0, []
        for p, k in zip(places.tolist(), n.tolist(), strict=True):
            want.append(p >= end)
            end = p + k if p >= end else end
        assert serve._leftmost(places, n).tolist() == want


def test_a_dictionary_moves_kinds_not_phrases(spark: SparkSession) -> None:
    """Words and phrases of a row meet no shuffled dictionary: only which sets of labels and weights were found; like a plain search."""
    dice = np.random.default_rng(3)
    texts = {i: ["abcdef"[k] for k in dice.integers(0, 6, i % 40)] for i in range(60)} | {60: None, 61: [""]}
    given = [("a", "x", 0.5), ("a", "y", 0.25), ("b c", "x", 1.0), ("b c", "x", 0.75), ("c d e", None, 2.0), ("d", "z", None), ("e f", "y", 0.25), ("f", "x", 0.5), ("f", "y", 0.25), ("", "w", 9.0)]
    want = {}
    for key, text_words in texts.items():
        p, text_words = 0, text_words or []
        while p < len(text_words):
            n = max((k for k in (1, 2, 3) if p + k <= len(text_words) and any(x[0] == " ".join(text_words[p : p + k]) != "" for x in given)), default=0)
            for x in given:
                if n and x[0] == " ".join(text_words[p : p + n]):
                    known = want.get((key, x[1]))
                    want[key, x[1]] = x[2] if known is None else max(known, x[2])
            p += n or 1
    rows, dictionary = spark.createDataFrame(list(texts.items()), "id long, words array<string>"), spark.createDataFrame(given, "phrase string, label string, weight double")
    assert len({x[1] for x in want}) == 4
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (serve.dictionary_phrases(rows, "id", "words", dictionary), serve.dictionary_phrases(rows, "id", "words", dictionary, in_task=2)):
            assert "phrase" not in _plan(found)
            assert {(r.id, r.label): r.weight for r in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_equal_places_are_compared_once(spark: SparkSession) -> None:
    """Two thousand places of one spot, name and phone a side: one pair of classes, every pair of places, and the first of each matched."""
    side = lambda p, n: spark.range(n).select(F.concat(F.lit(p), "id").alias("id"), F.col("id").alias("pos"), F.lit("Luna Bar").alias("name"), F.lit(41.0).alias("lat"), F.lit(-87.0).alias("lon"), F.lit("312").alias("phone"))
    a, b = side("a", 2000), side("b", 2000).orderBy(F.desc("pos"))
    assert resolve.class_pairs(resolve.place_classes(a), resolve.place_classes(b)).count() == 1
    pairs = resolve.geo_fuzzy_match(a, b, in_task=100_000)
    assert pairs.rdd.getNumPartitions() >= 40 and pairs.select("a_id", "b_id").distinct().count() == 4_000_000
    sizes = [r.n for r in pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1_000_000
    assert [(r.a_id, r.b_id) for r in resolve.best_matches(a, b).collect()] == [("a0", "b0")]


def test_best_matches_are_those_of_all_pairs(spark: SparkSession) -> None:
    """Many equal places, null positions, ids that come twice, places without coordinates."""
    names, k = F.array(*map(F.lit, ["Luna", "Luna Bar", "Old Mill", "", None])), F.col("id")
    side = lambda p, s: spark.range(300).select(F.concat(F.lit(p), (k % 290).cast("string")).alias("id"), F.when(k != 7, k).alias("pos"), names[(k % 5).cast("int")].alias("name"), F.when(k % 11 != 3, 41.0 + (k * s % 7) * 0.0003).alias("lat"), F.lit(-87.0).alias("lon"), (k % 3).cast("string").alias("phone"))
    a, b = side("a", 3), side("b", 5)
    pairs = resolve.geo_fuzzy_match(a, b)
    x, y = a.withColumnsRenamed({c: f"a_{c}" for c in a.columns}), b.withColumnsRenamed({c: f"b_{c}" for c in b.columns})
    same = lambda p: text.name_key(F.col(f"{p}_name"))
    every = x.join(y).withColumn("d", geo.haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).filter("d <= 100")
    every = every.withColumn("c", text.name_similarity(same("a"), same("b")) * 0.4 + F.when(F.col("a_phone") == F.col("b_phone"), 1.0).otherwise(0.0) * 0.4 + (1.0 - F.col("d") / 100) * 0.2).filter("c >= 0.5")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(pairs.select("a_id", "a_pos", "b_id", "b_pos")) == rows(every.select("a_id", "a_pos", "b_id", "b_pos"))
    unique = lambda df: df.filter("pos < 290 or pos is null")
    a, b = unique(a), unique(b)
    assert rows(resolve.best_matches(a, b)) == rows(resolve.assign_one_to_one(resolve.geo_fuzzy_match(a, b)))


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_pass_over_tags_copies_no_stack(spark: SparkSession) -> None:
    """The pass over a page's tags has a list as its stack, not an expression that makes a new one a tag."""
    page = spark.createDataFrame([(1, "<table><tr><td>a<td>$2</table>")], "id long, html string")
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    rows = extract.table_rows(page, "id", "html")
    assert "aggregate(" not in _optimized(rows)
    assert [tuple(r) for r in rows.collect()] == [(1, 0, "a", "$2")]


def test_objects_are_found_by_one_pass(spark: SparkSession) -> None:
    """No copy of the stack a token: ten thousand lists within each other, strings with brackets, stray ends and nulls."""
    deep = '{"k":' + "[" * 10_000 + '{"x":"}]\\""}' + "]" * 10_000 + "}"
    df = spark.createDataFrame([(deep,), (']}{"k":{"a":[1]},"l":[{"k":2}]}',), (None,), ("",)], "s string").select(extract.objects_under(F.col("s"), "k").alias("o"))
    assert "aggregate(" not in _optimized(df)
    assert [r.o for r in df.collect()] == [['{"x":"}]\\""}'], ['{"a":[1]}'], None, []]


def test_lines_and_labels_are_computed_once(spark: SparkSession) -> None:
    """A line's name is not written into the plan for each use, nor a label's text for each keyword."""
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    lines = spark.createDataFrame([("* Soup  - hot $5.00",), (None,), ("x",)], "x string")
    parsed = lines.select(text.parse_item_line(F.concat("x", F.lit(""))).alias("i"))
    assert _optimized(parsed).count("regexp_") < 30
    assert [r.i and tuple(r.i) for r in parsed.collect()] == [("Soup", "5.00", "hot"), None, None]
    labels = lines.select(text.allergen_scores(F.lower(F.concat_ws(" ", "x", "x"))).alias("m"))
    assert _optimized(labels).count("concat_ws(") == 1


def test_a_group_of_the_feed_is_a_bucket_of_places() -> None:
    """One call handles all places of its bucket, null among them, whose rows come in any order and in several chunks."""

    class Places(dict):
        getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__  # noqa: N815

    p = changes.ChangeProcessor(["phone"], announce=True)
    p.last = changes.PlaceState(states := Places())
    frame = lambda *rows: pd.DataFrame(rows, columns=["place_id", "seq", "phone", "removed"])
    p.handleInitialState((7,), frame(("a", "5", "1", None), ("d", "5", "1", None), (None, None, None, None)), None)
    chunks = [frame(("b", "10", "2", False), ("a", "9", "2", False), (None, "1", "x", False), ("d", "6", None, True)), frame(("b", "9", "1", False), ("a", "4", "late", False), (None, "2", None, False), ("c", None, "1", False))]
    got = [tuple(r)[:5] for f in p.handleInputRows((7,), iter(chunks), None) for r in f.itertuples(index=False)]
    assert got == [("a", "updated", "phone", "1", "2"), ("b", "new", None, None, None), ("b", "updated", "phone", "1", "2"), ("d", "removed", None, None, None), (None, "new", None, None, None), (None, "updated", "phone", "x", None)]
    assert states == {("a",): (9, "2"), ("b",): (10, "2"), (None,): (2, None)}


def test_buckets_of_many_landed_places(spark: SparkSession, tmp_path) -> None:
    """More landed places in a bucket than go to Python at once, few new rows; a null place; numbers that a double can't hold."""
    k, big = F.col("id"), 2**60
    place = F.when(k > 0, k.cast("string")).alias("place_id")
    old = spark.range(25_000).select(place, (k + big).alias("seq"), F.lit("1").alias("phone"))
    new = spark.range(30).select(place, (k + big + k % 2).alias("seq"), F.lit("2").alias("phone"))
    run = lambda: changes.run_cycles(changes.change_feed(spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in"), ["phone"], announce=True, landed=old, buckets=1), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    read = lambda: [tuple(r) for r in spark.read.schema(changes.CHANGE).parquet(f"{tmp_path}/out/changes/*").collect()]
    new.write.parquet(f"{tmp_path}/in")
    run()
    assert sorted(read()) == sorted((str(i), "updated", "phone", "1", "2", big + i + 1) for i in range(1, 30, 2))
    spark.range(25_010).select(place, (k + big + 2).alias("seq"), F.lit("3").alias("phone")).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    late = [r for r in read() if r[4] != "2"]
    assert len(late) == 25_010 and sum(r[1] == "new" for r in late) == 10 and {r[3] for r in late if r[0] is None} == {"1"}


def test_food_scores_bind_their_text(spark: SparkSession) -> None:
    """A text is computed once a profile, not once a keyword; nulls, empty texts, and a word of each kind."""
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    lines = spark.createDataFrame([("Tomato soup $5.00",), (" Home ",), ("x",), ("",), (None,), ("  ",)], "x string")
    for p in profiles.FOOD_SCORE:
        scored = lines.select(text.food_score_by(F.concat_ws(" ", "x", "x"), p).alias("f"))
        assert _optimized(scored).count("concat_ws(") == 1
    got = [tuple(r.f) for r in lines.select(text.food_score_by(F.col("x"), "nextgen").alias("f")).collect()]
    short = (False, 0.0, "too_short")
    assert got == [(True, 0.7, "strong_soup_has_price_good_length_proper_caps"), (False, 0.0, "excluded_navigation"), short, short, (False, 0.0, "no_indicators"), short]


def test_menu_lines_are_dealt_to_all_cores(spark: SparkSession, tmp_path) -> None:
    """A small file of one row group is one task when it is read; scores are computed in as many as there are."""
    spark.range(4000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    scored = menus.f12_food_score_profiles(Tables(spark, str(tmp_path)))
    sizes = [r.n for r in scored.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 4 and sum(sizes) == 4000 and max(sizes) < 2000
