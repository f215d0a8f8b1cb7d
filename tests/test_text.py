"""Text functions on hand-worked rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pantryline.functions import text


def value(spark, column, **given):
    """What a column gives for one row."""
    df = spark.range(1)
    for k, v in given.items():
        df = df.withColumn(k, v if hasattr(v, "alias") else F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_tiered_scores(spark):
    s = text.allergen_scores(F.col("t"))
    assert value(spark, s, t="grilled cheese with milk") == {"milk": pytest.approx(0.9)}
    assert value(spark, s, t="mozzarella") == {"milk": pytest.approx(0.56)}
    assert value(spark, s, t="donut with eggplant") == {"eggs": pytest.approx(0.9)}  # substrings, as meant
    assert value(spark, s, t="fried rice") == {}  # 0.5 * 0.6 is not over 0.3
    assert value(spark, s, t="lasagna") == {"milk": pytest.approx(0.48)}
    assert value(spark, text.risk_by_score(s), t="lasagna") == "unknown"
    assert value(spark, text.risk_by_score(s), t="milk") == "high"
    assert value(spark, text.risk_by_score(s), t="mozzarella") == "medium"
    assert value(spark, text.risk_by_score(s), t="water") == "low"
    assert value(spark, text.low_score_warnings(s), t="lasagna") == ["Low confidence detection for milk"]
    assert value(spark, text.item_confidence(s, text.risk_by_score(s)), t="mozzarella") == pytest.approx(0.56 * 0.8)
    assert value(spark, text.item_confidence(s, text.risk_by_score(s)), t="water") == 0.5


def boosted(words, t):
    """A loop over the keywords in order."""
    best, n = 0.0, 0
    for w in words:
        if w in t:
            n += 1
            best = max(best, 0.7 + (0.2 if f" {w} " in f" {t} " else 0) + (0.1 if n > 1 else 0))
    return min(best, 0.95) if n else None


@pytest.mark.parametrize("t", ["soft cheesecake and milk", "milk", "cheesecake buttermilk", "none", "milk cheese"])
def test_boosted_scores_follow_the_order(spark, t):
    words = ["cheese", "milk", "butter"]
    got = value(spark, text.allergen_boosted(F.col("t"), {"dairy": words}), t=t)
    want = boosted(words, t)
    assert got == ({"dairy": pytest.approx(want)} if want else {})


def test_tags_and_claims(spark):
    tags = text.dietary_tags(F.col("t"))
    assert value(spark, tags, t="vegan and veggie, no chicken") == ["vegan"]
    assert value(spark, tags, t="plant-based meatless chicken") == ["vegetarian", "vegan"]
    assert value(spark, tags, t="jalapeño") == ["spicy"]
    assert value(spark, text.free_claims(F.col("t")), t="gluten-free, nut free") == ["gluten", "tree_nuts"]
    assert value(spark, text.preparation(F.col("t")), t="sautéed and deep-fried") == ["fried", "sautéed"]
    assert value(spark, text.ingredients(F.col("t")), t="basil, chicken and chicken on rice") == ["basil", "chicken", "rice"]
    assert value(spark, text.nutrition_hints(F.col("t")), t="fried tofu")["likely_high_fat"] is True


def test_prices(spark):
    usual = [r"\$(\d+(?:,\d{3})*(?:\.\d{2})?)", r"(\d+) dollars"]
    for t, want in {"$12": "12", "a $12.99 b": "12.99", "$1,234.56": "1,234.56", "12 dollars": "12", "none": None}.items():
        assert value(spark, text.extract_price(F.col("t"), usual), t=t) == want
    for t, want in {"$0.50 or $9": "9", "$999": None, "$200": "200", "5 dollars": "5"}.items():
        assert value(spark, text.extract_price(F.col("t"), usual, 1, 200), t=t) == want
    assert value(spark, text.parse_price(F.lit(" $1,234.50 "))) == 1234.5
    assert value(spark, text.parse_price(F.lit("free"))) is None
    item = value(spark, text.parse_item(F.lit("Big  salad $12.50 with very many fresh things")))
    assert item["name"] == "Big salad with very many fresh things" and item["price"] == "12.50"
    assert value(spark, text.parse_item(F.lit("$5"))) is None


def test_names_and_phones(spark):
    for name, want in {"X Bar Grill": "x bar", "The House Place": "the house", "Cafe": "cafe", "!?": "", "Joe's Grill Bar": "joes", "A Cafe Restaurant": "a"}.items():
        assert value(spark, text.name_key(F.lit(name))) == want
    assert value(spark, text.name_key_words(F.lit("The  Old-Mill & Co"), ["the"])) == "oldmill co"
    assert value(spark, text.phone_key(F.lit("+1 (312) 555-0199"))) == "3125550199"
    assert value(spark, text.phone_key(F.lit("2312555019"))) == "2312555019"
    assert value(spark, text.name_similarity(F.lit(""), F.lit("x"))) == 0.0
    assert value(spark, text.token_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0


def test_gates(spark):
    assert value(spark, text.page_gate(F.col("t"), ["captcha"]), t="menu food price $12 order") is True
    assert value(spark, text.page_gate(F.col("t"), ["captcha"]), t="menu food price $12 order Captcha") is False
    assert value(spark, text.usable_url(F.lit("JavaScript:void(0)"), [])) is False
    assert value(spark, text.usable_url(F.lit("https://Agg.com/x"), ["agg.com"])) is False
    assert value(spark, text.name_in_url(F.lit("http://goldenfork.com"), F.lit("The Golden X"))) is True
    assert value(spark, text.menu_image_url(F.lit("/Menu-1.jpg"), ["menu"], ["logo"])) is True
    assert value(spark, text.potential_item(F.lit("Blue Door Soup"), [], [], [])) is True
    assert value(spark, text.valid_item(F.lit("see more"))) is False
    assert value(spark, text.build_address(F.lit("12"), F.lit("Main"), F.lit(""), F.lit("IL"), F.lit(None).cast("string"))) == "12 Main, IL"
    assert value(spark, text.build_address(*[F.lit("")] * 5)) is None


CATEGORIES = {
    "final": {"Plate of the day": "main", "Apple crumble": "appetizer", "Mixed greens": "salad", "Broth": "soup", "Chocolate shake": "dessert", "Juice": "beverage", "Mystery": "main"},
    "nextgen": {"Beef consomme": "soup", "Cobb": "salad", "Lasagna": "pasta", "Calzone": "pizza", "Scallop": "seafood", "Tofu bowl": "vegetarian", "Tiramisu": "dessert", "Soda": "beverage", "Mystery": "entree"},
    "optimized": {"Small plate": "appetizer", "Consomme": "entree", "Ravioli": "pasta", "Crab legs": "seafood", "Lamb": "entree", "Tiramisu": "entree", "Beer": "beverage"},
    "final_optimized": {"Starter": "appetizer", "Bisque": "soup", "Spaghetti": "pasta", "Seafood mix": "seafood", "Burger": "meat", "Ice cream": "dessert", "Wine": "beverage"},
    "ml": {"Spinach dip": "appetizer", "Garden bowl": "salad", "Panini": "sandwich", "Margherita": "pizza", "Tuna": "seafood", "Ribs": "meat", "Sweet potato": "dessert", "Mystery": "entree"},
    "allergen": {"Buffalo wings": "appetizer", "Gazpacho": "soup", "Hoagie": "sandwich", "Pepperoni": "pizza", "Scallop": "seafood", "Roast turkey": "meat", "Cocktail": "beverage", "Mystery": "entree"},
    "dynamic": {"Nachos": "appetizer", "Key lime pie": "pizza", "Cookie": "dessert", "Lasagna": "pasta", "Ribs": "meat", "Mystery": "other"},
    "priority": {"Club": "sandwich", "Baby spinach": "salad", "Beef stew": "soup", "Fettuccine": "pasta", "Mussels": "seafood", "Duck": "meat", "Brownie": "dessert", "Smoothie": "beverage", "Mystery": "other"},
}


def test_categories_of_profiles(spark):
    """Values written out, not taken from the tables."""
    rows = [(p, t, want) for p, each in CATEGORIES.items() for t, want in each.items()]
    df = spark.createDataFrame(rows, "p string, t string, want string")
    got = df.select("p", "t", "want", F.coalesce(*(F.when(F.col("p") == p, text.category_by(F.col("t"), p)) for p in CATEGORIES)).alias("got"))
    assert [tuple(r) for r in got.filter("got != want or got is null").collect()] == []


def test_confidence_of_profiles(spark):
    """Base, weights and limits written out."""
    full = dict(name="Seafood risotto", description="with a long and tasty account of it", price="12.50", category="pasta", labels=["milk"], tags=["x"])
    bare = dict(name="Tea", description="", price=None, category="other", labels=[], tags=[])
    found = text.evidence(*(F.col(x) for x in ("name", "description", "price", "category", "labels", "tags")), ["risotto"])
    df = spark.createDataFrame([tuple(x.values()) for x in (full, bare, {**bare, "name": "Iced teas", "price": "2"})], "name string, description string, price string, category string, labels array<string>, tags array<string>")
    rows = df.select(*(F.round(text.confidence_by(found, p), 6).alias(p) for p in ("ml", "allergen"))).collect()
    assert [tuple(r) for r in rows] == [(0.9, 0.95), (0.5, 0.5), (0.6, 0.75)]
