"""Dictionaries and patterns of the menu domain. Every function takes its own as an argument; these are defaults.

A tagging dictionary is a list of (label, tier, keyword, weight). Labels of different sources meet in ``LABEL_ALIAS``.
"""

from __future__ import annotations

# Must equal the reference's for equal results.
TIER_FACTOR = {"primary": 0.9, "secondary": 0.7, "dishes": 0.6}

ALLERGENS = {
    "milk": {
        "primary": {"milk": 1.0, "dairy": 1.0, "lactose": 1.0, "casein": 1.0, "whey": 1.0, "cheese": 0.9, "butter": 0.9, "cream": 0.9, "yogurt": 0.9},
        "secondary": {"mozzarella": 0.8, "parmesan": 0.8, "cheddar": 0.8, "brie": 0.8, "feta": 0.8, "ricotta": 0.8, "mascarpone": 0.8, "goat cheese": 0.8, "ice cream": 0.7, "gelato": 0.7, "custard": 0.7, "pudding": 0.6},
        "dishes": {"alfredo": 0.9, "carbonara": 0.9, "mac and cheese": 1.0, "cheeseburger": 0.8, "pizza": 0.7, "lasagna": 0.8},
    },
    "eggs": {
        "primary": {"egg": 1.0, "eggs": 1.0, "albumin": 1.0, "lecithin": 0.8},
        "secondary": {"mayonnaise": 0.9, "mayo": 0.9, "aioli": 0.8, "hollandaise": 0.9, "custard": 0.7, "meringue": 1.0, "eggnog": 1.0},
        "dishes": {"omelet": 1.0, "frittata": 1.0, "quiche": 1.0, "carbonara": 0.9, "caesar salad": 0.6, "fried rice": 0.5},
    },
    "wheat": {
        "primary": {"wheat": 1.0, "flour": 0.9, "gluten": 1.0, "semolina": 1.0, "bulgur": 1.0, "couscous": 1.0, "farro": 1.0, "spelt": 1.0},
        "secondary": {"bread": 0.9, "pasta": 0.9, "noodles": 0.8, "pizza": 0.8, "sandwich": 0.8, "burger": 0.7, "wrap": 0.6},
        "dishes": {"spaghetti": 0.9, "linguine": 0.9, "penne": 0.9, "ravioli": 0.9, "gnocchi": 0.7, "dumplings": 0.8, "tempura": 0.8},
    },
    "tree_nuts": {
        "primary": {"almond": 1.0, "walnut": 1.0, "pecan": 1.0, "cashew": 1.0, "pistachio": 1.0, "hazelnut": 1.0, "macadamia": 1.0, "brazil nut": 1.0, "pine nut": 1.0, "tree nuts": 1.0},
        "secondary": {"marzipan": 0.9, "nougat": 0.8, "praline": 0.8, "amaretto": 0.7},
        "dishes": {"pesto": 0.8, "baklava": 0.9, "pecan pie": 1.0, "almond cake": 1.0},
    },
    "peanuts": {
        "primary": {"peanut": 1.0, "peanuts": 1.0, "groundnut": 1.0, "arachis": 1.0},
        "secondary": {"peanut butter": 1.0, "peanut oil": 0.8, "peanut sauce": 1.0},
        "dishes": {"satay": 0.9, "pad thai": 0.7, "kung pao": 0.8, "african stew": 0.6},
    },
    "fish": {
        "primary": {"fish": 1.0, "salmon": 1.0, "tuna": 1.0, "cod": 1.0, "halibut": 1.0, "trout": 1.0, "bass": 1.0, "anchovy": 1.0, "sardine": 1.0, "mackerel": 1.0},
        "secondary": {"worcestershire": 0.6, "caesar dressing": 0.5},
        "dishes": {"sushi": 0.9, "sashimi": 1.0, "fish and chips": 1.0, "ceviche": 1.0, "bouillabaisse": 0.9, "fish tacos": 1.0},
    },
    "shellfish": {
        "primary": {"shrimp": 1.0, "crab": 1.0, "lobster": 1.0, "prawns": 1.0, "crayfish": 1.0, "scallops": 1.0, "mussels": 1.0, "clams": 1.0, "oysters": 1.0, "shellfish": 1.0},
        "secondary": {"seafood": 0.7, "crustacean": 1.0, "mollusk": 1.0},
        "dishes": {"paella": 0.8, "jambalaya": 0.7, "bisque": 0.9, "cioppino": 0.9, "shrimp scampi": 1.0, "crab cakes": 1.0},
    },
    "soybeans": {
        "primary": {"soy": 1.0, "soya": 1.0, "soybean": 1.0, "tofu": 1.0, "tempeh": 1.0, "miso": 1.0, "edamame": 1.0},
        "secondary": {"soy sauce": 1.0, "tamari": 1.0, "teriyaki": 0.8, "hoisin": 0.7},
        "dishes": {"miso soup": 1.0, "teriyaki": 0.8, "asian stir fry": 0.6},
    },
    "sesame": {
        "primary": {"sesame": 1.0, "tahini": 1.0, "sesame oil": 1.0, "sesame seed": 1.0},
        "secondary": {"hummus": 0.7, "halva": 0.9, "za'atar": 0.6},
        "dishes": {"everything bagel": 0.8, "sesame chicken": 0.8, "middle eastern": 0.5},
    },
}

#: label: (positive patterns, negative patterns)
DIETARY = {
    "vegetarian": ([r"\bvegetarian\b", r"\bveggie\b", r"\bplant.based\b", r"\bmeatless\b"], [r"\bmeat\b", r"\bbeef\b", r"\bpork\b", r"\bchicken\b", r"\bfish\b"]),
    "vegan": ([r"\bvegan\b", r"\bplant.based\b", r"\bdairy.free\b"], [r"\bmeat\b", r"\bdairy\b", r"\begg\b", r"\bhoney\b"]),
    "gluten_free": ([r"\bgluten.free\b", r"\bgf\b", r"\bceliac.friendly\b"], [r"\bwheat\b", r"\bgluten\b", r"\bbread\b", r"\bpasta\b"]),
    "keto": ([r"\bketo\b", r"\bketogenic\b", r"\blow.carb\b"], [r"\bbread\b", r"\bpasta\b", r"\brice\b", r"\bpotato\b"]),
    "spicy": ([r"\bspicy\b", r"\bhot\b", r"\bjalapeño\b", r"\bhabanero\b", r"\bsriracha\b", r"\bchili\b"], []),
}

FREE_CLAIMS = {
    "gluten": [r"gluten.free", r"\bgf\b", r"celiac.friendly"],
    "milk": [r"dairy.free", r"lactose.free", r"milk.free"],
    "tree_nuts": [r"nut.free", r"tree.nut.free"],
    "peanuts": [r"peanut.free"],
    "eggs": [r"egg.free"],
    "soybeans": [r"soy.free"],
    "fish": [r"fish.free"],
    "shellfish": [r"shellfish.free"],
}

PREPARATION = {
    "fried": [r"\bfried\b", r"\bdeep.fried\b", r"\bpan.fried\b", r"\btempura\b"],
    "grilled": [r"\bgrilled\b", r"\bbbq\b", r"\bbarbecue\b", r"\bcharred\b"],
    "baked": [r"\bbaked\b", r"\broasted\b", r"\boven.baked\b"],
    "steamed": [r"\bsteamed\b", r"\bsteam\b"],
    "sautéed": [r"\bsautéed\b", r"\bsauteed\b", r"\bpan.seared\b"],
    "raw": [r"\braw\b", r"\bsashimi\b", r"\bceviche\b", r"\btartare\b"],
}

NUTRITION = {
    "likely_high_protein": r"\b(protein|chicken|beef|fish|tofu|beans|lentils)\b",
    "likely_high_fat": r"\b(fried|butter|oil|cream|cheese|avocado)\b",
    "likely_high_carb": r"\b(pasta|rice|bread|potato|noodles)\b",
    "likely_high_fiber": r"\b(beans|lentils|quinoa|oats|vegetables)\b",
    "likely_low_calorie": r"\b(salad|steamed|grilled|light|fresh)\b",
    "contains_vegetables": r"\b(vegetables|veggie|lettuce|tomato|onion|pepper)\b",
    "contains_fruits": r"\b(apple|banana|berry|citrus|fruit)\b",
}

INGREDIENTS = [
    r"\b(chicken|beef|pork|fish|salmon|tuna|shrimp|crab|lobster)\b",
    r"\b(cheese|mozzarella|parmesan|cheddar|feta|goat cheese)\b",
    r"\b(tomato|onion|garlic|pepper|mushroom|spinach|lettuce)\b",
    r"\b(rice|pasta|noodles|bread|quinoa|couscous)\b",
    r"\b(olive oil|butter|cream|milk|yogurt)\b",
    r"\b(herbs|basil|oregano|thyme|rosemary|cilantro|parsley)\b",
]

CATEGORIES = [
    ("appetizer", ["appetizer", "starter", "app", "wings", "nachos", "dip"]),
    ("salad", ["salad", "greens", "caesar", "garden"]),
    ("soup", ["soup", "bisque", "chowder", "broth"]),
    ("sandwich", ["sandwich", "burger", "wrap", "panini", "sub"]),
    ("pasta", ["pasta", "spaghetti", "linguine", "ravioli", "lasagna"]),
    ("pizza", ["pizza", "pie"]),
    ("seafood", ["fish", "salmon", "shrimp", "crab", "lobster", "scallop"]),
    ("meat", ["steak", "beef", "chicken", "pork", "lamb"]),
    ("dessert", ["dessert", "cake", "pie", "ice cream", "chocolate"]),
]

LIKELY_WORDS = ["served", "grilled", "fried", "baked", "fresh", "homemade", "sauce", "cheese", "chicken", "beef", "fish", "pasta", "salad", "soup", "sandwich", "burger", "pizza"]
CONFIDENT_WORDS = ["served", "with", "fresh", "grilled", "fried"]
MENU_INDICATORS = ["menu", "food", "dish", "appetizer", "entree", "dessert", "price", "$", "order", "cuisine", "restaurant"]
INVALID_NAMES = ["submit", "button", "click", "menu", "section", "category", "view", "more", "see", "robot", "verify", "loading", "error", "please", "try", "again"]
RISK_SETS = {"practical": (["nuts", "shellfish", "eggs"], ["dairy", "gluten", "soy"]), "final": (["nuts", "peanuts", "shellfish", "fish"], ["dairy", "eggs", "gluten"])}
NAME_SUFFIXES = ["restaurant", "cafe", "bar", "grill", "kitchen", "house", "place"]
RISK_FACTOR = {"high": 1.0, "medium": 0.8, "low": 0.6, "unknown": 0.4}
PLACE_FLAGS = ["wheelchair", "outdoor_seating", "takeaway", "delivery"]

#: Labels that mean the same in different sources.
LABEL_ALIAS = {"milk": "dairy", "wheat": "gluten", "soybeans": "soy", "tree_nuts": "nuts", "gluten_free": "gluten-free"}
# End of the fixed values.


def rows(dictionary: dict[str, dict[str, dict[str, float]]]) -> list[tuple[str, str, str, float]]:
    """A nested dictionary as (label, tier, keyword, weight)."""
    return [(label, tier, word, weight) for label, tiers in dictionary.items() for tier, words in tiers.items() for word, weight in words.items()]
