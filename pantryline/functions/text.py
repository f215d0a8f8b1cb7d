"""Text functions, Column to Column: all stay in the JVM. A null input gives a null or, for flags and lists, an empty result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pantryline.functions import profiles, vocab


def present(c: Column, kind: str = "string") -> Column:
    """F8. Whether a value counts as given: not null, and not '', 0 or an empty list (``kind``: string, number, array)."""
    empty = {"string": c == "", "number": c == 0, "array": F.size(c) == 0}[kind]
    return c.isNotNull() & ~empty


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def words_of(c: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def strings(values: list[str]) -> Column:
    """A literal list of strings."""
    return F.array(*map(F.lit, values)).cast("array<string>")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it; a lambda within ``f`` would compute it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hits(text: Column, keywords: list[str]) -> Column:
    """How many keywords are substrings of ``text``."""
    return F.coalesce(let(text, lambda x: F.size(F.filter(strings(keywords), lambda k: F.contains(x, k)))), F.lit(0))


def words_in(text: Column, keywords: list[str]) -> Column:
    """The keywords that are substrings of ``text``."""
    return let(text, lambda x: F.filter(strings(keywords), lambda k: F.contains(x, k)))


def any_hit(text: Column, keywords: list[str]) -> Column:
    """F14. Whether a keyword is a substring."""
    return F.coalesce(let(text, lambda x: F.exists(strings(keywords), lambda k: F.contains(x, k))), F.lit(False))


def any_pattern(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found."""
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def patterns_found(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns are found."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.coalesce(text.rlike(p).cast("int"), F.lit(0))
    return out


def labels_by(rules: dict[str, Column]) -> Column:
    """The labels whose condition holds, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(x)) for x, c in rules.items())), lambda x: x.isNotNull()).cast("array<string>")


# ---- tagging


def _entries(rows: list[tuple[str, float]]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in rows))


def allergen_scores(text: Column, dictionary: dict = vocab.ALLERGENS, factor: dict = vocab.TIER_FACTOR, over: float = 0.3) -> Column:
    """T1a. map<label, score>: the largest weight times its tier's factor among substring hits; scores over ``over`` stay.

    ``text``: lower-cased.
    """

    def scores(x: Column) -> Column:
        found = []
        for label, tiers in dictionary.items():
            entries = _entries([(k, w * factor[tier]) for tier, words in tiers.items() for k, w in words.items()])
            score = F.array_max(F.transform(F.filter(entries, lambda e: F.contains(x, e["k"])), lambda e: e["w"]))
            found.append(F.struct(F.lit(label).alias("key"), score.alias("value")))
        return F.array(*found)

    return F.map_from_entries(F.filter(let(text, scores), lambda e: F.coalesce(e["value"] > over, F.lit(False))))


def allergens_counted(text: Column, dictionary: dict[str, tuple[list[str], list[str], float]], least: float = 0.5) -> Column:
    """T1b. Labels with (0.8 primary hits + 0.4 secondary hits) times weight of ``least`` or more. (primary, secondary, weight)."""
    return labels_by({label: (hits(text, a) * 0.8 + hits(text, b) * 0.4) * w >= least for label, (a, b, w) in dictionary.items()})


def allergen_boosted(text: Column, keywords: dict[str, list[str]]) -> Column:
    """T1c. map<label, score>: 0.7, 0.2 more for a space-delimited hit, 0.1 more from the second hit on; at most 0.95."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))

    def step(acc: Column, k: Column) -> Column:
        hit = F.contains(text, k)
        score = F.lit(0.7) + F.when(F.contains(padded, F.concat(F.lit(" "), k, F.lit(" "))), 0.2).otherwise(0.0) + F.when(acc["n"] >= 1, 0.1).otherwise(0.0)
        return F.when(hit, F.struct((acc["n"] + 1).alias("n"), F.greatest(acc["m"], score).alias("m"))).otherwise(acc)

    found = []
    for label, words in keywords.items():
        start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("m"))
        best = F.aggregate(strings(words), start, step, lambda a: a["m"])
        found.append(F.struct(F.lit(label).alias("key"), F.least(best, F.lit(0.95)).alias("value")))
    return F.map_from_entries(F.filter(F.array(*found), lambda e: F.coalesce(e["value"] > 0.6, F.lit(False))))


def allergen_word_tiers(text: Column, dictionary: dict[str, list[list[str]]], tiers: tuple[float, ...] = (0.9, 0.7, 0.6)) -> Column:
    """T1d. map<label, score> over space-delimited hits: the best tier's score, 0.1 more for several hits, at most 0.95."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    found = []
    for label, lists in dictionary.items():
        n = [hits(padded, [f" {k} " for k in words]) for words in lists]
        best = F.greatest(*(F.when(c > 0, F.lit(t)).otherwise(0.0) for c, t in zip(n, tiers, strict=False)), F.lit(0.0))
        score = F.least(best + F.when(sum(n[1:], n[0]) > 1, 0.1).otherwise(0.0), F.lit(0.95))
        found.append(F.struct(F.lit(label).alias("key"), score.alias("value")))
    return F.map_from_entries(F.filter(F.array(*found), lambda e: F.coalesce(e["value"] >= 0.6, F.lit(False))))


def labels_any(text: Column, dictionary: dict[str, list[str]], patterns: bool = False) -> Column:
    """T1e. Labels with any hit: substrings, or patterns."""
    return labels_by({x: any_pattern(text, k) if patterns else any_hit(text, k) for x, k in dictionary.items()})


def dietary_tags(text: Column, dictionary: dict[str, tuple[list[str], list[str]]] = vocab.DIETARY) -> Column:
    """T2. Labels with more positive than negative patterns."""
    return labels_by({x: patterns_found(text, a) > patterns_found(text, b) for x, (a, b) in dictionary.items()})


def free_claims(text: Column, dictionary: dict[str, list[str]] = vocab.FREE_CLAIMS) -> Column:
    """T3. Labels that the text claims to be free of."""
    return labels_any(text, dictionary, patterns=True)


def risk_by_score(scores: Column) -> Column:
    """T4. No label: low; a score over 0.8: high; one over 0.5: medium; else unknown."""
    v = F.map_values(scores)
    return F.when(F.size(v) == 0, "low").when(F.exists(v, lambda x: x > 0.8), "high").when(F.exists(v, lambda x: x > 0.5), "medium").otherwise("unknown")


def risk_by_labels(labels: Column, profile: str = "practical") -> Column:
    """T4. By membership in the profile's sets of high and medium labels."""
    high, medium = vocab.RISK_SETS[profile]
    return F.when(F.arrays_overlap(labels, strings(high)), "high").when(F.arrays_overlap(labels, strings(medium)), "medium").otherwise("low")


def preparation(text: Column, dictionary: dict[str, list[str]] = vocab.PREPARATION) -> Column:
    """T5. Preparation methods."""
    return labels_any(text, dictionary, patterns=True)


def nutrition_hints(text: Column, dictionary: dict[str, str] = vocab.NUTRITION) -> Column:
    """T5. A struct of flags."""
    return F.struct(*(any_pattern(text, [p]).alias(x) for x, p in dictionary.items()))


def ingredients(text: Column, patterns: list[str] = vocab.INGREDIENTS) -> Column:
    """T5. Distinct ingredients, in alphabetical order."""
    return F.sort_array(F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), 1) for p in patterns)))))


def ingredient_phrases(text: Column, patterns: list[str] = profiles.INGREDIENT_PHRASES) -> Column:
    """T5. What follows "with", "served with", "includes" and alike up to a comma or full stop, of 3 to 49 characters."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?i){p}"), 1) for p in patterns)))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x).between(3, 49))


def category(name: Column, table: list[tuple[str, list[str]]] = vocab.CATEGORIES, default: str = "other") -> Column:
    """T6. The first category of which a keyword is in the lower-cased name."""
    low, out = F.lower(name), None
    for label, words in table:
        out = (out if out is not None else F).when(any_hit(low, words), label)
    return out.otherwise(default)


def category_by(text: Column, profile: str) -> Column:
    """T6. By a named profile. ``improved`` knows two more rules: a cooking verb with a meat or fish, and a price over 15."""
    table, default = profiles.CATEGORY[profile]
    out = category(text, table, default)
    if profile != "improved":
        return out
    low, price = F.lower(text), F.regexp_extract(text, r"\$(\d+)", 1).try_cast("int")
    cooked = low.rlike(r"\b(grilled|fried|baked|roasted)\b")
    more = F.when(cooked & any_hit(low, ["chicken", "beef", "pork", "lamb"]), "meat").when(cooked & any_hit(low, ["fish", "salmon", "tuna"]), "seafood").when(price > 15, "mains").otherwise(default)
    return F.when(out == default, more).otherwise(out)


def confidence(text: Column, has_price: Column, has_labels: Column, words: list[str] = vocab.CONFIDENT_WORDS) -> Column:
    """T7. 0.5, and 0.2 for a price, 0.1 each for labels, a length from 20 to 150 and a food word; at most 1."""
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    return F.least(F.lit(0.5) + one(has_price, 0.2) + one(has_labels, 0.1) + one(F.length(text).between(20, 150), 0.1) + one(any_hit(F.lower(text), words), 0.1), F.lit(1.0))


def evidence(name: Column, description: Column, price: Column, category: Column, labels: Column, tags: Column, words: list[str]) -> dict[str, Column]:
    """T7. What the profiles of confidence weigh, by name."""
    both = F.lower(F.concat_ws(" ", name, description))
    given = {"price": present(price.cast("string")), "description": present(description), "categorised": category != "other", "labels": F.size(labels) > 0, "tags": F.size(tags) > 0, "food": any_hit(both, words), "name from 5 to 50": F.length(name).between(5, 50)}
    longer = {f"{kind} over {n}": F.length(c) > n for kind, c, sizes in (("name", name, (5, 10)), ("description", description, (10, 20, 30))) for n in sizes}
    return {k: F.coalesce(c, F.lit(False)) for k, c in (given | longer).items()}


def confidence_by(found: dict[str, Column], profile: str, base: Column | None = None, scores: Column | None = None) -> Column:
    """T7. By a named profile, from ``evidence``. ``base``: in place of the profile's; ``scores``: of labels, whose mean counts half."""
    start, most, weights = profiles.CONFIDENCE[profile]
    total = (base if base is not None else F.lit(start)) + additive(*((found[k], w) for k, w in weights))
    if scores is not None:
        total = F.coalesce((total + mean_of(F.map_values(scores))) / 2, total)
    return F.least(total, F.lit(most))


def mean_of(values: Column) -> Column:
    """The mean of a list of numbers; null of an empty one."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def confidence_basic(name: Column, description: Column, price: Column, words: list[str] = profiles.FOOD_FINAL[:20]) -> Column:
    """T7. 0.3 for a price, 0.2 each for a description over 5 and a name from 5 to 50 characters, 0.05 a food word up to 0.2."""
    food = F.least(hits(F.lower(F.concat_ws(" ", name, description)), words) * 0.05, F.lit(0.2))
    return F.least(additive((present(price), 0.3), (F.length(description) > 5, 0.2), (F.length(name).between(5, 50), 0.2)) + food, F.lit(1.0))


def confidence_weighted(name: Column, description: Column, price: Column, labels: dict[str, list[str]], words: list[str] = profiles.FOOD_FINAL) -> Column:
    """T7. 0.3 for a price from 1 to 200, 0.2 for a description over 10 characters and 0.1 more from five words on, 0.2 for a name from 5
    to 50, a share of 0.2 for food words (of ten) and of 0.1 for hits among each label's words (of five)."""
    both = F.lower(F.concat_ws(" ", name, description))
    number = F.regexp_extract(price, r"\d+(?:\.\d{2})?", 0).try_cast("double")
    long = F.length(description) > 10
    base = additive((number.between(1, 200), 0.3), (long, 0.2), (long & (F.size(words_of(description)) >= 5), 0.1), (F.length(name).between(5, 50), 0.2))
    return F.least(base + F.least(hits(both, words) / 10, F.lit(1.0)) * 0.2 + F.least(hits(both, [w for x in labels.values() for w in x]) / 5, F.lit(1.0)) * 0.1, F.lit(1.0))


def item_confidence(scores: Column, risk: Column) -> Column:
    """T7. Mean score times the risk's factor; 0.5 without scores."""
    factor = F.create_map(*(x for k, v in vocab.RISK_FACTOR.items() for x in (F.lit(k), F.lit(v))))
    v = F.map_values(scores)
    return F.when(F.size(v) == 0, F.lit(0.5)).otherwise(mean_of(v) * F.coalesce(factor[risk], F.lit(0.5)))


def item_likelihood(text: Column, words: list[str] = vocab.LIKELY_WORDS) -> Column:
    """T8. 4 for a price, 1 for each food word and 1 for a length from 10 to 100."""
    return F.when(text.rlike(r"\$\d+"), 4).otherwise(0) + hits(F.lower(text), words) + F.when(F.length(text).between(10, 100), 1).otherwise(0)


def likelihood_by(text: Column, profile: str) -> Column:
    """T8. By a named profile; ``profiles.LIKELIHOOD`` has the score that is enough."""
    p, low = profiles.LIKELIHOOD[profile], F.lower(text)
    words, weight, most = p["food"]
    food = F.least(hits(low, words) * weight, F.lit(most))
    bad, minus = p["excluded"]
    score = F.when(any_pattern(text, p["prices"]), p["price"]).otherwise(0) + food + F.when(F.length(text).between(*p["length"]), 1).otherwise(0)
    return score + F.when(any_hit(low, bad), minus).otherwise(0) if bad else score


# ---- prices and items


def extract_price(text: Column, patterns: list[str], low: float | None = None, high: float | None = None) -> Column:
    """T9. Group 1 of the first pattern that matches; with bounds, its first match whose number lies within them."""
    if low is None:
        return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))
    fits = lambda x: parse_price(x).between(low, high)
    return F.coalesce(*(F.get(F.filter(F.regexp_extract_all(text, F.lit(p), 1), fits), F.lit(0)) for p in patterns))


def parse_price(text: Column) -> Column:
    """T10. A number without ``$`` and ``,``, or null."""
    return F.regexp_replace(F.trim(text), r"[$,]", "").try_cast("double")


def parse_item(text: Column) -> Column:
    """T11. struct<name, price, description>: the text without prices and with single spaces; the text itself if over 10 longer."""
    price = F.nullif(F.regexp_extract(text, r"\$([\d,]+(?:\.\d{2})?)", 1), F.lit(""))
    name = F.regexp_replace(F.trim(F.regexp_replace(text, r"\$[\d,]+(?:\.\d{2})?", "")), r"\s+", " ")
    description = F.when(F.length(text) > F.length(name) + 10, text)
    return F.when(F.length(name) >= 3, F.struct(name.alias("name"), price.alias("price"), description.alias("description")))


def _without(text: Column, patterns: list[str]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def _item(name: Column, price: Column, description: Column, least: int) -> Column:
    return F.when(F.length(name) >= least, F.struct(name.alias("name"), price.alias("price"), F.nullif(description, F.lit("")).alias("description")))


def parse_item_block(text: Column, best_of: int = 1, prices: list[str] = profiles.PRICE_FINAL, words: list[str] = profiles.FOOD_FINAL[:10]) -> Column:
    """T11. A block of lines: the name is the first line, or the best of the first ``best_of`` by length, lack of a price, a food word and a
    capital; the description is the rest without prices, if it has over ten characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def score(x: Column) -> Column:
        points = [(F.length(x).between(6, 49), 2), (~x.rlike(r"\$\d+"), 2), (any_hit(F.lower(x), words), 1), (x.rlike(r"^\p{Lu}"), 1)]
        return sum((F.when(c, w).otherwise(0) for c, w in points), F.lit(0))

    start = F.struct(F.lit(0).alias("s"), F.get(lines, F.lit(0)).alias("x"))
    best = F.aggregate(F.slice(lines, 1, best_of), start, lambda a, x: F.when(score(x) > a["s"], F.struct(score(x).alias("s"), x.alias("x"))).otherwise(a), lambda a: a["x"]) if best_of > 1 else F.get(lines, F.lit(0))
    name = F.substring(F.trim(F.regexp_replace(F.coalesce(best, F.lit("Unknown Item")), r"\$\d+(?:\.\d{2})?", "")), 1, 100)
    rest = F.trim(F.regexp_replace(_without(_cut(text, name), prices), r"\s+", " "))
    return _item(name, extract_price(text, [f"({p})" for p in prices]), F.when(F.length(rest) > 10, F.substring(rest, 1, 500)), 1)


def _cut(text: Column, part: Column) -> Column:
    """``text`` without the first occurrence of ``part``."""
    at = F.instr(text, part)
    return F.when((part != "") & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))).otherwise(text)


def parse_item_line(text: Column, prices: list[str] = profiles.PRICE_PRIORITY, longer: int = 30, under: int = 50, bullets: str = r"[\-•*]+\s*") -> Column:
    """T11. A line: price, bullets and double spaces out; split at `` - ``, or at the first ``. `` of a name over ``longer`` characters if
    what stands before it has under ``under``."""

    def parts(v: Column) -> Column:
        name, price, dash, stop = v["name"], v["price"], v["dash"], v["stop"]
        by_stop = (F.size(stop) > 1) & (F.length(name) > longer) & (F.length(F.get(stop, F.lit(0))) < under)
        cut = F.when(F.size(dash) > 1, dash).when(by_stop, stop)
        split = let(cut, lambda c: F.struct(F.coalesce(F.trim(F.get(c, F.lit(0))), name).alias("first"), F.trim(F.get(c, F.lit(1))).alias("rest")))
        return let(split, lambda c: F.when(F.length(name) >= 3, _item(c["first"], price, c["rest"], 0)))

    def bare(x: Column) -> Column:
        found = F.coalesce(*(let(F.regexp_extract(x, p, 0), lambda y: F.when(y != "", y)) for p in prices))
        price = F.regexp_replace(F.coalesce(*(let(F.regexp_extract(x, p, 1), lambda y: F.when(y != "", y)) for p in prices)), r"[^\d.,]", "")
        name = F.trim(F.regexp_replace(F.replace(x, F.coalesce(found, F.lit("\x00")), F.lit("")), r"\s+", " "))
        name = F.regexp_replace(F.regexp_replace(name, f"^{bullets}", ""), r"\s*[\-•*]+$", "")
        return let(name, lambda n: F.struct(n.alias("name"), price.alias("price"), F.split(n, " - ", 2).alias("dash"), F.split(n, r"\. ", 2).alias("stop")))

    return let(let(text, bare), parts)


def parse_item_parens(text: Column, prices: list[str] = profiles.PRICE_DYNAMIC) -> Column:
    """T11. All prices and one pair of parentheses at the end out; the description is what stands before the price, if it differs."""
    name = F.trim(F.regexp_replace(F.trim(_without(text, prices)), r"\s*\([^)]*\)\s*$", ""))
    before = F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, rf"^([^$]+?)\s*{p}", 1)), F.lit("")) for p in prices))
    return _item(name, extract_price(text, prices), F.when(before != name, before), 3)


# ---- names, phones, places


def name_key(name: Column, suffixes: list[str] = vocab.NAME_SUFFIXES) -> Column:
    """T12a. Lower case, each suffix dropped once in turn, letters, digits and single spaces alone."""
    out = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    for s in suffixes:
        out = F.trim(F.regexp_replace(out, f" {s}$", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s]", ""), r"\s+", " "))


def name_key_plain(name: Column) -> Column:
    """T12b. Lower case, no apostrophes, spaces for hyphens, ``and`` for ``&``."""
    return F.replace(F.replace(F.replace(F.trim(F.lower(F.coalesce(name, F.lit("")))), F.lit("'"), F.lit("")), F.lit("-"), F.lit(" ")), F.lit("&"), F.lit("and"))


def name_key_squashed(name: Column) -> Column:
    """T12c. Lower case without spaces, hyphens and quotes."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\s\-'\"]", "")


def name_key_words(name: Column, stop: list[str] | None = None) -> Column:
    """T12d. Lower-case letters and digits with single spaces, without stop words."""
    words = words_of(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9\s]", ""))
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(strings(stop), w)) if stop else words, " ")


def phone_key(phone: Column) -> Column:
    """T13. Digits, without a leading 1 of eleven."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    return F.when(F.length(digits).eqNullSafe(11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def name_similarity(a: Column, b: Column) -> Column:
    """T14. One minus the edit distance of two name keys over the longer one's length; 0 if one is empty."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def token_jaccard(a: Column, b: Column) -> Column:
    """T15. Shared over all distinct words of two lists; two empty ones 1, one empty one 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def build_address(number: Column, street: Column, city: Column, state: Column, postcode: Column) -> Column:
    """T16. ``12 Street, City, ST 60601``; a number only before a street, a postcode only after a state; null if nothing is given."""
    n = lambda c: F.nullif(c, F.lit(""))
    line = F.when(n(street).isNotNull(), F.concat_ws(" ", n(number), n(street)))
    end = F.when(n(state).isNotNull(), F.concat_ws(" ", n(state), n(postcode)))
    return F.nullif(F.concat_ws(", ", line, n(city), end), F.lit(""))


def tag_flags(tags: Column, names: dict[str, str]) -> Column:
    """T17. Labels of the tags (tag: label) whose value is ``yes``."""
    return labels_by({label: F.coalesce(tags[tag] == "yes", F.lit(False)) for tag, label in names.items()})


def place_quality(**given: Column) -> Column:
    """T18. The share of the conditions that hold, of ten."""
    total = F.lit(0)
    for c in given.values():
        total = total + F.coalesce(c.cast("int"), F.lit(0))
    return total / 10.0


def row_checksum(*names: str) -> Column:
    """T19. MD5 of the columns as JSON in the order of their names, nulls kept."""
    return F.md5(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}))


def detection_reasons(text: Column, label: str, dictionary: dict = vocab.ALLERGENS) -> Column:
    """T20. The dictionary's words of a label that are in the lower-cased text, each with its tier."""
    words = [(f"{profiles.TIER_NAMES[tier]}: {k}", k) for tier, found in dictionary[label].items() for k in found]
    entries = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(k).alias("k")) for r, k in words))
    return F.transform(F.filter(entries, lambda e: F.contains(text, e["k"])), lambda e: e["r"])


def low_score_warnings(scores: Column, under: float = 0.6, text: Column | None = None, dictionary: dict = vocab.ALLERGENS) -> Column:
    """T20. A line for each label scored under ``under``; with the lower-cased ``text`` also why it was found."""
    if text is None:
        low = F.filter(F.map_entries(scores), lambda e: e["value"] < under)
        return F.transform(low, lambda e: F.concat(F.lit("Low confidence detection for "), e["key"]))
    lines = [F.when(scores[x] < under, F.concat(F.lit(f"Low confidence detection for {x}: "), F.array_join(detection_reasons(text, x, dictionary), ", "))) for x in dictionary]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def additive(*evidence: tuple[Column, float]) -> Column:
    """T21. The sum of the weights whose condition holds."""
    total = F.lit(0.0)
    for c, w in evidence:
        total = total + F.when(c, F.lit(float(w))).otherwise(0.0)
    return total


# ---- item gates


def valid_item(name: Column, low: int = 2, high: int = 100, blocked: list[str] = vocab.INVALID_NAMES, anchored: list[str] | None = None, needs: Column | None = None) -> Column:
    """F11. Length within bounds, no blocked word in the lower-cased name, no anchored pattern, and ``needs`` if given."""
    ok = F.length(name).between(low, high) & ~any_hit(F.lower(name), blocked)
    ok = ok & ~any_pattern(F.lower(name), anchored or [])
    return F.coalesce(ok & needs if needs is not None else ok, F.lit(False))


def valid_item_by(profile: str, name: Column, price: Column, description: Column, score: Column) -> Column:
    """F11. By a named profile. ``score``: the item's confidence, of which some profiles need 0.4."""
    low, high, blocked, anchored = profiles.VALID[profile]
    food = {"website": profiles.FOOD_WEBSITE, "priority_final": profiles.FOOD_PRIORITY_FINAL}.get(profile, [])
    needs = {
        "final": confidence_basic(name, description, price) > 0.2,
        "ml": score >= 0.4,
        "allergen": score >= 0.4,
        "website": any_hit(F.lower(name), food) | present(price) | F.coalesce(F.length(description) > 10, F.lit(False)),
        "priority_final": any_hit(F.lower(name), food) | price.isNotNull(),
    }.get(profile)
    return valid_item(name if profile in ("production", "final", "ubereats", "doordash") else F.trim(name), low, high, blocked, anchored, needs)


def food_score(text: Column, excluded: list[str], tiers: list[tuple[str, list[str], float]], each: bool, least: float) -> Column:
    """F12. struct<valid, score, reason>: nothing if an excluded word is found; else tiers' weights, for each hit or once."""
    low = F.lower(text)
    counts = [(label, hits(low, words), w) for label, words, w in tiers]
    score = F.lit(0.0)
    for _, n, w in counts:
        score = score + (n * w if each else F.when(n > 0, F.lit(w)).otherwise(0.0))
    score = F.when(any_hit(low, excluded), F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))
    reason = F.when(any_hit(low, excluded), F.lit("excluded")).otherwise(F.concat_ws("_", *(F.when(n > 0, F.lit(label)) for label, n, _ in counts)))
    return F.struct((score >= least).alias("valid"), score.alias("score"), reason.alias("reason"))


def food_score_by(text: Column, profile: str) -> Column:
    """F12. struct<valid, score, reason> by a named profile: exclusions, then words by tier, a price, the length and capitals, each with its
    reason (``strong_soup``, ``has_price``, ``good_length``, ``proper_caps``)."""
    return let(text, lambda x: let(F.trim(F.lower(x)), lambda low: _food_score(x, low, profiles.FOOD_SCORE[profile])))


def _food_score(text: Column, low: Column, p: dict) -> Column:
    """``low``: the text trimmed and lower-cased. Both are named many times, so they must be bound."""
    tiers = []
    for tier, words, _ in p["tiers"]:
        mine = words_in(low, words)
        tiers.append((mine if p["each"] else F.slice(mine, 1, 1)).alias(tier))
    patterns, price = p["prices"]
    a, b, length = p["length"]
    body = text if p["each"] else F.trim(text)
    more = [("has_price", any_pattern(text, patterns), price), ("good_length", F.length(body).between(a, b), length), ("proper_caps", text.rlike("[A-Z][a-z]"), p["caps"])]
    more += [("multi_word", F.size(words_of(text)) >= 2, p["several"])] * bool(p["several"])
    least, enough = p["least"]

    def of(x: Column) -> Column:
        found, score = [], F.lit(0.0)
        for tier, _, weight in p["tiers"]:
            prefix = F.lit(f"{tier}_")
            found.append(F.transform(x[tier], lambda k: F.concat(prefix, k)))  # noqa: B023  called at once
            score = score + F.size(x[tier]) * weight
        reasons = F.array_join(F.flatten(F.array(*found, labels_by({k: x[k] for k, _, _ in more}))), "_")
        # sums of tenths: to nine decimals, so that 0.1 + 0.2 reaches 0.3
        total = F.round(score + additive(*((x[k], w) for k, _, w in more)), 9)
        valid = (total >= enough) | (x["multi_word"] if p["several"] else F.lit(False))
        return F.struct(valid.alias("valid"), F.least(total, F.lit(1.0)).alias("score"), F.coalesce(F.nullif(reasons, F.lit("")), F.lit(p["none"])).alias("reason"))

    nothing = lambda why: F.struct(F.lit(False).alias("valid"), F.lit(0.0).alias("score"), F.lit(why).alias("reason"))
    out = F.when(F.length(F.trim(text)) < least, nothing("too_short"))
    for kind, words in p["excluded"]:
        out = out.when(any_hit(low, words), nothing(f"excluded_{kind}"))
    if p["patterns"]:
        out = out.when(any_pattern(low, p["patterns"]), nothing("excluded"))
    why, names = p["names"]
    if names:
        out = out.when(low.isin(names), nothing(why))
    return out.otherwise(let(F.struct(*tiers, *(c.alias(k) for k, c, _ in more)), of))


def potential_item(text: Column, excluded: list[str], wanted: list[str], food: list[str]) -> Column:
    """F13. No excluded pattern, and a wanted pattern, a food word, or two to five words that all begin upper-case."""
    words = words_of(text)
    title = F.size(words).between(2, 5) & F.forall(words, lambda w: w.rlike("^[A-Z]"))
    return F.coalesce(~any_pattern(F.lower(text), excluded) & (any_pattern(text, wanted) | any_hit(F.lower(text), food) | title), F.lit(False))


def page_gate(html: Column, challenge: list[str], indicators: list[str] = vocab.MENU_INDICATORS, least: int = 5) -> Column:
    """F15. No challenge phrase, and indicators found plus twice the prices of ``least`` or more."""
    low = F.lower(html)
    score = hits(low, indicators) + 2 * F.size(F.regexp_extract_all(html, F.lit(r"\$\d+\.\d{2}|\$\d+"), 0))
    return F.coalesce(~any_hit(low, challenge) & (score >= least), F.lit(False))


def page_gate_by(profile: str, html: Column, text: Column, elements: Column | None = None) -> Column:
    """F15. By a named profile; ``text``: the page's visible text; ``elements``: how many menu-like elements it has (P2, P3, P9)."""
    low, seen, n = F.lower(html), F.lower(text), elements if elements is not None else F.lit(0)
    prices = lambda patterns: sum((F.size(F.regexp_extract_all(text, F.lit(p), 0)) for p in patterns), F.lit(0))
    ok = {
        "production": lambda: ~any_hit(low, profiles.CHALLENGE_PRODUCTION),
        "ultimate": lambda: ~any_hit(low, profiles.CHALLENGE_ULTIMATE),
        "final": lambda: ~any_hit(low, profiles.CHALLENGE_FINAL) & (hits(low, profiles.PAGE_FINAL) >= 3),
        "dynamic": lambda: hits(low, profiles.PAGE_DYNAMIC) + hits(seen, profiles.PAGE_DYNAMIC) + 3 * prices([r"\$\d+(?:\.\d{2})?"]) + 2 * n >= 10,
        "priority": lambda: hits(seen, profiles.FOOD_PRIORITY) + 2 * prices(profiles.PRICE_PRIORITY) + hits(seen, profiles.PAGE_PRIORITY) + 0.5 * n >= 8,
    }[profile]()
    return F.coalesce(ok, F.lit(False))


def usable_url(url: Column, blocked: list[str]) -> Column:
    """F16. Neither a script nor a fragment, and of no blocked domain."""
    return F.coalesce(~url.rlike(r"^(?i:javascript:|#)") & ~any_hit(F.lower(url), blocked), F.lit(False))


def name_in_url(url: Column, name: Column, longer: int = 3) -> Column:
    """F16. Whether a word of the name with over ``longer`` characters is in the URL."""
    return F.coalesce(F.exists(words_of(F.lower(name)), lambda w: (F.length(w) > longer) & F.contains(F.lower(url), w)), F.lit(False))


def menu_image_url(url: Column, wanted: list[str], unwanted: list[str]) -> Column:
    """F17. A wanted word and no unwanted one."""
    return any_hit(F.lower(url), wanted) & ~any_hit(F.lower(url), unwanted)
