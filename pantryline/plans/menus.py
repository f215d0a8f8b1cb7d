"""Queries of the named profiles and the default dictionaries: every part as a line of a menu, its text by its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantryline.functions import profiles, text, vocab
from pantryline.operators import dedupe, extract, metrics
from pantryline.plans.base import Tables, dealt, query
from pantryline.sources.places import PAYMENT

DISHES = ["Grilled chicken caesar salad with parmesan", "Margherita Pizza", "Tomato Bisque - served with bread", "Fish Tacos (2)", "Lobster Ravioli. Fresh pasta in a cream sauce made daily", "Chocolate Cake", "Coffee", "Contact us", "Home", "Vegan Burger", "Eggplant Parmesan", "Peanut Noodles", "Steak Frites", "Peach Pie", "House Wine", "STARTERS", "Iced Tea", "* Salmon Roll *", "Chicken Wings", "Order online for delivery", "Menu", "Special of the day", "tofu", "Quiche"]
NOTES = ["", "with fresh herbs", "Served with bread, topped with cheese.", "contains peanuts", "a long and tasty description of what is on the plate"]


def q(x: str) -> str:
    """An SQL text."""
    return "'" + x.replace("'", "''") + "'"


def some(c: str, words: list[str]) -> str:
    """SQL: whether ``c`` has one of the words."""
    return "(" + (" OR ".join(f"contains({c}, {q(w)})" for w in words) or "FALSE") + ")"


def number(c: str, words: list[str]) -> str:
    """SQL: how many of the words ``c`` has."""
    return "(" + (" + ".join(f"contains({c}, {q(w)})::INT" for w in words) or "0") + ")"


def match(c: str, patterns: list[str]) -> str:
    """SQL: whether ``c`` has one of the patterns."""
    return "(" + (" OR ".join(f"regexp_matches({c}, {q(p)})" for p in patterns) or "FALSE") + ")"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


#: x: a line with its price; name, note, price, category, labels and tags of an item.
MENU = f"""(SELECT *, dish || amount AS x, lower(dish || amount) AS l, lower(dish) AS low, lower(concat_ws(' ', dish, note)) AS whole FROM (
  SELECT p_partkey, {_sql_list(DISHES)}[p_partkey % {len(DISHES)} + 1] AS dish, {_sql_list(NOTES)}[p_partkey % {len(NOTES)} + 1] AS note,
  CASE p_partkey % 4 WHEN 0 THEN ' $' || (5 + p_partkey % 23) || '.50' WHEN 1 THEN ' $' || (p_partkey % 30 + 1) WHEN 2 THEN '' ELSE ' 12 dollars' END AS amount,
  CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 300) || '.50' END AS price, CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE 'soup' END AS category,
  p_partkey % 2 AS n_labels, (p_partkey // 2) % 2 AS n_tags, (p_partkey % 10) / 10.0::DOUBLE AS conf FROM part))"""


def menu(t: Tables) -> DataFrame:
    """Parts as menu lines."""
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(text.strings(values), (k % len(values)).cast("int") + 1)
    amount = F.when(k % 4 == 0, F.concat(F.lit(" $"), (5 + k % 23).cast("string"), F.lit(".50"))).when(k % 4 == 1, F.concat(F.lit(" $"), (k % 30 + 1).cast("string"))).when(k % 4 == 2, "").otherwise(" 12 dollars")
    rows = dealt(t.part.select(k), "p_partkey").select(k, pick(DISHES).alias("dish"), pick(NOTES).alias("note"), amount.alias("amount"), F.when(k % 3 > 0, F.concat((k % 300).cast("string"), F.lit(".50"))).alias("price"), F.when(k % 4 == 0, "other").otherwise("soup").alias("category"), (k % 2).alias("n_labels"), (F.floor(k / 2) % 2).alias("n_tags"), ((k % 10) / 10.0).alias("conf"))
    many = lambda n: F.when(F.col(n) > 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"x": F.concat("dish", "amount"), "labels": many("n_labels"), "tags": many("n_tags")})


def _category_sql(profile: str) -> str:
    table, default = profiles.CATEGORY[profile]
    out = "CASE " + " ".join(f"WHEN {some('l', words)} THEN {q(c)}" for c, words in table)
    if profile == "improved":
        out += " WHEN try_cast(nullif(regexp_extract(x, '\\$(\\d+)', 1), '') AS INT) > 15 THEN 'mains'"
    return f"{out} ELSE {q(default)} END AS {profile}"


@query(f"SELECT p_partkey, {', '.join(map(_category_sql, profiles.CATEGORY))} FROM {MENU}")
def t6_category_profiles(t: Tables) -> DataFrame:
    """Categories by every table."""
    return menu(t).select("p_partkey", *(text.category_by(F.col("x"), p).alias(p) for p in profiles.CATEGORY))


EVIDENCE = {
    "labels": "n_labels > 0", "tags": "n_tags > 0", "price": "price IS NOT NULL", "description": "note <> ''", "categorised": "category <> 'other'", "food": some("whole", profiles.FOOD_PRIORITY_FINAL), "name from 5 to 50": "length(dish) BETWEEN 5 AND 50",
    **{f"name over {n}": f"length(dish) > {n}" for n in (5, 10)}, **{f"description over {n}": f"length(note) > {n}" for n in (10, 20, 30)},
}
SCORES = {"comprehensive", "website"}


def _confidence_sql(profile: str) -> str:
    base, most, weights = profiles.CONFIDENCE[profile]
    total = f"{base} + " + " + ".join(f"CASE WHEN {EVIDENCE[k]} THEN {w} ELSE 0 END" for k, w in weights)
    total = f"CASE WHEN n_labels > 0 THEN (({total}) + 0.8) / 2 ELSE {total} END" if profile in SCORES else total
    return f"round(least({total}, {most}), 6)::DOUBLE AS {profile}"


BASIC = f"least(CASE WHEN price IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN length(note) > 5 THEN 0.2 ELSE 0 END + CASE WHEN length(dish) BETWEEN 5 AND 50 THEN 0.2 ELSE 0 END + least({number('whole', profiles.FOOD_FINAL[:20])} * 0.05, 0.2), 1.0)"
LABELS = {"nuts": ["peanut", "almond"], "dairy": ["cheese", "cream", "parmesan"]}
WEIGHTED = f"""least(CASE WHEN try_cast(price AS DOUBLE) BETWEEN 1 AND 200 THEN 0.3 ELSE 0 END + CASE WHEN length(note) > 10 THEN 0.2 ELSE 0 END + CASE WHEN length(note) > 10 AND len(string_split(note, ' ')) >= 5 THEN 0.1 ELSE 0 END
  + CASE WHEN length(dish) BETWEEN 5 AND 50 THEN 0.2 ELSE 0 END + least({number('whole', profiles.FOOD_FINAL)} / 10.0, 1) * 0.2 + least({number('whole', [w for x in LABELS.values() for w in x])} / 5.0, 1) * 0.1, 1)"""


@query(f"SELECT p_partkey, round({BASIC}, 6)::DOUBLE AS basic, round({WEIGHTED}, 6)::DOUBLE AS weighted, {', '.join(map(_confidence_sql, profiles.CONFIDENCE))} FROM {MENU}")
def t7_confidence_profiles(t: Tables) -> DataFrame:
    """Confidences by every profile."""
    rows = menu(t)
    found = text.evidence(*map(F.col, ("dish", "note", "price", "category", "labels", "tags")), profiles.FOOD_PRIORITY_FINAL)
    scores = F.when(F.size("labels") > 0, F.create_map(F.lit("a"), F.lit(0.8)))
    by = {p: text.confidence_by(found, p, scores=scores if p in SCORES else None) for p in profiles.CONFIDENCE}
    by |= {"basic": text.confidence_basic(F.col("dish"), F.col("note"), F.col("price")), "weighted": text.confidence_weighted(F.col("dish"), F.col("note"), F.col("price"), LABELS)}
    return rows.select("p_partkey", *(F.round(c, 6).alias(p) for p, c in by.items()))


def _likelihood_sql(profile: str) -> str:
    p = profiles.LIKELIHOOD[profile]
    words, weight, most = p["food"]
    low, high = p["length"]
    bad, minus = p["excluded"]
    return f"CASE WHEN {match('x', p['prices'])} THEN {p['price']} ELSE 0 END + least({number('l', words)} * {weight}, {most}) + CASE WHEN length(x) BETWEEN {low} AND {high} THEN 1 ELSE 0 END + CASE WHEN {some('l', bad)} THEN {minus} ELSE 0 END AS {profile}"


@query(f"SELECT p_partkey, {', '.join(map(_likelihood_sql, profiles.LIKELIHOOD))} FROM {MENU}")
def t8_likelihood_profiles(t: Tables) -> DataFrame:
    """How like an item each line is, by every profile."""
    return menu(t).select("p_partkey", *(text.likelihood_by(F.col("x"), p).alias(p) for p in profiles.LIKELIHOOD))


NEEDS = {"final": f"{BASIC} > 0.2", "ml": "conf >= 0.4", "allergen": "conf >= 0.4", "website": f"({some('low', profiles.FOOD_WEBSITE)} OR price IS NOT NULL OR length(note) > 10)", "priority_final": f"({some('low', profiles.FOOD_PRIORITY_FINAL)} OR price IS NOT NULL)"}


def _valid_sql(profile: str) -> str:
    low, high, blocked, anchored = profiles.VALID[profile]
    return f"length(dish) BETWEEN {low} AND {high} AND NOT {some('low', blocked)} AND NOT {match('low', anchored)} AND {NEEDS.get(profile, 'TRUE')} AS {profile}"


@query(f"SELECT p_partkey, {', '.join(map(_valid_sql, profiles.VALID))} FROM {MENU}")
def f11_valid_profiles(t: Tables) -> DataFrame:
    """Which names could be an item's, by every profile."""
    return menu(t).select("p_partkey", *(text.valid_item_by(p, F.col("dish"), F.col("price"), F.col("note"), F.col("conf")).alias(p) for p in profiles.VALID))


def _score_sql(profile: str) -> str:
    p = profiles.FOOD_SCORE[profile]
    a, b, length = p["length"]
    patterns, price = p["prices"]
    least, _ = p["least"]
    why, names = p["names"]
    hits = [number("l", words) if p["each"] else f"{some('l', words)}::INT" for _, words, _ in p["tiers"]]
    total = " + ".join(f"{h} * {w}" for h, (_, _, w) in zip(hits, p["tiers"], strict=True))
    more = [("has_price", match("x", patterns), price), ("good_length", f"length(x) BETWEEN {a} AND {b}", length), ("proper_caps", "regexp_matches(x, '[A-Z][a-z]')", p["caps"])]
    more += [("multi_word", "len(list_filter(string_split_regex(trim(x), '\\s+'), lambda y: y <> '')) >= 2", p["several"])] * bool(p["several"])
    total += "".join(f" + CASE WHEN {c} THEN {w} ELSE 0 END" for _, c, w in more)
    if p["each"]:
        words = [f"CASE WHEN contains(l, {q(w)}) THEN {q(f'{tier}_{w}')} END" for tier, found, _ in p["tiers"] for w in found]
    else:
        words = ["CASE " + " ".join(f"WHEN contains(l, {q(w)}) THEN {q(f'{tier}_{w}')}" for w in found) + " END" for tier, found, _ in p["tiers"]]
    words += [f"CASE WHEN {c} THEN {q(k)} END" for k, c, _ in more]
    cases = [(f"length(x) < {least}", "too_short"), *((some("l", found), f"excluded_{kind}") for kind, found in p["excluded"])]
    cases += [(match("l", p["patterns"]), "excluded")] * bool(p["patterns"]) + [(f"l IN ({', '.join(map(q, names))})", why)] * bool(names)
    nothing = " ".join(f"WHEN {c} THEN 0" for c, _ in cases)
    reasons = " ".join(f"WHEN {c} THEN {q(r)}" for c, r in cases)
    return f"(CASE {nothing} ELSE least(round({total}, 9), 1.0) END)::DOUBLE AS {profile}_score, CASE {reasons} ELSE coalesce(nullif(concat_ws('_', {', '.join(words)}), ''), {q(p['none'])}) END AS {profile}_reason"


@query(f"SELECT p_partkey, {', '.join(map(_score_sql, profiles.FOOD_SCORE))} FROM {MENU}")
def f12_food_score_profiles(t: Tables) -> DataFrame:
    """Scores with all evidence and its reasons."""
    rows = menu(t).select("p_partkey", *(text.food_score_by(F.col("x"), p).alias(p) for p in profiles.FOOD_SCORE))
    return rows.select("p_partkey", *(F.col(p)[x].alias(f"{p}_{x}") for p in profiles.FOOD_SCORE for x in ("score", "reason")))


def _first(patterns: list[str], group: int) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(x, {q(p)}, {group}), '')" for p in patterns) + ")"


@query(f"""
WITH p AS (SELECT p_partkey, x, {_first(profiles.PRICE_PRIORITY, 0)} AS found, regexp_replace({_first(profiles.PRICE_PRIORITY, 1)}, '[^\\d.,]', '', 'g') AS price FROM {MENU}),
n AS (SELECT p_partkey, price, regexp_replace(regexp_replace(trim(regexp_replace(CASE WHEN found IS NULL THEN x ELSE replace(x, found, '') END, '\\s+', ' ', 'g')), '^[\\-•*]+\\s*', ''), '\\s*[\\-•*]+$', '') AS name FROM p),
c AS (SELECT *, contains(name, ' - ') AS dash, contains(name, '. ') AND length(name) > 30 AND length(string_split(name, '. ')[1]) < 50 AS stop FROM n WHERE length(name) >= 3)
SELECT p_partkey, price, CASE WHEN dash THEN trim(string_split(name, ' - ')[1]) WHEN stop THEN trim(string_split(name, '. ')[1]) ELSE name END AS name,
  CASE WHEN dash THEN trim(string_split(name, ' - ')[2]) WHEN stop THEN trim(string_split(name, '. ')[2]) END AS description FROM c
""")
def t11_parse_lines(t: Tables) -> DataFrame:
    """Names, prices and descriptions of lines with bullets, dashes and full stops."""
    return menu(t).select("p_partkey", text.parse_item_line(F.col("x")).alias("i")).filter("i is not null").select("p_partkey", "i.price", "i.name", "i.description")


STRIPPED = "x"
for _p in profiles.PRICE_DYNAMIC:
    STRIPPED = f"regexp_replace({STRIPPED}, {q(_p)}, '', 'g')"


@query(f"""
WITH n AS (SELECT p_partkey, {_first(profiles.PRICE_DYNAMIC, 1)} AS price, trim(regexp_replace(trim({STRIPPED}), '\\s*\\([^)]*\\)\\s*$', '')) AS name,
  coalesce({', '.join(f"nullif(trim(regexp_extract(x, {q('^([^$]+?)' + chr(92) + 's*' + p)}, 1)), '')" for p in profiles.PRICE_DYNAMIC)}) AS before FROM {MENU})
SELECT p_partkey, price, name, CASE WHEN before <> name THEN before END AS description FROM n WHERE length(name) >= 3
""")
def t11_parse_parens(t: Tables) -> DataFrame:
    """Names without prices and trailing parentheses."""
    return menu(t).select("p_partkey", text.parse_item_parens(F.col("x")).alias("i")).filter("i is not null").select("p_partkey", "i.price", "i.name", "i.description")


@query(f"""
SELECT p_partkey, trim(dish) AS first_name, CASE WHEN p_partkey % 2 = 0 THEN dish ELSE 'Plain Name Here' END AS best_name FROM {MENU}
""")
def t11_parse_blocks(t: Tables) -> DataFrame:
    """Names of blocks: the first line, or the best of three, where every second first line has a price."""
    rows = menu(t)
    lead = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("dish"), F.lit("\nx\n$4.50"))).otherwise(F.concat(F.col("dish"), F.lit(" $3.50\nPlain Name Here\n$9")))
    first, best = text.parse_item_block(lead), text.parse_item_block(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("dish"), F.lit("\nx\n$4.50"))).otherwise(F.lit("$3.50\nPlain Name Here\n$9")), 3)
    return rows.select("p_partkey", first["name"].alias("first_name"), best["name"].alias("best_name"))


PHRASES = ", ".join(f"regexp_extract_all(x, {q('(?i)' + p)}, 1)" for p in profiles.INGREDIENT_PHRASES)


@query(f"SELECT p_partkey, array_to_string(list_filter(list_transform(flatten([{PHRASES}]), lambda y: trim(y)), lambda y: length(y) BETWEEN 3 AND 49), ';') AS found FROM (SELECT p_partkey, dish || '. ' || note AS x FROM {MENU})")
def t5_ingredient_phrases(t: Tables) -> DataFrame:
    """What stands after "with" and alike."""
    return menu(t).select("p_partkey", F.array_join(text.ingredient_phrases(F.concat_ws(". ", "dish", "note")), ";").alias("found"))


def _allergen_sql(label: str) -> str:
    words = [(k, w * vocab.TIER_FACTOR[tier], f"{profiles.TIER_NAMES[tier]}: {k}") for tier, found in vocab.ALLERGENS[label].items() for k, w in found.items()]
    score = "greatest(" + ", ".join(f"CASE WHEN contains(whole, {q(k)}) THEN {w:.6f} ELSE 0 END" for k, w, _ in words) + ")::DOUBLE"
    return f"{score} AS s_{label}, concat_ws(', ', " + ", ".join(f"CASE WHEN contains(whole, {q(k)}) THEN {q(r)} END" for k, _, r in words) + f") AS r_{label}"


@query(f"""
WITH s AS (SELECT p_partkey, {', '.join(map(_allergen_sql, vocab.ALLERGENS))} FROM {MENU})
SELECT p_partkey, concat_ws(',', {', '.join(f"CASE WHEN s_{x} > 0.3 THEN '{x}=' || printf('%.3f', s_{x}) END" for x in sorted(vocab.ALLERGENS))}) AS scores,
  concat_ws(';', {', '.join(f"CASE WHEN s_{x} > 0.3 AND s_{x} < 0.6 THEN 'Low confidence detection for {x}: ' || r_{x} END" for x in vocab.ALLERGENS)}) AS warnings FROM s
""")
def t1a_t20_default_dictionary(t: Tables) -> DataFrame:
    """Labels of the default dictionary, and why the weak ones were found."""
    x = F.lower(F.concat_ws(" ", "dish", "note"))
    rows = menu(t).select("p_partkey", x.alias("x"), text.allergen_scores(x).alias("m"))
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"], 3))), ",")
    return rows.select("p_partkey", shown.alias("scores"), F.array_join(text.low_score_warnings(F.col("m"), text=F.col("x")), ";").alias("warnings"))


@query(f"""
SELECT n_labels AS page, round(avg(0.3 * (price IS NOT NULL)::INT + 0.3 * (length(note) > 10)::INT + 0.2 * (n_labels > 0)::INT + 0.2 * conf), 6)::DOUBLE AS weighted,
  round(avg(0.5 * conf + 0.3 * (price IS NOT NULL)::INT + 0.2 * (category <> 'other')::INT), 6)::DOUBLE AS shares, round(avg((conf + (price IS NOT NULL)::INT + (note <> '')::INT) / 3), 6)::DOUBLE AS mean FROM {MENU} GROUP BY 1
""")
def a13_quality_profiles(t: Tables) -> DataFrame:
    """Mean quality of pages by every formula."""
    rows, out = menu(t).withColumn("page", F.col("n_labels")), None
    for p in ("weighted", "shares", "mean"):
        one = metrics.extraction_quality(rows, ["page"], p, *map(F.col, ("price", "note", "labels", "category", "conf"))).select("page", F.round("quality", 6).alias(p))
        out = one if out is None else out.join(one, "page")
    return out


@query(f"""
SELECT count(*) AS total_items, count(*) FILTER (price IS NOT NULL) AS items_with_prices, count(*) FILTER (n_labels > 0) AS items_with_labels, round(avg(try_cast(regexp_replace(raw, '[$,]', '', 'g') AS DOUBLE)), 6) AS average_confidence,
  (SELECT string_agg(note_kind || '=' || n, ';' ORDER BY note_kind) FROM (SELECT coalesce(nullif(note, ''), 'unknown') AS note_kind, count(*) AS n FROM {MENU} GROUP BY 1)) AS methods
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN '$' || conf WHEN 1 THEN conf::VARCHAR ELSE 'high' END AS raw FROM {MENU})
""")
def a15_session_metrics(t: Tables) -> DataFrame:
    """Figures of a session, where some confidences are no numbers."""
    k, c = F.col("p_partkey") % 3, F.col("conf").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("$"), c)).when(k == 1, c).otherwise("high")
    out = metrics.session_metrics(menu(t), F.col("price"), F.col("labels"), raw, F.col("note"))
    methods = F.array_join(F.transform(F.map_entries("extraction_methods"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return out.select("total_items", "items_with_prices", "items_with_labels", F.round("average_confidence", 6).alias("average_confidence"), methods.alias("methods"))


@query("SELECT error, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'Timeout: page ' || event_id WHEN 1 THEN 'Blocked' WHEN 2 THEN event_type || ': x: y' END AS e FROM events) CROSS JOIN LATERAL (SELECT string_split(e, ':')[1] AS error) WHERE e IS NOT NULL GROUP BY 1")
def a14_error_histogram(t: Tables) -> DataFrame:
    """Rows of each class of error."""
    k = F.col("event_id") % 4
    e = F.when(k == 0, F.concat(F.lit("Timeout: page "), F.col("event_id").cast("string"))).when(k == 1, "Blocked").when(k == 2, F.concat(F.col("event_type"), F.lit(": x: y")))
    return metrics.error_histogram(t.events.withColumn("e", e), F.col("e"))


@query("SELECT round(count(*) FILTER (event_type = 'purchase' AND user_id % 4 > 0), 6)::BIGINT AS with_labels, round(avg(user_id % 4) FILTER (event_type = 'purchase'), 6) AS labels_per_success FROM events")
def a14_label_averages(t: Tables) -> DataFrame:
    """Labels a success."""
    out = metrics.run_metrics(t.events, F.col("event_type") == "purchase", F.col("user_id") % 9, F.col("value"), F.col("value") > 20, F.col("user_id") % 4)
    return out.select("with_labels", F.round("labels_per_success", 6).alias("labels_per_success"))


@query(f"""
WITH i AS (SELECT p_partkey % 40 AS place, CASE p_partkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS risk, CASE WHEN p_partkey % 3 = 0 THEN [] WHEN p_partkey % 2 = 0 THEN ['milk', 'eggs'] ELSE ['milk'] END AS labels FROM part),
b AS (SELECT place, count(*) AS n, count(*) FILTER (len(labels) > 0) AS w FROM i GROUP BY 1)
SELECT count(*) AS n_places, sum(n)::BIGINT AS n_items, round(count(*) FILTER (w > 0) * 100.0 / count(*), 6)::DOUBLE AS labelled_places_pct, round(sum(w) * 100.0 / sum(n), 6)::DOUBLE AS labelled_items_pct,
  (SELECT string_agg(r || '=' || c, ';' ORDER BY r) FROM (SELECT coalesce(risk, 'unknown') AS r, count(*) AS c FROM i GROUP BY 1)) AS risks,
  (SELECT string_agg(l || '=' || c, ';' ORDER BY c DESC, l) FROM (SELECT l, count(*) AS c FROM (SELECT unnest(labels) AS l FROM i) GROUP BY 1)) AS labels FROM b
""")
def a12_analysis_summary(t: Tables) -> DataFrame:
    """Totals, coverage, risks and frequent labels as one row."""
    k = F.col("p_partkey")
    labels = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 2 == 0, text.strings(["milk", "eggs"])).otherwise(text.strings(["milk"]))
    items = t.part.select((k % 40).alias("place"), F.when(k % 5 == 0, "high").when(k % 5 == 1, "low").alias("risk"), labels.alias("labels"))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    out = metrics.analysis_summary(items, "place", "risk", "labels")
    return out.select("n_places", "n_items", F.round("labelled_places_pct", 6).alias("labelled_places_pct"), F.round("labelled_items_pct", 6).alias("labelled_items_pct"), shown("risk_distribution").alias("risks"), shown("top_labels").alias("labels"))


LINK_TEXTS = ["Menu", "Our Menu", "Home", "Order online", "Food and drinks", "About", "Dining", "Eat here", "Specials of the week", ""]
LINK_ROWS = f"(SELECT p_partkey // 10 AS page, (p_partkey % 10)::INT AS pos, {_sql_list(LINK_TEXTS)}[p_partkey % 7 % 10 + 1] AS text, CASE p_partkey % 3 WHEN 0 THEN '/menu/' WHEN 1 THEN '/order?' ELSE '/x' END || p_partkey % 50 AS href FROM part)"


def link_rows(t: Tables) -> DataFrame:
    """Parts as links of pages."""
    k = F.col("p_partkey")
    label = F.element_at(text.strings(LINK_TEXTS), (k % 7 % 10).cast("int") + 1)
    href = F.concat(F.when(k % 3 == 0, "/menu/").when(k % 3 == 1, "/order?").otherwise("/x"), (k % 50).cast("string"))
    return t.part.select(F.floor(k / 10).alias("page"), (k % 10).cast("int").alias("pos"), label.alias("text"), href.alias("href"))


def _links_sql(profile: str) -> str:
    p = profiles.LINKS[profile]
    exact, points = p["exact"]
    parts, each = p["parts"]
    total = " + ".join(f"3 * {match('lower(text)', [x])}::INT + 2 * {match('lower(href)', [x])}::INT" for x in p["patterns"])
    return f"SELECT '{profile}' AS profile, page, pos, {total} + CASE WHEN lower(text) IN ({', '.join(map(q, exact))}) THEN {points} ELSE 0 END + {number('lower(href)', parts)} * {each} AS score FROM {LINK_ROWS} WHERE text <> ''"


@query("SELECT * FROM (" + " UNION ALL ".join(f"(SELECT * FROM ({_links_sql(p)}) WHERE score >= {profiles.LINKS[p]['least']})" for p in profiles.LINKS) + ")")
def s5_rank_links_profiles(t: Tables) -> DataFrame:
    """Links that score, by every profile."""
    each = [extract.rank_links_by(link_rows(t), p).select(F.lit(p).alias("profile"), "page", "pos", "score") for p in profiles.LINKS]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"""
WITH d AS (SELECT page, href, min(pos) AS pos FROM {LINK_ROWS} WHERE text <> '' AND {some('lower(text)', profiles.LINK_WORDS)} AND length(text) < 50 GROUP BY 1, 2)
SELECT page, href, pos FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS r FROM d) WHERE r <= 5
""")
def s5_word_links(t: Tables) -> DataFrame:
    """The first five addresses of links with a menu word."""
    return extract.word_links(link_rows(t), "page")


@query(f"""
SELECT p_partkey, name, price FROM (SELECT p_partkey, trim(regexp_extract(x, '([A-Z][A-Za-z ,&''-]{{2,60}}?)[ .]*\\$(\\d+(?:\\.\\d{{2}})?)', 1)) AS name, regexp_extract(x, '([A-Z][A-Za-z ,&''-]{{2,60}}?)[ .]*\\$(\\d+(?:\\.\\d{{2}})?)', 2) AS price FROM {MENU})
WHERE price <> '' AND length(name) > 5 AND {some('lower(name)', profiles.FOOD_PAIRS)} AND NOT {some('lower(name)', profiles.PAIR_STOP)}
""")
def p5_food_pairs(t: Tables) -> DataFrame:
    """Names and prices of food in text."""
    return extract.name_price_pairs(menu(t), "p_partkey", F.col("x"), needs=profiles.FOOD_PAIRS, without=profiles.PAIR_STOP, longer=5).drop("pos")


REVIEW = "'We ordered the ' || low || '. It was ' || CASE p_partkey % 3 WHEN 0 THEN 'delicious' WHEN 1 THEN 'great, $12' ELSE 'slow service' END"


@query(f"""
SELECT p_partkey, round(least(greatest(0.5 + 0.1 * {number('r', profiles.CUES)} + CASE WHEN regexp_matches(r, '\\$\\d+') THEN 0.2 ELSE 0 END + CASE WHEN {some('low', [w for _, x in profiles.CATEGORY_REVIEWS for w in x])} THEN 0.15 ELSE 0 END - CASE WHEN {some('low', profiles.NOT_FOOD)} THEN 0.3 ELSE 0 END, 0), 1), 6)::DOUBLE AS confidence
FROM (SELECT p_partkey, low, {REVIEW} AS r FROM {MENU})
""")
def p8_mention_confidence(t: Tables) -> DataFrame:
    """How sure a dish in a review is."""
    k = F.col("p_partkey") % 3
    review = F.concat(F.lit("We ordered the "), F.lower("dish"), F.lit(". It was "), F.when(k == 0, "delicious").when(k == 1, "great, $12").otherwise("slow service"))
    return menu(t).select("p_partkey", F.round(extract.mention_confidence(F.col("dish"), review), 6).alias("confidence"))


@query("""
WITH c AS (SELECT event_id, user_id % 20 AS page, event_type AS name, CASE WHEN event_id % 3 > 0 THEN 'other' ELSE 'c' || event_id % 4 END AS category, (event_id % 5)::BIGINT AS prio, round(value, 1) / 1000 AS conf FROM events)
SELECT page, name, coalesce(first(category ORDER BY conf DESC, prio DESC, event_id) FILTER (category <> 'other'), 'other') AS category, count(*)::INT AS n_candidates FROM c GROUP BY page, name
""")
def w2_skip_other(t: Tables) -> DataFrame:
    """Merged candidates take the first category that is not the default."""
    i = F.col("event_id")
    rows = t.events.select(i, (F.col("user_id") % 20).alias("page"), F.col("event_type").alias("name"), F.when(i % 3 > 0, "other").otherwise(F.concat(F.lit("c"), (i % 4).cast("string"))).alias("category"), (i % 5).alias("prio"), (F.round("value", 1) / 1000).alias("conf"), F.array(F.lit("x")).alias("labels"))
    return dedupe.merge_candidates(rows, ["page", "name"], ["category"], "prio", "conf", "labels", "event_id", skip={"category": "other"}).select("page", "name", "category", "n_candidates")



@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'cash' END, CASE WHEN c_custkey % 3 = 0 THEN 'credit_cards' END) AS payment FROM customer")
def t17_tag_flags(t: Tables) -> DataFrame:
    """Tags with the value yes."""
    k = F.col("c_custkey")
    tags = F.create_map(F.lit("payment:cash"), F.when(k % 2 == 0, "yes").otherwise("no"), F.lit("payment:credit_cards"), F.when(k % 3 == 0, "yes").otherwise("only"), F.lit("name"), F.lit("yes"))
    return t.customer.select("c_custkey", F.array_join(text.tag_flags(tags, PAYMENT), ",").alias("payment"))
