"""Queries of the text functions. The vocabulary is one that the given texts have; functions take any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantryline.functions import text, vocab
from pantryline.operators import dedupe
from pantryline.plans.base import Tables, query

WORDS = {"warm": {"primary": {"red": 1.0, "hot": 0.9}, "secondary": {"ring": 0.5}, "dishes": {"rod": 0.6}}, "cool": {"primary": {"blue": 0.9}, "secondary": {"cold": 0.8}, "dishes": {"old": 0.4}}}
LISTS = {"warm": ["red", "hot"], "round": ["ring", "gear", "large"]}
CATS = [("metal", ["bolt", "rod", "gear"]), ("round", ["ring", "plate"])]



def _scores(m: object) -> object:
    """``label=score`` for each, in the order of labels."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"], 3))), ",")


@query("""
WITH s AS (SELECT p_partkey, greatest(CASE WHEN contains(p_name, 'red') THEN 0.9 ELSE 0 END, CASE WHEN contains(p_name, 'hot') THEN 0.81 ELSE 0 END, CASE WHEN contains(p_name, 'ring') THEN 0.35 ELSE 0 END, CASE WHEN contains(p_name, 'rod') THEN 0.36 ELSE 0 END) AS warm,
  greatest(CASE WHEN contains(p_name, 'blue') THEN 0.81 ELSE 0 END, CASE WHEN contains(p_name, 'cold') THEN 0.56 ELSE 0 END, CASE WHEN contains(p_name, 'old') THEN 0.24 ELSE 0 END) AS cool FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN cool > 0.3 THEN 'cool=' || printf('%.3f', cool::DOUBLE) END, CASE WHEN warm > 0.3 THEN 'warm=' || printf('%.3f', warm::DOUBLE) END) AS scores,
  CASE WHEN greatest(warm, cool) <= 0.3 THEN 'low' WHEN greatest(warm, cool) > 0.8 THEN 'high' WHEN greatest(warm, cool) > 0.5 THEN 'medium' ELSE 'unknown' END AS risk FROM s
""")
def t1a_t4_tiered_scores(t: Tables) -> DataFrame:
    """Weighted labels, and the risk that follows."""
    s = text.allergen_scores(F.lower("p_name"), WORDS)
    return t.part.select("p_partkey", s.alias("m")).select("p_partkey", _scores(F.col("m")).alias("scores"), text.risk_by_score(F.col("m")).alias("risk"))


@query("SELECT p_partkey, CASE WHEN (contains(p_name, 'red')::INT + contains(p_name, 'hot')::INT) * 0.8 * 0.9 + contains(p_name, 'ring')::INT * 0.4 * 0.9 >= 0.5 THEN 'warm' ELSE '' END AS labels FROM part")
def t1b_counted(t: Tables) -> DataFrame:
    """Labels by weighted hits."""
    return t.part.select("p_partkey", F.array_join(text.allergens_counted(F.lower("p_name"), {"warm": (["red", "hot"], ["ring"], 0.9)}), ",").alias("labels"))


@query("""
WITH h AS (SELECT p_partkey, contains(p_name, 'ring')::INT AS a, contains(p_name, 'gear')::INT AS b, contains(p_name, 'large')::INT AS c, contains(p_name, 'red')::INT AS r, contains(p_name, 'hot')::INT AS o FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN a + b + c > 0 THEN 'round=' || printf('%.3f', CASE WHEN a + b + c > 1 THEN 0.95 ELSE 0.9 END::DOUBLE) END, CASE WHEN r + o > 0 THEN 'warm=0.900' END) AS scores FROM h
""")
def t1c_boosted(t: Tables) -> DataFrame:
    """Boosted labels: names are whole words here, so a hit scores 0.9 and a second one more."""
    return t.part.select("p_partkey", _scores(text.allergen_boosted(F.lower("p_name"), LISTS)).alias("scores"))


@query("""
WITH h AS (SELECT p_partkey, contains(' ' || p_name || ' ', ' red ')::INT AS a, contains(' ' || p_name || ' ', ' ring ')::INT AS b, contains(' ' || p_name || ' ', ' old ')::INT AS c FROM part),
s AS (SELECT p_partkey, CASE WHEN a > 0 THEN 0.9 WHEN b > 0 THEN 0.7 WHEN c > 0 THEN 0.6 ELSE 0 END + CASE WHEN a + b + c > 1 THEN 0.1 ELSE 0 END AS s FROM h)
SELECT p_partkey, CASE WHEN s >= 0.6 THEN 'x=' || printf('%.3f', least(s, 0.95)::DOUBLE) ELSE '' END AS scores FROM s
""")
def t1d_word_tiers(t: Tables) -> DataFrame:
    """Labels by whole words in tiers."""
    return t.part.select("p_partkey", _scores(text.allergen_word_tiers(F.lower("p_name"), {"x": [["red"], ["ring"], ["old"]]})).alias("scores"))


@query("""
SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'thing') THEN 'en' END, CASE WHEN contains(lower(text), 'keit') THEN 'de' END) AS labels,
  concat_ws(',', CASE WHEN (regexp_matches(lower(text), '\\bthe\\b')::INT + regexp_matches(lower(text), '\\band\\b')::INT) > (regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])que($|[^\\p{L}\\p{N}_])')::INT + regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])die($|[^\\p{L}\\p{N}_])')::INT) THEN 'english' END) AS tags FROM documents
""")
def t1e_t2_labels_and_tags(t: Tables) -> DataFrame:
    """Substring labels, and tags by more positive than negative patterns."""
    d = t.documents.select("doc_id", F.lower("text").alias("x"))
    labels = text.labels_any(F.col("x"), {"en": ["thing"], "de": ["keit"]})
    tags = text.dietary_tags(F.col("x"), {"english": ([r"\bthe\b", r"\band\b"], [r"\bque\b", r"\bdie\b"])})
    return d.select("doc_id", F.array_join(labels, ",").alias("labels"), F.array_join(tags, ",").alias("tags"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'red.ring|red.rod') THEN 'warm' ELSE '' END AS safe, regexp_matches(p_name, '\\b(gear|bolt)\\b') AS steel FROM part")
def t3_t5_claims_and_hints(t: Tables) -> DataFrame:
    """Labels that a text claims, and flags."""
    x = F.lower("p_name")
    return t.part.select("p_partkey", F.array_join(text.free_claims(x, {"warm": ["red.ring", "red.rod"]}), ",").alias("safe"), text.nutrition_hints(x, {"steel": r"\b(gear|bolt)\b"})["steel"].alias("steel"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(lower(text), '\\b(the|and|of)\\b', 1), regexp_extract_all(lower(text), '\\b(thing|with|was)\\b', 1)))), ',') AS found FROM documents")
def t5_ingredients(t: Tables) -> DataFrame:
    """Distinct words of a vocabulary in each text."""
    return t.documents.select("doc_id", F.array_join(text.ingredients(F.lower("text"), [r"\b(the|and|of)\b", r"\b(thing|with|was)\b"]), ",").alias("found"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'bolt') OR contains(p_name, 'rod') OR contains(p_name, 'gear') THEN 'metal' WHEN contains(p_name, 'ring') OR contains(p_name, 'plate') THEN 'round' ELSE 'other' END AS category FROM part")
def t6_category(t: Tables) -> DataFrame:
    """The first category that fits."""
    return t.part.select("p_partkey", text.category(F.col("p_name"), CATS).alias("category"))


@query("SELECT doc_id, round(least(0.5 + CASE WHEN regexp_matches(text, '\\$\\d+') THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(text), 'trash') THEN 0.1 ELSE 0 END + CASE WHEN length(text) BETWEEN 20 AND 150 THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(text), 'with') OR contains(lower(text), 'thing') THEN 0.1 ELSE 0 END, 1.0), 4)::DOUBLE AS confidence FROM documents")
def t7_confidence(t: Tables) -> DataFrame:
    """Added evidence."""
    c = text.confidence(F.col("text"), F.col("text").rlike(r"\$\d+"), F.contains(F.lower("text"), F.lit("trash")), ["with", "thing"])
    return t.documents.select("doc_id", F.round(c, 4).alias("confidence"))


LINES = "(SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"


def lines(t: Tables) -> DataFrame:
    """Lines of all documents."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(f"SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '\\$\\d+') THEN 4 ELSE 0 END + contains(lower(line), 'thing')::INT + contains(lower(line), 'with')::INT + CASE WHEN length(line) BETWEEN 10 AND 100 THEN 1 ELSE 0 END AS score FROM {LINES}")
def t8_item_likelihood(t: Tables) -> DataFrame:
    """How like an item each line is."""
    return lines(t).select("doc_id", "line_no", text.item_likelihood(F.col("line"), ["thing", "with"]).alias("score"))


MONEY = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'soup $' || (o_orderkey % 250) || '.50' WHEN o_orderkey % 3 = 1 THEN 'tea ' || (o_orderkey % 90) || ' dollars' ELSE 'cake' END AS x FROM orders)"


def money(t: Tables) -> DataFrame:
    """Orders as texts with prices of three kinds."""
    k = F.col("o_orderkey")
    x = F.when(k % 3 == 0, F.concat(F.lit("soup $"), (k % 250).cast("string"), F.lit(".50"))).when(k % 3 == 1, F.concat(F.lit("tea "), (k % 90).cast("string"), F.lit(" dollars"))).otherwise("cake")
    return t.orders.select("o_orderkey", x.alias("x"))


@query(f"""
WITH p AS (SELECT o_orderkey, x, coalesce(nullif(regexp_extract(x, '\\$(\\d+\\.\\d\\d)', 1), ''), nullif(regexp_extract(x, '(\\d+) dollars', 1), '')) AS price FROM {MONEY})
SELECT o_orderkey, price, CASE WHEN try_cast(price AS DOUBLE) BETWEEN 1 AND 200 THEN price END AS plausible, try_cast(price AS DOUBLE) AS value FROM p
""")
def t9_t10_prices(t: Tables) -> DataFrame:
    """Prices in texts: the first pattern, a plausible one, and its number."""
    patterns = [r"\$(\d+\.\d\d)", r"(\d+) dollars"]
    out = money(t).select("o_orderkey", text.extract_price(F.col("x"), patterns).alias("price"), text.extract_price(F.col("x"), patterns, 1, 200).alias("plausible"))
    return out.withColumn("value", text.parse_price(F.col("price")))


@query(f"""
WITH p AS (SELECT o_orderkey, regexp_replace(trim(regexp_replace(x, '\\$[\\d,]+(?:\\.\\d{{2}})?', '', 'g')), '\\s+', ' ', 'g') AS name, nullif(regexp_extract(x, '\\$([\\d,]+(?:\\.\\d{{2}})?)', 1), '') AS price FROM {MONEY})
SELECT o_orderkey, name, price FROM p WHERE length(name) >= 3
""")
def t11_parse_item(t: Tables) -> DataFrame:
    """Names and prices of item texts."""
    return money(t).select("o_orderkey", text.parse_item(F.col("x")).alias("i")).filter("i is not null").select("o_orderkey", "i.name", "i.price")


@query("""
WITH n AS (SELECT c_custkey, lower(c_name) || CASE c_custkey % 4 WHEN 0 THEN ' bar grill' WHEN 1 THEN ' & sons restaurant' WHEN 2 THEN '-place' ELSE ' the house place' END AS x FROM customer),
k AS (SELECT c_custkey, x, CASE c_custkey % 4 WHEN 0 THEN regexp_replace(x, ' bar grill$', ' bar') WHEN 1 THEN regexp_replace(x, ' restaurant$', '') WHEN 2 THEN x ELSE regexp_replace(x, ' place$', '') END AS y FROM n)
SELECT c_custkey, trim(regexp_replace(regexp_replace(CASE WHEN c_custkey % 4 = 3 THEN y ELSE y END, '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key_a,
  replace(replace(replace(x, '''', ''), '-', ' '), '&', 'and') AS key_b, regexp_replace(x, '[\\s\\-''"]', '', 'g') AS key_c FROM k
""")
def t12_name_keys(t: Tables) -> DataFrame:
    """Keys of names. A suffix goes only in its turn: of ``x bar grill`` the ``bar`` stays, as its turn is over."""
    k = F.col("c_custkey") % 4
    x = F.concat(F.lower("c_name"), F.when(k == 0, " bar grill").when(k == 1, " & sons restaurant").when(k == 2, "-place").otherwise(" the house place"))
    return t.customer.select("c_custkey", text.name_key(x).alias("key_a"), text.name_key_plain(x).alias("key_b"), text.name_key_squashed(x).alias("key_c"))


@query("SELECT c_custkey, CASE WHEN length(d) = 11 AND d LIKE '1%' THEN substr(d, 2) ELSE d END AS phone FROM (SELECT c_custkey, regexp_replace(CASE WHEN c_custkey % 2 = 0 THEN '+1 (312) 555-' ELSE '312.555.' END || lpad((c_custkey % 10000)::VARCHAR, 4, '0'), '\\D', '', 'g') AS d FROM customer)")
def t13_phone_key(t: Tables) -> DataFrame:
    """Keys of phone numbers."""
    k = F.col("c_custkey")
    x = F.concat(F.when(k % 2 == 0, "+1 (312) 555-").otherwise("312.555."), F.lpad((k % 10000).cast("string"), 4, "0"))
    return t.customer.select("c_custkey", text.phone_key(x).alias("phone"))


@query("""
WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT a, b, round(1.0 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)), 6) AS name_similarity,
  round(len(list_intersect(string_split(x, ' '), string_split(y, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))), 6) AS jaccard FROM p
""")
def t14_t15_similarity(t: Tables) -> DataFrame:
    """Edit and word similarity of neighbouring names."""
    a = t.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), F.col("p_name").alias("x"))
    b = t.part.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "b").select("a", "b", F.round(text.name_similarity(x, y), 6).alias("name_similarity"), F.round(text.token_jaccard(F.split(x, " "), F.split(y, " ")), 6).alias("jaccard"))


@query("SELECT s_suppkey, nullif(concat_ws(', ', CASE WHEN s_suppkey % 3 > 0 THEN concat_ws(' ', s_suppkey::VARCHAR, 'Main St') END, 'City' || s_nationkey, CASE WHEN s_suppkey % 5 > 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'IL 606' ELSE 'IL' END END), '') AS address FROM supplier")
def t16_address(t: Tables) -> DataFrame:
    """Addresses of what parts are given."""
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", text.build_address(k.cast("string"), F.when(k % 3 > 0, "Main St"), F.concat(F.lit("City"), F.col("s_nationkey").cast("string")), F.when(k % 5 > 0, "IL"), F.when(k % 2 == 0, "606")).alias("address"))


@query("SELECT event_id, md5('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS checksum FROM events")
def t19_checksum(t: Tables) -> DataFrame:
    """Checksums of rows."""
    return t.events.select("event_id", text.row_checksum("user_id", "event_type").alias("checksum"))


@query("SELECT c_custkey, round(((c_acctbal > 0)::INT + (c_mktsegment IS NOT NULL)::INT + (c_nationkey > 3)::INT) / 10.0, 4)::DOUBLE AS quality FROM customer")
def t18_place_quality(t: Tables) -> DataFrame:
    """Points for what is given."""
    return t.customer.select("c_custkey", F.round(text.place_quality(a=F.col("c_acctbal") > 0, b=F.col("c_mktsegment").isNotNull(), c=F.col("c_nationkey") > 3), 4).alias("quality"))


@query(f"SELECT doc_id, line_no FROM {LINES} WHERE length(line) BETWEEN 5 AND 80 AND NOT (contains(lower(line), 'trash') OR contains(lower(line), 'license')) AND NOT regexp_matches(lower(line), '^the')")
def f11_valid_items(t: Tables) -> DataFrame:
    """Lines that could be an item's name."""
    return lines(t).filter(text.valid_item(F.col("line"), 5, 80, ["trash", "license"], ["^the"])).select("doc_id", "line_no")


@query("""
WITH h AS (SELECT p_partkey, p_name, contains(p_name, 'old') AS out, contains(p_name, 'red')::INT + contains(p_name, 'hot')::INT AS a, contains(p_name, 'ring')::INT + contains(p_name, 'gear')::INT AS b FROM part)
SELECT p_partkey, CASE WHEN out THEN 0.0 ELSE round(a * 0.3 + b * 0.2, 4) END::DOUBLE AS score, CASE WHEN out THEN 'excluded' ELSE concat_ws('_', CASE WHEN a > 0 THEN 'strong' END, CASE WHEN b > 0 THEN 'weak' END) END AS reason FROM h
""")
def f12_food_score(t: Tables) -> DataFrame:
    """Scores of evidence, with the reason."""
    s = text.food_score(F.col("p_name"), ["old"], [("strong", ["red", "hot"], 0.3), ("weak", ["ring", "gear"], 0.2)], True, 0.3)
    return t.part.select("p_partkey", s.alias("s")).select("p_partkey", F.round("s.score", 4).alias("score"), "s.reason")


@query("SELECT s_suppkey, s_name FROM supplier WHERE NOT regexp_matches(lower(s_name), '5$') AND (regexp_matches(s_name, '#0+1') OR contains(lower(s_name), '77'))")
def f13_potential_items(t: Tables) -> DataFrame:
    """Names by excluded and wanted patterns (a name of one word is no title)."""
    return t.supplier.filter(text.potential_item(F.col("s_name"), ["5$"], ["#0+1"], ["77"])).select("s_suppkey", "s_name")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') OR contains(lower(text), 'keit')")
def f14_food_related(t: Tables) -> DataFrame:
    """Texts with any of some words."""
    return t.documents.filter(text.any_hit(F.lower("text"), ["thing", "keit"])).select("doc_id")


@query(f"""
WITH i AS (SELECT doc_id, line_no, line, length(line) % 10 / 10.0 AS conf FROM {LINES})
SELECT doc_id, line_no FROM (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, line_no) AS r FROM i) WHERE r <= 5
""")
def w5_s7_top_lines(t: Tables) -> DataFrame:
    """The five most confident lines of each document."""
    rows = lines(t).withColumn("conf", (F.length("line") % 10) / 10.0)
    return dedupe.top_n(rows, ["doc_id"], [F.desc("conf"), F.col("line_no")], 5).select("doc_id", "line_no")


SETS = ["['nuts', 'dairy']", "['dairy']", "['fish']", "[]", "['eggs', 'soy']", "['soy']"]


@query(f"SELECT p_partkey, {', '.join(f'CASE WHEN len(list_intersect(l, {high!r})) > 0 THEN ' + chr(39) + 'high' + chr(39) + f' WHEN len(list_intersect(l, {medium!r})) > 0 THEN ' + chr(39) + 'medium' + chr(39) + ' ELSE ' + chr(39) + 'low' + chr(39) + f' END AS {name}' for name, (high, medium) in vocab.RISK_SETS.items())} FROM (SELECT p_partkey, CASE p_partkey % 6 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(SETS))} END::VARCHAR[] AS l FROM part)")
def t4_risk_by_labels(t: Tables) -> DataFrame:
    """Risks by which labels an item has, for both profiles."""
    each = [F.expr(f"cast(array({x[1:-1]}) as array<string>)") for x in SETS]
    labels = F.element_at(F.array(*each), (F.col("p_partkey") % len(SETS) + 1).cast("int"))
    return t.part.select("p_partkey", *(text.risk_by_labels(labels, p).alias(p) for p in vocab.RISK_SETS))


METHODS = ["Fried rice", "a BBQ plate", "oven-baked bread", "steamed", "grilled and smoked", "tempura roll", "raw", ""]


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(x, '\\bfried\\b|\\btempura\\b') THEN 'fried' END, CASE WHEN regexp_matches(x, '\\bgrilled\\b|\\bbbq\\b') THEN 'grilled' END, CASE WHEN regexp_matches(x, '\\bbaked\\b') THEN 'baked' END) AS found
FROM (SELECT p_partkey, lower(['Fried rice', 'a BBQ plate', 'oven-baked bread', 'steamed', 'grilled and smoked', 'tempura roll', 'raw', ''][p_partkey % 8 + 1]) AS x FROM part)
""")
def t5_preparation(t: Tables) -> DataFrame:
    """How dishes are made: three of the methods."""
    x = F.lower(F.element_at(text.strings(METHODS), (F.col("p_partkey") % len(METHODS) + 1).cast("int")))
    found = text.preparation(x, {k: vocab.PREPARATION[k] for k in ("fried", "grilled", "baked")})
    return t.part.select("p_partkey", F.array_join(F.filter(F.array(F.lit("fried"), F.lit("grilled"), F.lit("baked")), lambda k: F.array_contains(found, k)), ",").alias("found"))


@query("SELECT c_custkey, trim(regexp_replace(regexp_replace(x, '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS every, trim(regexp_replace(regexp_replace(' ' || regexp_replace(regexp_replace(x, '[^a-z0-9\\s]', '', 'g'), '\\s+', '  ', 'g') || ' ', ' (the|of) ', ' ', 'g'), '\\s+', ' ', 'g')) AS kept FROM (SELECT c_custkey, lower(CASE c_custkey % 3 WHEN 0 THEN 'The House of ' WHEN 1 THEN 'Of the-sea  ' ELSE 'theatre, ' END || c_name) AS x FROM customer)")
def t12_name_words(t: Tables) -> DataFrame:
    """Words of names, all and without stop words."""
    k = F.col("c_custkey") % 3
    name = F.concat(F.when(k == 0, "The House of ").when(k == 1, "Of the-sea  ").otherwise("theatre, "), "c_name")
    return t.customer.select("c_custkey", text.name_key_words(name).alias("every"), text.name_key_words(name, ["the", "of"]).alias("kept"))


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE CASE p_partkey % 3 WHEN 1 THEN 0.9 ELSE 0.7 END * CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 ELSE 0.5 END END, 6)::DOUBLE AS confidence FROM part")
def t7_item_confidence(t: Tables) -> DataFrame:
    """Confidence from scores and risk; without scores a half."""
    k = F.col("p_partkey")
    scores = F.when(k % 3 == 0, F.expr("cast(map() as map<string, double>)")).when(k % 3 == 1, F.create_map(F.lit("a"), F.lit(0.9))).otherwise(F.create_map(F.lit("a"), F.lit(0.9), F.lit("b"), F.lit(0.5)))
    risk = F.element_at(F.array(*(F.lit(x) for x in ("high", "medium", "low", "unknown", "other"))), (k % 5 + 1).cast("int"))
    return t.part.select("p_partkey", F.round(text.item_confidence(scores, risk), 6).alias("confidence"))
