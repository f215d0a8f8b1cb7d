"""Queries of the serving side: suppliers are places, order lines their items, return flags their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantryline.functions import geo, text
from pantryline.operators import metrics, serve
from pantryline.plans.base import Tables, query

ITEM = ["l_orderkey", "l_linenumber"]


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def f1_eq_filters(t: Tables) -> DataFrame:
    """Places of a city and cuisine."""
    return serve.eq_filters(t.customer, c_mktsegment="BUILDING", c_nationkey=3, c_name=None).select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey = 7")
def f2_place_by_id(t: Tables) -> DataFrame:
    """One place."""
    return serve.eq_filters(t.supplier, s_suppkey=7).select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'R'")
def f3_items_of_place(t: Tables) -> DataFrame:
    """Items of a place and category."""
    return serve.eq_filters(t.lineitem, l_suppkey=7, l_returnflag="R").select(*ITEM, "l_partkey")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'thing') OR contains(lower(source), 'thing')")
def f4_search_text(t: Tables) -> DataFrame:
    """A term in either of two columns."""
    return serve.search_text(t.documents, "Thing", "text", "source").select("doc_id", "source")


LABELLED = "WITH g AS (SELECT l_partkey, list_sort(list(DISTINCT l_returnflag)) AS labels FROM lineitem GROUP BY l_partkey), x AS (SELECT p_partkey, p_name, p_type, coalesce(labels, []) AS labels FROM part LEFT JOIN g ON l_partkey = p_partkey)"


def labelled_parts(t: Tables) -> DataFrame:
    """Parts with the return flags that their lines have."""
    links = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("label"))
    return serve.items_with_details(t.part, [(links, "label")], "p_partkey")


FINE = LABELLED.replace("l_returnflag", "l_returnflag || l_linenumber")


def finely_labelled(t: Tables) -> DataFrame:
    """Parts with the return flags and line numbers that their lines have: labels that not every part has."""
    links = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("label"))
    return serve.items_with_details(t.part, [(links, "label")], "p_partkey")


@query(f"{FINE} SELECT p_partkey, p_name FROM x WHERE NOT list_contains(labels, 'R1')")
def f5_exclude_labels(t: Tables) -> DataFrame:
    """Items without a label."""
    return serve.exclude_labels(finely_labelled(t), "labels", ["R1"]).select("p_partkey", "p_name")


@query(f"{LABELLED} SELECT p_partkey, p_name FROM x WHERE list_contains(labels, 'R') AND list_contains(labels, 'A')")
def f6_require_labels(t: Tables) -> DataFrame:
    """Items with all of some labels."""
    return serve.require_labels(labelled_parts(t), "labels", ["R", "A"]).select("p_partkey", "p_name")


@query(f"{FINE} SELECT p_partkey, p_name, p_type FROM x WHERE contains(lower(p_name), 'e') AND NOT list_contains(labels, 'N2') AND p_type = 'SMALL' ORDER BY p_partkey LIMIT 50")
def f7_search_menu(t: Tables) -> DataFrame:
    """The search request: all conditions, and then the first 50."""
    found = serve.exclude_labels(serve.search_text(finely_labelled(t), "E", "p_name"), "labels", ["N2"])
    return serve.eq_filters(found, p_type="SMALL").orderBy("p_partkey").limit(50).select("p_partkey", "p_name", "p_type")


@query("SELECT event_type, count(*) FILTER (value IS NOT NULL AND value <> 0) AS n_given, count(*) AS n FROM events GROUP BY event_type")
def f8_present(t: Tables) -> DataFrame:
    """How many values count as given."""
    return t.events.groupBy("event_type").agg(F.count_if(text.present(F.col("value"), "number")).alias("n_given"), F.count("*").alias("n"))


POINTS = "(SELECT s_suppkey, 41.65 + (s_suppkey * 37 % 1000) * 0.0003 AS lat, -87.90 + (s_suppkey * 91 % 1000) * 0.0003 AS lon FROM supplier)"


def points(t: Tables) -> DataFrame:
    """Suppliers with coordinates that follow from their keys."""
    k = F.col("s_suppkey")
    return t.supplier.withColumns({"lat": 41.65 + (k * 37 % 1000) * 0.0003, "lon": -87.90 + (k * 91 % 1000) * 0.0003})


@query(f"SELECT s_suppkey FROM {POINTS} WHERE lat BETWEEN 41.70 AND 41.85 AND lon BETWEEN -87.85 AND -87.70")
def f9_in_box(t: Tables) -> DataFrame:
    """Places of a box."""
    return points(t).filter(geo.in_box(F.col("lat"), F.col("lon"), 41.70, -87.85, 41.85, -87.70)).select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)RED|blue') AND p_type IN ('SMALL', 'LARGE')")
def f10_tag_regex(t: Tables) -> DataFrame:
    """A tag that matches, within some classes."""
    return t.part.filter(F.col("p_name").rlike("(?i)RED|blue") & F.col("p_type").isin("SMALL", "LARGE")).select("p_partkey")


@query("SELECT s_suppkey, s_name, coalesce(n, 0) AS n_items, last_update FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, max(l_shipdate) AS last_update FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def a1_place_summary(t: Tables) -> DataFrame:
    """Items of each place, and when the last changed."""
    items = t.lineitem.withColumnRenamed("l_suppkey", "s_suppkey")
    return serve.place_summary(t.supplier, items, "s_suppkey", "l_shipdate").select("s_suppkey", "s_name", "n_items", "last_update")


@query(f"{LABELLED} SELECT p_partkey, array_to_string(labels, ',') AS labels FROM x")
def a2_items_with_details(t: Tables) -> DataFrame:
    """Items with their labels."""
    return labelled_parts(t).select("p_partkey", F.array_join("labels", ",").alias("labels"))


@query("""
WITH p AS (SELECT l_suppkey, count(*) AS n_items, count(l_returnflag) AS n_labelled, round(avg(l_extendedprice), 4) AS avg_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1),
c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY ALL),
b AS (SELECT l_suppkey, count(*) AS n_labels, string_agg(l_returnflag || '=' || n, ';' ORDER BY l_returnflag) AS breakdown FROM c GROUP BY 1)
SELECT s_suppkey, coalesce(n_items, 0) AS n_items, coalesce(n_labelled, 0) AS n_labelled, avg_price, min_price, max_price, coalesce(n_labels, 0) AS n_labels, breakdown
FROM supplier LEFT JOIN p ON p.l_suppkey = s_suppkey LEFT JOIN b ON b.l_suppkey = s_suppkey
""")
def a3_place_stats(t: Tables) -> DataFrame:
    """Counts, prices and labels of each place."""
    lines = t.lineitem.withColumnRenamed("l_suppkey", "s_suppkey")
    out = serve.place_stats(t.supplier, lines, lines, "s_suppkey", ITEM, "l_extendedprice", "l_returnflag")
    split = F.array_join(F.transform(F.map_entries("breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return out.select("s_suppkey", "n_items", "n_labelled", F.round("avg_price", 4).alias("avg_price"), "min_price", "max_price", "n_labels", split.alias("breakdown"))


@query("SELECT s_suppkey, n_name, coalesce(n_parts, 0) AS n_parts FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def j6_star_views(t: Tables) -> DataFrame:
    """Inner and left joins of the star."""
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("l_partkey").alias("n_parts"))
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(n, "s_suppkey", "left").select("s_suppkey", "n_name", F.coalesce("n_parts", F.lit(0)).alias("n_parts"))


@query("SELECT DISTINCT doc_id, n_nationkey FROM (SELECT doc_id, unnest(['NATION_' || (doc_id % 30), 'NATION_' || (doc_id % 7)]) AS name FROM documents) JOIN nation ON n_name = name")
def j7_dim_lookup(t: Tables) -> DataFrame:
    """Names to ids; unknown names give nothing."""
    name = lambda n: F.concat(F.lit("NATION_"), (F.col("doc_id") % n).cast("string"))
    return serve.dim_lookup(t.documents.select("doc_id", F.array(name(30), name(7)).alias("names")), "names", t.nation, "n_name", "n_nationkey", "doc_id")


@query("SELECT d.doc_id, coalesce('q' || l.quality, d.source) AS source, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j8_enrich(t: Tables) -> DataFrame:
    """Rows with details that win where given."""
    detail = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"), "toxic")
    return serve.enrich(t.documents.select("doc_id", "source"), detail, "doc_id")


@query(f"""
WITH c(city, south, west, north, east) AS (VALUES ('north', 41.80, -87.90, 41.96, -87.60), ('south', 41.65, -87.90, 41.80, -87.60))
SELECT s_suppkey, city FROM {POINTS} JOIN c ON lat >= south AND lat < north AND lon >= west AND lon < east
""")
def j9_city_lookup(t: Tables) -> DataFrame:
    """Places to the city whose box holds them."""
    cities = t.spark.createDataFrame([("north", 41.80, -87.90, 41.96, -87.60), ("south", 41.65, -87.90, 41.80, -87.60)], "city string, south double, west double, north double, east double")
    return serve.box_lookup(points(t), cities).select("s_suppkey", "city")


SNAPSHOTS = """
o AS (SELECT user_id, count(*) AS n, max(event_type) AS phone, min(event_type) AS website FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1),
n AS (SELECT user_id, count(*) AS n, max(event_type) AS phone, min(event_type) AS website FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
"""


@query(f"""
WITH {SNAPSHOTS}, b AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, o.user_id AS ou, n.user_id AS nu, o.n AS on_, n.n AS nn, o.phone AS op, n.phone AS np, o.website AS ow, n.website AS nw FROM o FULL OUTER JOIN n ON o.user_id = n.user_id)
SELECT user_id, 'new' AS change_type, NULL::VARCHAR AS field, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM b WHERE ou IS NULL
UNION ALL SELECT user_id, 'removed', NULL, NULL, NULL FROM b WHERE nu IS NULL
UNION ALL SELECT user_id, 'updated', 'phone', op, np FROM b WHERE ou IS NOT NULL AND nu IS NOT NULL AND op IS DISTINCT FROM np
UNION ALL SELECT user_id, 'updated', 'website', ow, nw FROM b WHERE ou IS NOT NULL AND nu IS NOT NULL AND ow IS DISTINCT FROM nw
UNION ALL SELECT user_id, 'menu_changed', 'n', on_::VARCHAR, nn::VARCHAR FROM b WHERE ou IS NOT NULL AND nu IS NOT NULL AND on_ <> nn
""")
def j10_snapshot_diff(t: Tables) -> DataFrame:
    """Changes between two snapshots of the users."""
    side = lambda c: t.events.filter(c).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_type").alias("phone"), F.min("event_type").alias("website"))
    day = F.lit("2024-01-10").cast("timestamp")
    return serve.snapshot_diff(side(F.col("ts") < day), side(F.col("ts") >= day), "user_id", ["phone"], ["website"], "n")


WHOLE_SNAPSHOTS = SNAPSHOTS.replace("SELECT user_id,", "SELECT user_id * 100 + hour(ts) AS user_id,")


@query(f"""
WITH {WHOLE_SNAPSHOTS}, b AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, o.user_id AS ou, n.user_id AS nu, o.n AS on_, n.n AS nn, o.phone AS op, n.phone AS np, o.website AS ow, n.website AS nw FROM o FULL OUTER JOIN n ON o.user_id = n.user_id)
SELECT user_id, 'new' AS change_type, NULL::VARCHAR AS field, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM b WHERE ou IS NULL
UNION ALL SELECT user_id, 'removed', NULL, NULL, NULL FROM b WHERE nu IS NULL
UNION ALL SELECT user_id, 'updated', 'phone', op, np FROM b WHERE ou IS NOT NULL AND nu IS NOT NULL AND op IS DISTINCT FROM np
UNION ALL SELECT user_id, 'updated', 'website', ow, nw FROM b WHERE ou IS NOT NULL AND nu IS NOT NULL AND ow IS DISTINCT FROM nw
UNION ALL SELECT user_id, 'menu_changed', 'n', on_::VARCHAR, nn::VARCHAR FROM b WHERE ou IS NOT NULL AND nu IS NOT NULL AND on_ <> nn
""")
def j10_snapshot_diff_whole(t: Tables) -> DataFrame:
    """J10 over all events, by user and hour of the day."""
    side = lambda c: t.events.filter(c).groupBy((F.col("user_id") * 100 + F.hour("ts")).alias("user_id")).agg(F.count("*").alias("n"), F.max("event_type").alias("phone"), F.min("event_type").alias("website"))
    day = F.lit("2024-01-10").cast("timestamp")
    return serve.snapshot_diff(side(F.col("ts") < day), side(F.col("ts") >= day), "user_id", ["phone"], ["website"], "n")


@query("""
WITH d(keyword, label, weight) AS (VALUES ('red', 'warm', 0.9), ('hot', 'warm', 0.7), ('cold', 'cool', 0.8), ('ring', 'round', 0.6), ('gear', 'round', 0.9))
SELECT p_partkey, label, max(weight)::DOUBLE AS weight FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS keyword FROM part) JOIN d USING (keyword) GROUP BY ALL
""")
def j11_dictionary_tags(t: Tables) -> DataFrame:
    """Words to labels by a dictionary table."""
    d = t.spark.createDataFrame([("red", "warm", 0.9), ("hot", "warm", 0.7), ("cold", "cool", 0.8), ("ring", "round", 0.6), ("gear", "round", 0.9)], "keyword string, label string, weight double")
    return serve.dictionary_tags(t.part.select("p_partkey", F.split("p_name", " ").alias("words")), "p_partkey", "words", d)


WORDS = "string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query(f"""
WITH RECURSIVE d AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS phrase, role AS label, n / 4.0::DOUBLE AS weight FROM (SELECT role, {WORDS} AS w FROM conversations) CROSS JOIN (VALUES (1), (2), (4)) AS r(n) WHERE len(w) >= n AND w[1] <> ''),
p AS (SELECT DISTINCT phrase, len(string_split(phrase, ' ')) AS n FROM d),
t AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS pos FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
h AS (SELECT doc_id, pos, arg_max(phrase, p.n) AS phrase, max(p.n) AS n FROM (SELECT doc_id, pos, k, array_to_string(w[pos:pos + k - 1], ' ') AS gram FROM t CROSS JOIN (VALUES (1), (2), (4)) AS r(k) WHERE pos + k - 1 <= len(w)) AS g JOIN p ON p.phrase = g.gram AND p.n = g.k GROUP BY 1, 2),
o AS (SELECT doc_id, pos, phrase, n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM h),
x AS (SELECT a.doc_id, a.i, a.phrase, b.i AS following FROM o a ASOF LEFT JOIN o b ON a.doc_id = b.doc_id AND a.pos + a.n <= b.pos),
k AS (SELECT doc_id, i, phrase, following FROM x WHERE i = 1 UNION ALL SELECT x.doc_id, x.i, x.phrase, x.following FROM k JOIN x ON x.doc_id = k.doc_id AND x.i = k.following)
SELECT doc_id, label, max(weight) AS weight FROM (SELECT DISTINCT doc_id, phrase FROM k) JOIN d USING (phrase) GROUP BY 1, 2
""")
def j11_dictionary_phrases(t: Tables) -> DataFrame:
    """Phrases to labels: what turns of conversations begin with, one, two or four words, in all documents."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    some = lambda w: F.filter(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda n: (F.size(w) >= n) & (w[0] != ""))
    begins = text.let(words, lambda w: F.transform(some(w), lambda n: F.struct(F.array_join(F.slice(w, F.lit(1), n), " ").alias("phrase"), (n / 4).alias("weight"))))
    d = t.conversations.select(F.col("role").alias("label"), F.inline(begins)).distinct()
    return serve.dictionary_phrases(t.documents.select("doc_id", words.alias("words")), "doc_id", "words", d)


@query("SELECT coalesce(c_mktsegment, 'Unknown') AS cuisine, count(*) AS n FROM customer GROUP BY 1")
def a4_value_counts(t: Tables) -> DataFrame:
    """Places of each cuisine."""
    return metrics.value_counts(t.customer, F.col("c_mktsegment"), "cuisine")


@query("SELECT event_type, round(avg(value), 4) AS x, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1 ORDER BY 1")
def s3_sorted_counts(t: Tables) -> DataFrame:
    """Groups in alphabetical order."""
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("x"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("event_type")
