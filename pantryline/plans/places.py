"""Queries of entity resolution: suppliers and customers as two sources, with coordinates, names and phones from their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantryline.functions import geo
from pantryline.operators import resolve
from pantryline.plans.base import Tables, query

NAMES = ["Golden Fork Restaurant", "Red Lion", "Blue Door Cafe", "Old Mill Bar", "Corner House", "Luna", "The Green Place"]


def _source(df: DataFrame, key: str, shift: bool) -> DataFrame:
    k = F.col(key)
    lat = 41.65 + (k * 37 % 1000) * 0.0003
    names = F.array(*map(F.lit, NAMES))
    return df.select(
        k.alias("id"),
        k.alias("pos"),
        names[(k % 7).cast("int")].alias("name"),
        (lat + (k % 5) * 0.0002 if shift else lat).alias("lat"),
        (-87.90 + (k * 91 % 1000) * 0.0003).alias("lon"),
        F.concat(F.lit("312555"), F.lpad((k % 1000).cast("string"), 4, "0")).alias("phone"),
        F.when(k % 3 > 0, F.concat(F.lit("street "), k.cast("string"))).otherwise("").alias("address"),
    )


def side_a(t: Tables) -> DataFrame:
    """Suppliers as places."""
    return _source(t.supplier, "s_suppkey", False)


def side_b(t: Tables) -> DataFrame:
    """Customers as places, a little to the north."""
    return _source(t.customer, "c_custkey", True)


def _sql_side(key: str, table: str, shift: str) -> str:
    names = "[" + ", ".join(f"'{x}'" for x in NAMES) + "]"
    plain = "['golden fork', 'red lion', 'blue door', 'old mill', 'corner', 'luna', 'the green']"
    return f"SELECT {key} AS id, {names}[{key} % 7 + 1] AS name, {plain}[{key} % 7 + 1] AS plain, 41.65 + ({key} * 37 % 1000) * 0.0003{shift} AS lat, -87.90 + ({key} * 91 % 1000) * 0.0003 AS lon, '312555' || lpad(({key} % 1000)::VARCHAR, 4, '0') AS phone, CASE WHEN {key} % 3 > 0 THEN 'street ' || {key} ELSE '' END AS address FROM {table}"


PAIRS = f"""
WITH a AS ({_sql_side("s_suppkey", "supplier", "")}), b AS ({_sql_side("c_custkey", "customer", " + (c_custkey % 5) * 0.0002")}),
d AS (SELECT a.id AS a_id, b.id AS b_id, a.plain AS x, b.plain AS y, a.phone AS p, b.phone AS q,
  pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM a JOIN b ON abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.01),
m AS (SELECT a_id, b_id, 1.0::DOUBLE - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) AS name_similarity, CASE WHEN p = q THEN 1.0 ELSE 0.0 END::DOUBLE AS phone_match, 2 * 6371000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)) AS distance_m FROM d),
c AS (SELECT *, name_similarity * 0.4::DOUBLE + phone_match * 0.4::DOUBLE + (1.0::DOUBLE - distance_m / 100) * 0.2::DOUBLE AS confidence FROM m WHERE distance_m <= 100),
pairs AS (SELECT * FROM c WHERE confidence >= 0.5),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY round(confidence, 9) DESC, b_id) AS r FROM pairs) WHERE r = 1),
matches AS (SELECT * FROM (SELECT * EXCLUDE r, row_number() OVER (PARTITION BY b_id ORDER BY a_id) AS r2 FROM best) WHERE r2 = 1)
"""


def _pairs(t: Tables) -> DataFrame:
    return resolve.geo_fuzzy_match(side_a(t), side_b(t))


def _matches(t: Tables) -> DataFrame:
    # equal scores can differ in their last bits between engines
    return resolve.best_matches(side_a(t), side_b(t), decimals=9)


@query(f"{PAIRS} SELECT a_id, b_id, round(distance_m, 4) AS distance_m, round(confidence, 6) AS confidence FROM pairs")
def j1_m1_geo_fuzzy_match(t: Tables) -> DataFrame:
    """Pairs of places near each other."""
    return _pairs(t).select("a_id", "b_id", F.round("distance_m", 4).alias("distance_m"), F.round("confidence", 6).alias("confidence"))


@query(f"{PAIRS} SELECT a_id, b_id, CASE WHEN name_similarity >= 0.8 AND phone_match = 1 THEN 'name_phone_location' WHEN phone_match = 1 THEN 'phone_location' ELSE 'name_location' END AS match_type FROM matches")
def j2_assign_one_to_one(t: Tables) -> DataFrame:
    """One match a place."""
    return _matches(t).select("a_id", "b_id", "match_type")


@query(f"{PAIRS} SELECT 'merged_' || a_id || '_' || b_id AS id, b.name, coalesce(nullif(b.address, ''), nullif(a.address, '')) AS address, round(a.lat, 6) AS lat FROM matches JOIN a ON a.id = a_id JOIN b ON b.id = b_id")
def j3_merge_entities(t: Tables) -> DataFrame:
    """Matched places as one."""
    out = resolve.merge_entities(side_a(t), side_b(t), _matches(t), {"name": "b", "address": "b", "lat": "a"})
    return out.select("id", "name", "address", F.round("lat", 6).alias("lat"))


@query(f"{PAIRS} SELECT id, 'a' AS side FROM a WHERE id NOT IN (SELECT a_id FROM matches) UNION ALL SELECT id, 'b' FROM b WHERE id NOT IN (SELECT b_id FROM matches)")
def j4_unmatched_sides(t: Tables) -> DataFrame:
    """Places of one source alone."""
    m = _matches(t)
    alone = resolve.unmatched(side_a(t), m, "a_id", "a").unionByName(resolve.unmatched(side_b(t), m, "b_id", "b"))
    return alone.select("id", F.col("data_sources")[0].alias("side"))


@query(f"{PAIRS} SELECT count(*) AS n_matches, (SELECT count(*) FROM a) - count(*) AS a_only, (SELECT count(*) FROM b) - count(*) AS b_only, round(count(*) * 100.0 / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)), 6)::DOUBLE AS match_rate, round(coalesce(avg(confidence), 0), 6) AS mean_confidence FROM matches")
def a21_merge_stats(t: Tables) -> DataFrame:
    """Figures of a merge."""
    out = resolve.merge_stats(side_a(t), side_b(t), _matches(t))
    return out.withColumns({"match_rate": F.round("match_rate", 6), "mean_confidence": F.round("mean_confidence", 6)})


@query(f"""
WITH p AS (SELECT id, lat, lon FROM ({_sql_side("s_suppkey", "supplier", "")}))
SELECT id, least(floor((lat - 41.65) / (0.31 / 8))::INT, 7) AS "row", least(floor((lon + 87.90) / (0.31 / 8))::INT, 7) AS col FROM p
""")
def m2_grid_cells(t: Tables) -> DataFrame:
    """Places to the cells of a grid."""
    row, col = geo.cell_of(F.col("lat"), F.col("lon"), 41.65, -87.90, 41.96, -87.59, 8)
    return side_a(t).select("id", row.alias("row"), col.alias("col"))


@query("""
WITH b AS (SELECT n_nationkey, n_nationkey * 1.0 AS south, n_nationkey * 1.0 + 0.8 AS north FROM nation), g AS (SELECT n_nationkey, south, north, r, c FROM b, range(4) AS x(r), range(4) AS y(c))
SELECT n_nationkey, r::INT AS "row", c::INT AS col, round(south + (r + 0.5) * 0.2, 6)::DOUBLE AS lat, round(-10 + (c + 0.5) * 0.5, 6)::DOUBLE AS lon, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM g
""")
def m2_grid_points(t: Tables) -> DataFrame:
    """The centres of a grid over the box of each nation's customers."""
    every = [geo.grid_points(t.spark, float(k), -10.0, k + 0.8, -8.0, 4).withColumn("n_nationkey", F.lit(k)) for (k,) in t.nation.select("n_nationkey").collect()]
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    points = reduce(DataFrame.unionByName, every)
    return points.join(counts, "n_nationkey", "left").select("n_nationkey", "row", "col", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.coalesce("n", F.lit(0)).alias("n"))


def _named_side(key: str, table: str, shift: str, letter: str) -> str:
    return f"SELECT '{letter}' || id AS id, id AS pos, name || ' ' || id % 40 AS name, lower(name || ' ' || id % 40) AS k, lat, lon FROM ({_sql_side(key, table, shift)})"


@query(f"""
WITH RECURSIVE a AS ({_named_side("s_suppkey", "supplier", "", "a")}),
b AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM ({_named_side("c_custkey", "customer", " + (c_custkey % 5) * 0.0002", "b")}) x
  WHERE NOT EXISTS (FROM a WHERE a.k = x.k OR abs(a.lat - x.lat) < 0.001 AND abs(a.lon - x.lon) < 0.001 AND (contains(a.k, x.k) OR contains(x.k, a.k)))),
g AS (SELECT 0::BIGINT AS i, [{{'id': '', 'name': '', 'k': '?', 'lat': 0.0::DOUBLE, 'lon': 0.0::DOUBLE}}] AS kept
  UNION ALL SELECT b.i, CASE WHEN len(list_filter(kept, lambda y: y.k = b.k OR abs(y.lat - b.lat) < 0.001 AND abs(y.lon - b.lon) < 0.001 AND (contains(y.k, b.k) OR contains(b.k, y.k)))) > 0 THEN kept
    ELSE list_append(kept, {{'id': b.id, 'name': b.name, 'k': b.k, 'lat': b.lat::DOUBLE, 'lon': b.lon::DOUBLE}}) END FROM g JOIN b ON b.i = g.i + 1)
SELECT id, name FROM a UNION ALL SELECT x.id, x.name FROM (SELECT unnest(kept) AS x FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1)) WHERE x.id <> ''
""")
def j5_union_dedupe(t: Tables) -> DataFrame:
    """Places of the first source, and those of the second that duplicate none before them."""
    # names with their keys, so that not every place of a kind is one
    named = lambda df: df.withColumn("name", F.concat_ws(" ", "name", (F.col("id") % 40).cast("string")))
    a, b = named(side_a(t)), named(side_b(t))
    tagged = lambda df, x: df.withColumn("id", F.concat(F.lit(x), F.col("id").cast("string")))
    return resolve.union_dedupe(tagged(a, "a"), tagged(b, "b")).select("id", "name")
