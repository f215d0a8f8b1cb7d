"""Queries of duplicates, choices, roll-ups and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantryline.functions import text
from pantryline.operators import dedupe, metrics
from pantryline.plans.base import Tables, query
from pantryline.plans.serving import labelled_parts
from pantryline.sources import store

CAND = "(SELECT event_id, user_id % 20 AS page, event_type AS name, round(value, 1) AS conf, (event_id % 5)::BIGINT AS prio, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'd' || event_id END AS description FROM events)"


def candidates(t: Tables) -> DataFrame:
    """Events as extraction candidates of twenty pages."""
    i = F.col("event_id")
    return t.events.select("event_id", (F.col("user_id") % 20).alias("page"), F.col("event_type").alias("name"), F.round("value", 1).alias("conf"), (i % 5).alias("prio"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("d"), i.cast("string"))).alias("description"))


@query(f"""
SELECT page, name, arg_max(event_id, (conf, -event_id)) AS event_id, max(conf) AS conf, array_to_string(list_sort(list(DISTINCT 's' || prio)), ',') AS sources FROM {CAND} GROUP BY ALL
""")
def w1_best_per_group(t: Tables) -> DataFrame:
    """The best candidate of each name, with all sources."""
    rows = candidates(t).withColumn("sources", F.array(F.concat(F.lit("s"), F.col("prio").cast("string"))))
    return dedupe.best_per_group(rows, ["page", "name"], "event_id", "conf", "sources", "event_id").withColumn("sources", F.array_join("sources", ","))


@query(f"""
SELECT page, name, first(description ORDER BY conf DESC, prio DESC, event_id) FILTER (description <> '') AS description, count(*)::INT AS n_candidates, least(max(conf) / 1000 + 0.1 * (count(*) - 1), 1.0)::DOUBLE AS conf FROM {CAND} GROUP BY page, name
""")
def w2_merge_candidates(t: Tables) -> DataFrame:
    """Candidates of a name as one, each field from the best that gives it."""
    rows = candidates(t).withColumns({"conf": F.col("conf") / 1000, "labels": F.array(F.lit("x"))})
    return dedupe.merge_candidates(rows, ["page", "name"], ["description"], "prio", "conf", "labels", "event_id").select("page", "name", "description", "n_candidates", "conf")


@query(f"SELECT event_id, page, name FROM (SELECT *, row_number() OVER (PARTITION BY page, lower(trim(name)), conf ORDER BY event_id) AS r FROM {CAND}) WHERE r = 1")
def w3_first_wins(t: Tables) -> DataFrame:
    """The first of each name and price."""
    return dedupe.first_wins(candidates(t), ["page", F.lower(F.trim("name")), "conf"], "event_id").select("event_id", "page", "name")


@query(f"""
WITH c AS (SELECT page, event_id, CASE WHEN event_id % 4 <> 0 THEN 'unknown' ELSE name END AS cuisine FROM {CAND}),
f AS (SELECT page, arg_min(cuisine, event_id) FILTER (cuisine <> 'unknown') AS fill FROM c GROUP BY 1)
SELECT page, event_id, CASE WHEN cuisine = 'unknown' THEN coalesce(fill, cuisine) ELSE cuisine END AS cuisine FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY event_id) AS r FROM c) JOIN f USING (page) WHERE r = 1
""")
def w4_first_wins_backfill(t: Tables) -> DataFrame:
    """The first of each page, with the first cuisine that is known."""
    rows = candidates(t).select("page", "event_id", F.when(F.col("event_id") % 4 != 0, "unknown").otherwise(F.col("name")).alias("cuisine"))
    return dedupe.first_wins_backfill(rows, ["page"], "event_id", "cuisine")


@query(f"""
WITH l AS (SELECT page, event_id, name, CASE WHEN prio = 0 THEN conf::VARCHAR END AS own, name IN ('view', 'click') AS food FROM {CAND}),
n AS (SELECT *, lead(CASE WHEN NOT food THEN own END) OVER (PARTITION BY page ORDER BY event_id) AS nxt FROM l)
SELECT page, event_id, coalesce(own, nxt) AS price FROM n WHERE food
""")
def w6_next_line_price(t: Tables) -> DataFrame:
    """Prices from the next line."""
    price = F.when(F.col("prio") == 0, F.col("conf").cast("string"))
    return dedupe.next_line_price(candidates(t), ["page"], "event_id", "name", price, F.col("name").isin("view", "click")).select("page", "event_id", "price")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 + 1 AS batch, (row_number() OVER (ORDER BY o_orderkey) - 1) % 50 + 1 AS position FROM orders")
def w7_batches(t: Tables) -> DataFrame:
    """Batches of fifty over all rows in order."""
    return dedupe.batches(t.orders.select("o_orderkey"), ["o_orderkey"], 50)


@query("SELECT *, (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // 50 + 1 AS batch, (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) % 50 + 1 AS position FROM orders")
def w7_wide_batches(t: Tables) -> DataFrame:
    """Batches of whole rows, in the order of two columns."""
    return dedupe.batches(t.orders, ["o_custkey", "o_orderkey"], 50)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def w8_recent(t: Tables) -> DataFrame:
    """The last ten."""
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "ts")


@query("""
WITH RECURSIVE p AS (SELECT p_brand, p_partkey, list_distinct(list_append(string_split(p_name, ' '), p_type)) AS w, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
g AS (SELECT p_brand, i, p_partkey AS kept_key, [w] AS kept FROM p WHERE i = 1
  UNION ALL SELECT p.p_brand, p.i, CASE WHEN s THEN NULL ELSE p.p_partkey END, CASE WHEN s THEN kept ELSE list_append(kept, w) END
  FROM (SELECT g.p_brand, p.i, p.w, p.p_partkey, g.kept, len(list_filter(g.kept, lambda k: len(list_intersect(k, p.w)) / len(list_distinct(list_concat(k, p.w))) > 0.8)) > 0 AS s FROM g JOIN p ON p.p_brand = g.p_brand AND p.i = g.i + 1) p)
SELECT p_brand, kept_key AS p_partkey FROM g WHERE kept_key IS NOT NULL
""")
def w9_similarity_dedupe(t: Tables) -> DataFrame:
    """Items of a brand without near copies of earlier kept ones."""
    rows = t.part.select("p_brand", "p_partkey", F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.col("p_type")))).alias("words"))
    return dedupe.similarity_dedupe(rows, ["p_brand"], "words", "p_partkey").select("p_brand", "p_partkey")


@query(f"""
WITH c AS (SELECT page, event_id, (event_id % 3)::INT AS strategy_rank FROM {CAND}),
n AS (SELECT page, count(*) FILTER (strategy_rank = 0) AS n0, count(*) FILTER (strategy_rank = 1) AS n1 FROM c GROUP BY 1)
SELECT page, event_id FROM c JOIN n USING (page) WHERE strategy_rank = 0 OR (strategy_rank = 1 AND n0 < 100) OR (strategy_rank = 2 AND n0 + CASE WHEN n0 < 100 THEN n1 ELSE 0 END < 30)
""")
def u2_cascade(t: Tables) -> DataFrame:
    """Later strategies only where earlier ones gave little."""
    i = F.col("event_id")
    rows = candidates(t).select("page", "event_id", (i % 3).cast("int").alias("strategy_rank"))
    return dedupe.cascade(rows, ["page"], "strategy_rank", [0, 100, 30]).select("page", "event_id")


@query(f"""
WITH c AS (SELECT page, event_id, name, prio, CASE WHEN event_id % (page + 2) = 0 THEN 'primary' ELSE 'fallback' END AS source FROM {CAND}),
n AS (SELECT page, count(*) FILTER (source = 'primary') AS p, count(*) FILTER (source = 'fallback') AS f FROM c GROUP BY 1),
l AS (SELECT c.*, CASE WHEN p >= 5 THEN 'primary_url' WHEN f > p THEN 'fallback_website' WHEN f > 0 THEN 'combined' ELSE 'primary_url_only' END AS label FROM c JOIN n USING (page))
SELECT page, event_id, label FROM l WHERE (label LIKE 'primary%' AND source = 'primary') OR (label = 'fallback_website' AND source = 'fallback')
UNION ALL SELECT page, event_id, label FROM (SELECT *, row_number() OVER (PARTITION BY page, name, prio ORDER BY event_id) AS r FROM l WHERE label = 'combined') WHERE r = 1
""")
def u5_source_fallback(t: Tables) -> DataFrame:
    """Two sources a page."""
    rows = candidates(t).withColumn("source", F.when(F.col("event_id") % (F.col("page") + 2) == 0, "primary").otherwise("fallback"))
    return dedupe.source_fallback(rows, "page", "source", "name", "prio", "event_id").select("page", "event_id", "label")


USER_CAND = "(SELECT event_id, user_id * 100 + day(ts) // 2 AS page, event_type AS name, (event_id % 5)::BIGINT AS prio FROM events)"


def user_candidates(t: Tables) -> DataFrame:
    """All events as extraction candidates, a page for two days of a user."""
    return t.events.select("event_id", (F.col("user_id") * 100 + F.floor(F.dayofmonth("ts") / 2)).alias("page"), F.col("event_type").alias("name"), (F.col("event_id") % 5).alias("prio"))


@query(f"""
WITH c AS (SELECT page, event_id, (event_id % 3)::INT AS strategy_rank FROM {USER_CAND}),
n AS (SELECT page, count(*) FILTER (strategy_rank = 0) AS n0, count(*) FILTER (strategy_rank = 1) AS n1 FROM c GROUP BY 1)
SELECT page, event_id FROM c JOIN n USING (page) WHERE strategy_rank = 0 OR (strategy_rank = 1 AND n0 < 2) OR (strategy_rank = 2 AND n0 + CASE WHEN n0 < 2 THEN n1 ELSE 0 END < 3)
""")
def u2_cascade_whole(t: Tables) -> DataFrame:
    """U2 over all events."""
    rows = user_candidates(t).select("page", "event_id", (F.col("event_id") % 3).cast("int").alias("strategy_rank"))
    return dedupe.cascade(rows, ["page"], "strategy_rank", [0, 2, 3]).select("page", "event_id")


@query(f"""
WITH c AS (SELECT page, event_id, name, prio, CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'fallback' END AS source FROM {USER_CAND}),
n AS (SELECT page, count(*) FILTER (source = 'primary') AS p, count(*) FILTER (source = 'fallback') AS f FROM c GROUP BY 1),
l AS (SELECT c.*, CASE WHEN p >= 5 THEN 'primary_url' WHEN f > p THEN 'fallback_website' WHEN f > 0 THEN 'combined' ELSE 'primary_url_only' END AS label FROM c JOIN n USING (page))
SELECT page, event_id, label FROM l WHERE (label LIKE 'primary%' AND source = 'primary') OR (label = 'fallback_website' AND source = 'fallback')
UNION ALL SELECT page, event_id, label FROM (SELECT *, row_number() OVER (PARTITION BY page, name, prio ORDER BY event_id) AS r FROM l WHERE label = 'combined') WHERE r = 1
""")
def u5_source_fallback_whole(t: Tables) -> DataFrame:
    """U5 over all events."""
    rows = user_candidates(t).withColumn("source", F.when(F.col("event_id") % 2 == 0, "primary").otherwise("fallback"))
    return dedupe.source_fallback(rows, "page", "source", "name", "prio", "event_id").select("page", "event_id", "label")


PARTS = "(WITH g AS (SELECT l_partkey, list(DISTINCT l_returnflag) AS labels FROM lineitem GROUP BY 1) SELECT p_partkey, p_brand, p_type, CASE WHEN p_size > 40 THEN 'high' WHEN p_size > 20 THEN 'medium' WHEN p_size > 10 THEN 'low' ELSE 'unknown' END AS risk, coalesce(labels, []) AS labels FROM part LEFT JOIN g ON l_partkey = p_partkey)"


def risky_parts(t: Tables) -> DataFrame:
    """Parts with labels and a risk by size."""
    s = F.col("p_size")
    return labelled_parts(t).withColumn("risk", F.when(s > 40, "high").when(s > 20, "medium").when(s > 10, "low").otherwise("unknown"))


@query(f"SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM {PARTS}) GROUP BY 1")
def a5_array_value_counts(t: Tables) -> DataFrame:
    """Items of each label."""
    return metrics.array_value_counts(risky_parts(t), F.col("labels"), "label")


@query(f"SELECT label, count(*) AS n_items, count(DISTINCT p_brand) AS n_places FROM (SELECT p_brand, unnest(labels) AS label FROM {PARTS}) GROUP BY 1")
def a6_label_reach(t: Tables) -> DataFrame:
    """Items and places of each label."""
    return metrics.label_reach(risky_parts(t), "labels", "p_brand")


@query("SELECT round(avg((c_acctbal > 5000)::INT) * 100, 6) AS rich, round(avg((c_mktsegment <> 'BUILDING')::INT) * 100, 6) AS other FROM customer")
def a7_coverage(t: Tables) -> DataFrame:
    """How many rows have what."""
    out = metrics.coverage(t.customer, rich=F.col("c_acctbal") > 5000, other=F.col("c_mktsegment") != "BUILDING")
    return out.select(F.round("rich", 6).alias("rich"), F.round("other", 6).alias("other"))


@query("""
SELECT count(*) AS total, count(*) FILTER (user_id % 7 > 0) AS with_menus, count(*) FILTER (value > 10) AS with_phone, round(avg(user_id % 7) FILTER (user_id % 7 > 0), 6) AS avg_items,
  round(avg(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3.6e9, 4) AS freshness_hours, round(avg((event_type = 'error')::INT) * 100, 6) AS error_rate FROM events
""")
def a8_d1_quality_metrics(t: Tables) -> DataFrame:
    """Quality at a moment."""
    out = metrics.quality_metrics(t.events, F.col("user_id") % 7, {"phone": F.col("value") > 10}, F.col("ts").cast("string"), F.lit("2024-01-31").cast("timestamp"), F.col("event_type"))
    return out.select("total", "with_menus", "with_phone", F.round("avg_items", 6).alias("avg_items"), F.round("freshness_hours", 4).alias("freshness_hours"), F.round("error_rate", 6).alias("error_rate"))


@query(f"""
SELECT p_brand, count(*) AS n_items, count(*) FILTER (risk = 'high') AS n_high, count(*) FILTER (risk = 'low') AS n_low, round(avg((len(labels) > 0)::INT) * 100, 4) AS coverage_pct,
  CASE WHEN n_high * 100.0 / count(*) > 30 THEN 'high' WHEN n_high * 100.0 / count(*) > 10 THEN 'medium' WHEN n_low > 0 THEN 'low' ELSE 'unknown' END AS overall_risk FROM {PARTS} GROUP BY 1
""")
def a9_place_risk(t: Tables) -> DataFrame:
    """Risk of each place."""
    parts = risky_parts(t)
    return metrics.place_risk(t.part, parts, "p_brand", "risk", "labels").select("p_brand", "n_items", "n_high", "n_low", F.round("coverage_pct", 4).alias("coverage_pct"), "overall_risk")


@query(f"""
WITH b AS (SELECT p_brand, count(*) AS n, sum(len(labels)) AS d, count(*) FILTER (risk = 'high') AS h, count(*) FILTER (len(labels) > 0) AS w FROM {PARTS} GROUP BY 1)
SELECT count(*) AS n_places, sum(n)::BIGINT AS n_items, sum(d)::BIGINT AS n_detections, sum(h)::BIGINT AS n_high_risk, round(avg(n), 6) AS avg_items, round(avg((w > 0)::INT) * 100, 6) AS labelled_places_pct,
  CASE WHEN sum(n) > 100 AND sum(d) > 50 THEN 'ready' WHEN sum(n) > 50 AND sum(d) > 20 THEN 'nearly' WHEN sum(n) > 20 THEN 'started' ELSE 'insufficient' END AS readiness FROM b
""")
def a10_a12_corpus_analysis(t: Tables) -> DataFrame:
    """Figures over all places."""
    out = metrics.corpus_analysis(risky_parts(t), "p_brand", "risk", "labels")
    return out.withColumns({"avg_items": F.round("avg_items", 6), "labelled_places_pct": F.round("labelled_places_pct", 6)})


@query(f"""
WITH g AS (SELECT p_brand, avg((len(labels) > 0)::INT) * 100 AS tr, count(DISTINCT p_type) AS nc FROM {PARTS} GROUP BY 1),
x AS (SELECT p_brand, count(DISTINCT l) AS nt FROM (SELECT p_brand, unnest(labels) AS l FROM {PARTS}) GROUP BY 1)
SELECT p_brand, round((tr + least(coalesce(nt, 0) * 20, 100) + least(nc * 15, 100)) / 4, 6) AS score,
  CASE WHEN (tr + least(coalesce(nt, 0) * 20, 100) + least(nc * 15, 100)) / 4 >= 80 THEN 'excellent' WHEN (tr + least(coalesce(nt, 0) * 20, 100) + least(nc * 15, 100)) / 4 >= 60 THEN 'good' WHEN (tr + least(coalesce(nt, 0) * 20, 100) + least(nc * 15, 100)) / 4 >= 40 THEN 'fair' ELSE 'poor' END AS rating
FROM g LEFT JOIN x USING (p_brand)
""")
def a11_health_score(t: Tables) -> DataFrame:
    """Health of each place."""
    return metrics.health_score(risky_parts(t), "p_brand", "labels", "labels", "p_type").select("p_brand", F.round("score", 6).alias("score"), "rating")


@query(f"SELECT p_brand, round(avg(0.3 + 0.2 + CASE WHEN len(labels) > 0 THEN 0.15 ELSE 0 END + CASE WHEN p_type <> 'SMALL' THEN 0.05 ELSE 0 END), 6)::DOUBLE AS quality FROM {PARTS} GROUP BY 1")
def a13_extraction_quality(t: Tables) -> DataFrame:
    """Mean quality of the items of a page."""
    q = metrics.item_quality(F.lit("name"), F.col("p_retailprice"), F.lit(None).cast("string"), F.col("labels"), F.array(), F.when(F.col("p_type") != "SMALL", "x").otherwise("other"))
    return risky_parts(t).groupBy("p_brand").agg(F.round(F.avg(q), 6).alias("quality"))


@query("""
WITH m AS (SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS successful, sum(CASE WHEN event_type = 'purchase' THEN user_id % 9 ELSE 0 END)::BIGINT AS total_items, avg(value) FILTER (value > 0) AS s, min(value) FILTER (value > 0) AS fastest, max(value) AS slowest, count(*) FILTER (event_type = 'purchase' AND value > 20) AS with_prices FROM events)
SELECT total, successful, total_items, round(s, 6) AS avg_seconds, fastest, slowest, with_prices, round(successful * 100.0 / total, 6)::DOUBLE AS success_rate, round(total_items * 1.0 / successful, 6)::DOUBLE AS items_per_success, round(3600 / s, 4) AS per_hour,
  round(28800 / s, 4) AS daily_capacity, CASE WHEN successful * 100.0 / total > 30 THEN 25 ELSE 15 END AS batch_size FROM m
""")
def a14_a15_run_metrics(t: Tables) -> DataFrame:
    """Figures of a run."""
    ok = F.col("event_type") == "purchase"
    out = metrics.run_metrics(t.events, ok, F.col("user_id") % 9, F.col("value"), F.col("value") > 20)
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("total", "successful", "total_items", r("avg_seconds", 6), "fastest", "slowest", "with_prices", r("success_rate", 6), r("items_per_success", 6), r("per_hour", 4), r("daily_capacity", 4), "batch_size")


@query("SELECT user_id % 25 AS batch, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS successful FROM events GROUP BY 1")
def a16_batch_performance(t: Tables) -> DataFrame:
    """Successes of each batch."""
    return metrics.batch_performance(t.events.withColumn("batch", F.col("user_id") % 25), "batch", F.col("event_type") == "purchase")


@query("SELECT n_nationkey AS city, n_nationkey % 3 AS priority, 50 + n_nationkey AS expected, coalesce(f, 0) AS found, round(coalesce(f, 0) * 100.0 / (50 + n_nationkey), 4)::DOUBLE AS pct FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS f FROM customer GROUP BY 1) ON c_nationkey = n_nationkey ORDER BY priority, city")
def a17_s4_city_rollup(t: Tables) -> DataFrame:
    """Places found against those expected, by priority."""
    cities = t.nation.select(F.col("n_nationkey").alias("city"), (F.col("n_nationkey") % 3).alias("priority"), (50 + F.col("n_nationkey")).alias("expected"))
    out = metrics.city_rollup(t.customer.select(F.col("c_nationkey").alias("city")), cities, "city")
    return out.withColumn("pct", F.round("pct", 4)).orderBy("priority", "city")


@query("""
WITH c AS (SELECT n_name AS city, r_name AS state, n_nationkey, 50 + n_nationkey AS expected, n_nationkey * 1.5 AS seconds, n_nationkey % 4 > 0 AS ok FROM nation JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT city, state, 1 AS place, (c_acctbal > 5000)::INT AS phone, (c_mktsegment <> 'BUILDING')::INT AS website, NULL AS expected, NULL AS seconds, NULL AS ok FROM customer JOIN c ON c_nationkey = n_nationkey
  UNION ALL SELECT city, state, 0, NULL, NULL, expected, seconds, ok::INT FROM c)
SELECT state, city, CASE grouping(state, city) WHEN 0 THEN 'city' WHEN 1 THEN 'state' ELSE 'nation' END AS level, count(*) FILTER (place = 0) AS n_cities, sum(place)::BIGINT AS found, sum(expected)::BIGINT AS expected,
  round(sum(place) * 100.0 / sum(expected), 6)::DOUBLE AS pct, sum(ok)::BIGINT AS successful, (count(*) FILTER (place = 0) - sum(ok))::BIGINT AS failed, round(sum(ok) * 100.0 / count(*) FILTER (place = 0), 6)::DOUBLE AS success_rate,
  sum(seconds)::DOUBLE AS total_seconds, round(sum(seconds) / count(*) FILTER (place = 0), 6)::DOUBLE AS seconds_per_city,
  CASE WHEN sum(place) > 0 THEN round(sum(phone) * 100.0 / sum(place), 6)::DOUBLE END AS phone_pct, CASE WHEN sum(place) > 0 THEN round(sum(website) * 100.0 / sum(place), 6)::DOUBLE END AS website_pct
FROM u GROUP BY ROLLUP (state, city)
""")
def a17_national_summary(t: Tables) -> DataFrame:
    """Customers as places of their nation's run: each city, each state and the whole."""
    k = F.col("n_nationkey")
    cities = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(k, F.col("n_name").alias("city"), F.col("r_name").alias("state"), (50 + k).alias("expected"), (k * 1.5).alias("seconds"), (k % 4 > 0).alias("ok"))
    found = t.customer.join(cities, F.col("c_nationkey") == k)
    out = metrics.national_summary(found, cities, "city", "state", {"phone": F.col("c_acctbal") > 5000, "website": F.col("c_mktsegment") != "BUILDING"})
    return out.withColumns({c: F.round(c, 6) for c in ("pct", "success_rate", "seconds_per_city", "phone_pct", "website_pct")})


@query("SELECT floor(v * 10)::BIGINT * 10 || '-' || (floor(v * 10)::BIGINT * 10 + 9) || '%' AS bucket, CASE WHEN v >= 0.8 THEN 'high' WHEN v >= 0.5 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM (SELECT (p_partkey % 101) / 100.0::DOUBLE AS v FROM part) GROUP BY ALL")
def a18_deciles(t: Tables) -> DataFrame:
    """Parts by confidence: deciles, and tiers whose limits count as reached."""
    v = F.col("v")
    rows = t.part.select(((F.col("p_partkey") % 101) / 100.0).alias("v"))
    return rows.groupBy(metrics.decile(v).alias("bucket"), metrics.tier_from(v).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT floor(c_acctbal / 2000)::BIGINT || '.0-' || floor(c_acctbal / 2000)::BIGINT || '.9' AS bucket, CASE WHEN c_acctbal > 7000 THEN 'high' WHEN c_acctbal > 4000 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM customer GROUP BY ALL")
def a18_buckets(t: Tables) -> DataFrame:
    """Rating buckets and tiers."""
    c = F.col("c_acctbal")
    return t.customer.groupBy(metrics.rating_bucket(c / 2000).alias("bucket"), metrics.tier(c, 7000, 4000).alias("tier")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT user_id % 7 AS run, avg((event_type = 'purchase')::INT) AS r, min(event_id) AS o, count(*) FILTER (event_type = 'purchase') AS s, count(*) AS n FROM events GROUP BY 1)
SELECT arg_max(run, (r, -o)) AS best_run, round(max(r), 6) AS best_rate, round(sum(s) / sum(n), 6)::DOUBLE AS overall_rate FROM p
""")
def a19_compare_runs(t: Tables) -> DataFrame:
    """The best run."""
    out = metrics.compare_runs(t.events.withColumn("run", F.col("user_id") % 7), "run", F.col("event_type") == "purchase", "event_id")
    return out.select("best_run", F.round("best_rate", 6).alias("best_rate"), F.round("overall_rate", 6).alias("overall_rate"))


@query(f"SELECT array_to_string(list_sort(list(DISTINCT l)), ',') AS labels FROM (SELECT unnest(labels) AS l FROM {PARTS})")
def a20_distinct_union(t: Tables) -> DataFrame:
    """All labels."""
    return metrics.distinct_union(risky_parts(t), "labels").select(F.array_join("labels", ",").alias("labels"))


@query("SELECT round((avg(ok) + least(sum(ok * (user_id % 5)) / 1000.0, 1) + least(sum(ok * (user_id % 3)) / 500.0, 1)) / 3 * 100, 6)::DOUBLE AS score FROM (SELECT user_id, (event_type = 'purchase')::INT AS ok FROM events)")
def a22_pipeline_score(t: Tables) -> DataFrame:
    """One figure for a pipeline."""
    return metrics.pipeline_score(t.events, F.col("event_type") == "purchase", F.col("user_id") % 5, F.col("user_id") % 3).select(F.round("score", 6).alias("score"))


@query("""
SELECT c_custkey, round(c_acctbal / 2000 * 0.7 + least(coalesce(n, 0) * 30 / 100.0, 5) * 0.3, 4)::DOUBLE AS priority_score FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE c_mktsegment <> 'MACHINERY' ORDER BY c_acctbal / 2000 * 0.7 + least(coalesce(n, 0) * 30 / 100.0, 5) * 0.3 DESC, c_custkey LIMIT 500
""")
def s1_priority_select(t: Tables) -> DataFrame:
    """The places to look at first."""
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = t.customer.join(n, "c_custkey", "left").withColumn("url", F.when(F.col("c_mktsegment") != "MACHINERY", "u").otherwise(""))
    out = metrics.priority_select(rows, F.col("c_acctbal") / 2000, F.coalesce("n", F.lit(0)) * 30, F.col("url"), "c_custkey", 500)
    return out.select("c_custkey", F.round("priority_score", 4).alias("priority_score"))


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def s2_top_counts(t: Tables) -> DataFrame:
    """The ten most frequent names."""
    return metrics.top_counts(metrics.value_counts(t.part, F.col("p_name")), "value")


@query("SELECT user_id, event_type AS last_type, created_at FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def snk3_upsert(t: Tables) -> DataFrame:
    """The latest row of each key over an old and a new table, created when the key first came."""
    rows = t.events.select("user_id", F.col("event_type").alias("last_type"), "ts", F.col("ts").alias("created_at"))
    day = F.lit("2024-01-15").cast("timestamp")
    return store.upsert_by_key(rows.filter(F.col("ts") < day), rows.filter(F.col("ts") >= day), "user_id", "ts", "created_at").drop("ts")


@query("SELECT user_id, (ts::DATE)::VARCHAR AS day, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_rows, count(*) FILTER (event_type = 'purchase') AS n_successes, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'completed' ELSE 'failed' END AS status FROM events GROUP BY ALL")
def snk7_sessions(t: Tables) -> DataFrame:
    """A row for each run."""
    rows = t.events.withColumn("day", F.to_date("ts").cast("string"))
    return store.session_rows(rows, ["user_id", "day"], F.col("event_type") == "purchase", "ts", "ts")


@query("SELECT DISTINCT p_brand, p_type, sha256(p_brand || chr(31) || p_type) AS category_id FROM part")
def snk4_dimension(t: Tables) -> DataFrame:
    """Categories of each place, with keys that follow from their names; those of some brands are there already."""
    old = t.part.filter("p_size < 25").select("p_brand", "p_type").distinct().withColumn("category_id", store.surrogate("p_brand", "p_type"))
    return store.get_or_create_dim(t.part, old, ["p_brand", "p_type"], "category_id")


@query(f"SELECT p_partkey, label FROM (SELECT p_partkey, unnest(labels) AS label FROM {PARTS})")
def snk5_link_table(t: Tables) -> DataFrame:
    """The link table of nested items."""
    return store.normalise_items(labelled_parts(t), "p_partkey", "p_brand", "p_type", {"links": "labels"})["links"]


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u4_except_keys(t: Tables) -> DataFrame:
    """Rows without a match."""
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT label_of, n FROM (SELECT 'supplier' AS label_of, count(*) AS n FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_acctbal > 5000)")
def u3_union_sources(t: Tables) -> DataFrame:
    """Two sources with different columns as one."""
    a = t.supplier.select(F.lit("supplier").alias("label_of"), F.col("s_acctbal").alias("rating"), F.col("s_name").alias("name"))
    b = t.customer.select(F.lit("customer").alias("label_of"), F.col("c_acctbal").alias("rating"), F.col("c_mktsegment").alias("cuisine"))
    return a.unionByName(b, allowMissingColumns=True).filter("rating > 5000").groupBy("label_of").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, warn FROM (SELECT p_partkey, CASE WHEN contains(p_name, 'ring') AND NOT contains(p_name, 'red') THEN 'Low confidence detection for warm' ELSE '' END AS warn FROM part)")
def t20_warnings(t: Tables) -> DataFrame:
    """Warnings of low scores."""
    s = text.allergen_scores(F.lower("p_name"), {"warm": {"primary": {"red": 1.0}, "secondary": {"ring": 0.5}}})
    return t.part.select("p_partkey", F.array_join(text.low_score_warnings(s), ";").alias("warn"))
