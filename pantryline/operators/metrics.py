"""Counts, coverage and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, value: Column, name: str = "value", default: str = "Unknown") -> DataFrame:
    """A4, S3. Rows of each value; null and '' count as ``default``."""
    return df.groupBy(F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(default)).alias(name)).agg(F.count("*").alias("n"))


def array_value_counts(df: DataFrame, values: Column, name: str = "value") -> DataFrame:
    """A5. Rows of each element of lists."""
    return df.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def label_reach(df: DataFrame, labels: str, place: str, name: str = "label") -> DataFrame:
    """A6. Items and distinct places of each label."""
    return df.select(place, F.explode(labels).alias(name)).groupBy(name).agg(F.count("*").alias("n_items"), F.count_distinct(place).alias("n_places"))


def coverage(df: DataFrame, **given: Column) -> DataFrame:
    """A7. The percentage of rows for which each condition holds, as one row; 0 without rows."""
    return df.agg(*(F.coalesce(F.avg(F.coalesce(c.cast("int"), F.lit(0))) * 100, F.lit(0.0)).alias(name) for name, c in given.items()))


def quality_metrics(df: DataFrame, n_items: Column, has: dict[str, Column], last_checked: Column, as_of: Column, status: Column) -> DataFrame:
    """A8, D1. Totals, places with items and with each thing, mean items over those with any, mean age in hours, % in error.

    ``last_checked``: text; what is no timestamp is left out of the mean.
    """
    age = (F.unix_micros(as_of) - F.unix_micros(last_checked.try_cast("timestamp"))) / 3.6e9
    with_items = F.when(n_items > 0, n_items)
    return df.agg(
        F.count("*").alias("total"),
        F.count(with_items).alias("with_menus"),
        *(F.count_if(c).alias(f"with_{k}") for k, c in has.items()),
        F.coalesce(F.avg(with_items), F.lit(0.0)).alias("avg_items"),
        F.coalesce(F.avg(age), F.lit(0.0)).alias("freshness_hours"),
        F.coalesce(F.avg(F.coalesce(status.startswith("error"), F.lit(False)).cast("int")) * 100, F.lit(0.0)).alias("error_rate"),
    )


def overall_risk(high: Column, low: Column, n: Column) -> Column:
    """A9. Over 30 % of items high: high; over 10 %: medium; any low: low; else unknown."""
    share = F.try_divide(high, n) * 100
    return F.when(share > 30, "high").when(share > 10, "medium").when(low > 0, "low").otherwise("unknown")


def place_risk(places: DataFrame, items: DataFrame, key: str, risk: str, labels: str) -> DataFrame:
    """A9. Of each place: items by risk level, overall risk, and the percentage of items with labels."""
    levels = ("high", "medium", "low", "unknown")
    g = items.groupBy(key).agg(F.count("*").alias("n_items"), *(F.count_if(F.col(risk) == x).alias(f"n_{x}") for x in levels), F.count_if(F.size(labels) > 0).alias("_labelled"))
    out = places.select(key).distinct().join(g, key, "left").fillna(0)
    return out.withColumns({"overall_risk": overall_risk(F.col("n_high"), F.col("n_low"), F.col("n_items")), "coverage_pct": F.coalesce(F.try_divide(F.col("_labelled") * 100.0, F.col("n_items")), F.lit(0.0))}).drop("_labelled")


def corpus_analysis(items: DataFrame, key: str, risk: str, labels: str, tiers: tuple[tuple[int, int], ...] = ((100, 50), (50, 20), (20, 0))) -> DataFrame:
    """A10. Places, items, detections, high-risk items, mean items a place, % of places with labels, and a readiness tier."""
    by_place = items.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.size(labels)).alias("d"), F.count_if(F.col(risk) == "high").alias("h"), F.count_if(F.size(labels) > 0).alias("w"))
    out = by_place.agg(F.count("*").alias("n_places"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_detections"), F.coalesce(F.sum("h"), F.lit(0)).alias("n_high_risk"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_items"), F.coalesce(F.avg((F.col("w") > 0).cast("int")) * 100, F.lit(0.0)).alias("labelled_places_pct"))
    (a, b), (c, d), (e, _) = tiers
    tier = F.when((F.col("n_items") > a) & (F.col("n_detections") > b), "ready").when((F.col("n_items") > c) & (F.col("n_detections") > d), "nearly").when(F.col("n_items") > e, "started").otherwise("insufficient")
    return out.withColumn("readiness", tier)


def analysis_summary(items: DataFrame, key: str, risk: str, labels: str, top: int = 10) -> DataFrame:
    """A12. One row: places and items, the percentage of each with labels, items by risk level, and the ``top`` most frequent labels.

    Levels and labels are vocabularies, so their maps are small.
    """
    by_place = items.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.size(labels) > 0).alias("w"))
    share = lambda a, b: F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))
    base = by_place.agg(F.count("*").alias("n_places"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), share(F.count_if(F.col("w") > 0), F.count("*")).alias("labelled_places_pct"), share(F.sum("w"), F.sum("n")).alias("labelled_items_pct"))
    pairs = lambda order: F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct(*order, "n"))), lambda x: F.struct(x["value"], x["n"])))
    risks = value_counts(items, F.col(risk), default="unknown").agg(pairs(["value"]).alias("risk_distribution"))
    frequent = top_counts(array_value_counts(items, F.col(labels)), "value", top).withColumn("_o", -F.col("n"))
    labelled = frequent.agg(pairs(["_o", "value"]).alias("top_labels"))
    one = F.lit(1).alias("_k")
    return base.select("*", one).join(risks.select("*", one), "_k").join(labelled.select("*", one), "_k").drop("_k")


def health_score(items: DataFrame, key: str, labels: str, tags: str, category: str) -> DataFrame:
    """A11. The mean of label transparency, 20 a tag, 15 a category (each at most 100) and a component that stays 0."""
    tagged = items.select(key, F.explode(tags).alias("_t")).groupBy(key).agg(F.count_distinct("_t").alias("n_tags"))
    g = items.groupBy(key).agg((F.avg((F.size(labels) > 0).cast("int")) * 100).alias("transparency"), F.count_distinct(F.coalesce(category, F.lit("unknown"))).alias("n_categories"))
    out = g.join(tagged, key, "left").fillna(0, ["n_tags"])
    score = (F.col("transparency") + F.least(F.col("n_tags") * 20, F.lit(100)) + F.least(F.col("n_categories") * 15, F.lit(100))) / 4
    return out.withColumn("score", score).withColumn("rating", F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor"))


def item_quality(name: Column, price: Column, description: Column, labels: Column, tags: Column, category: Column) -> Column:
    """A13. Presence of name (over 3 characters), price, description (over 10), labels, tags and a category, weighed to 1."""
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    return one(F.length(name) > 3, 0.3) + one(price.isNotNull(), 0.2) + one(F.length(description) > 10, 0.2) + one(F.size(labels) > 0, 0.15) + one(F.size(tags) > 0, 0.1) + one(category != "other", 0.05)


def extraction_quality(items: DataFrame, keys: list[str], profile: str, price: Column, description: Column, labels: Column, category: Column, confidence: Column) -> DataFrame:
    """A13. Mean quality of each key's items by a named profile.

    ``weighted``: 0.3 a price, 0.3 a description over 10 characters, 0.2 labels, 0.2 of the confidence. ``shares``: half of the mean
    confidence, 0.3 of the share with a price, 0.2 of that with a category. ``mean``: of confidence, price and description shares.
    """
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    some = lambda c: one(c.isNotNull() & (c.cast("string") != ""))
    sure = F.coalesce(confidence, F.lit(0.0))
    parts = {
        "weighted": [(some(price), 0.3), (one(F.length(description) > 10), 0.3), (one(F.size(labels) > 0), 0.2), (sure, 0.2)],
        "shares": [(sure, 0.5), (some(price), 0.3), (one(category != "other"), 0.2)],
        "mean": [(sure, 1 / 3), (some(price), 1 / 3), (some(description), 1 / 3)],
    }[profile]
    total = F.lit(0.0)
    for c, w in parts:
        total = total + c * w
    return items.groupBy(*keys).agg(F.avg(total).alias("quality"))


def error_histogram(df: DataFrame, error: Column) -> DataFrame:
    """A14, A4. Rows of each class of error, what stands before the first ``:``; rows without an error are left out."""
    return value_counts(df.filter(F.coalesce(error != "", F.lit(False))), F.split(error, ":")[0], "error")


def session_metrics(items: DataFrame, price: Column, labels: Column, confidence: Column, method: Column) -> DataFrame:
    """A15. One row: items, those with a price and with labels, the mean of the confidences that are numbers (text with ``$`` and ``,``
    counts), and items by method."""
    number = F.regexp_replace(F.trim(confidence.cast("string")), r"[$,]", "").try_cast("double")
    base = items.agg(F.count("*").alias("total_items"), F.count_if((price.cast("string") != "") & (price.cast("string") != "0")).alias("items_with_prices"), F.count_if(F.size(labels) > 0).alias("items_with_labels"), F.coalesce(F.avg(number), F.lit(0.0)).alias("average_confidence"))
    methods = value_counts(items, method, default="unknown").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("extraction_methods"))
    one = F.lit(1).alias("_k")
    return base.select("*", one).join(methods.select("*", one), "_k").drop("_k")


def run_metrics(df: DataFrame, success: Column, items: Column, seconds: Column, priced: Column, labels: Column | None = None) -> DataFrame:
    """A14. One row: totals, success rate, items a success, times, throughput, and recommendations.

    ``labels``: how many labels a row found; adds successes with any and the mean over successes.
    """
    took = F.when(seconds > 0, seconds)
    out = df.agg(
        F.count("*").alias("total"),
        F.count_if(success).alias("successful"),
        F.coalesce(F.sum(F.when(success, items)), F.lit(0)).alias("total_items"),
        F.coalesce(F.avg(took), F.lit(0.0)).alias("avg_seconds"),
        F.coalesce(F.min(took), F.lit(0.0)).alias("fastest"),
        F.coalesce(F.max(took), F.lit(0.0)).alias("slowest"),
        F.count_if(success & priced).alias("with_prices"),
        *([] if labels is None else [F.count_if(success & (labels > 0)).alias("with_labels"), F.coalesce(F.avg(F.when(success, labels)), F.lit(0.0)).alias("labels_per_success")]),
    )
    out = out.withColumn("success_rate", F.coalesce(F.try_divide(F.col("successful") * 100.0, F.col("total")), F.lit(0.0)))
    return out.withColumns(
        {
            "items_per_success": F.coalesce(F.try_divide(F.col("total_items") * 1.0, F.col("successful")), F.lit(0.0)),
            "per_hour": F.coalesce(F.try_divide(F.lit(3600.0), F.col("avg_seconds")), F.lit(0.0)),
            "hours_for_1000": F.col("avg_seconds") * 1000 / 3600,
            "daily_capacity": F.coalesce(F.try_divide(F.lit(28800.0), F.col("avg_seconds")), F.lit(0.0)),
            "batch_size": F.when(F.col("success_rate") > 30, 25).otherwise(15),
            "pause_minutes": F.when(F.col("success_rate") > 40, 2).otherwise(5),
            "readiness": F.least(F.lit(100.0), F.col("success_rate") * 2),
        }
    )


def batch_performance(df: DataFrame, batch: str, success: Column) -> DataFrame:
    """A16. Rows and successes of each batch."""
    return df.groupBy(batch).agg(F.count("*").alias("total"), F.count_if(success).alias("successful"))


def city_rollup(found: DataFrame, cities: DataFrame, key: str) -> DataFrame:
    """A17, J9, S4. Of each city (key, expected, priority): places found, and their percentage of the expected."""
    n = found.groupBy(key).agg(F.count("*").alias("found"))
    return cities.join(n, key, "left").fillna(0, ["found"]).withColumn("pct", F.coalesce(F.try_divide(F.col("found") * 100.0, F.col("expected")), F.lit(0.0)))


def national_summary(found: DataFrame, cities: DataFrame, city: str, state: str, present: dict[str, Column], seconds: str = "seconds", ok: str = "ok") -> DataFrame:
    """A17. A row for each city, each state and the nation (``level``), from one aggregate with ``rollup``.

    ``found``: places with their city and state; ``present``: name: whether a place has such a field, whose coverage is
    ``<name>_pct``. ``cities``: (city, state, expected, seconds, ok), a row for each city that was run. Out: n_cities, found, expected,
    pct (of the expected), successful and failed cities, success_rate, total_seconds, seconds_per_city and the coverages; rates
    are null where there is nothing to divide by. Null cities and states count as ``unknown``.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    none = F.lit(None)
    places = found.select(named(city), named(state), F.lit(1).alias("_place"), *(F.coalesce(p, F.lit(False)).cast("int").alias(f"_{x}") for x, p in present.items()), none.cast("long").alias("_expected"), none.cast("double").alias("_seconds"), none.cast("int").alias("_ok"))
    runs = cities.select(named(city), named(state), F.lit(0).alias("_place"), *(none.cast("int").alias(f"_{x}") for x in present), F.col("expected").cast("long").alias("_expected"), F.col(seconds).cast("double").alias("_seconds"), F.coalesce(F.col(ok), F.lit(False)).cast("int").alias("_ok"))
    n_cities, n, good = F.count_if(F.col("_place") == 0), F.sum("_place"), F.coalesce(F.sum("_ok"), F.lit(0))
    share = lambda a, b: F.try_divide(a * 100.0, b)
    expected, time = F.coalesce(F.sum("_expected"), F.lit(0)), F.coalesce(F.sum("_seconds"), F.lit(0.0))
    level = F.element_at(F.array(F.lit("city"), F.lit("state"), F.lit("?"), F.lit("nation")), F.grouping_id().cast("int") + 1)
    return (
        places.unionByName(runs)
        .rollup(state, city)
        .agg(
            level.alias("level"),
            n_cities.alias("n_cities"),
            n.alias("found"),
            expected.alias("expected"),
            share(n, expected).alias("pct"),
            good.alias("successful"),
            (n_cities - good).alias("failed"),
            share(good, n_cities).alias("success_rate"),
            time.alias("total_seconds"),
            F.try_divide(time, n_cities).alias("seconds_per_city"),
            *(share(F.coalesce(F.sum(f"_{x}"), F.lit(0)), n).alias(f"{x}_pct") for x in present),
        )
    )


def rating_bucket(c: Column) -> Column:
    """A18. ``4.0-4.9`` for 4.3."""
    return F.concat(F.floor(c).cast("string"), F.lit(".0-"), F.floor(c).cast("string"), F.lit(".9"))


def tier(c: Column, high: float = 0.7, medium: float = 0.4) -> Column:
    """A18. high, medium or low."""
    return F.when(c > high, "high").when(c > medium, "medium").otherwise("low")


def decile(c: Column) -> Column:
    """A18. ``80-89%`` for 0.87; ``100-109%`` for 1."""
    low = F.floor(c * 10) * 10
    return F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string"), F.lit("%"))


def tier_from(c: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    """A18. high, medium or low, the limits included."""
    return F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low")


def compare_runs(df: DataFrame, run: str, success: Column, order: str) -> DataFrame:
    """A19. One row: the run with the highest success rate, the first of equals, its rate, and the rate over all rows."""
    per = df.groupBy(run).agg(F.avg(success.cast("int")).alias("r"), F.min(order).alias("o"), F.count_if(success).alias("s"), F.count("*").alias("n"))
    return per.agg(F.max_by(run, F.struct(F.col("r"), -F.col("o"))).alias("best_run"), F.max("r").alias("best_rate"), (F.sum("s") / F.sum("n")).alias("overall_rate"))


def distinct_union(df: DataFrame, labels: str) -> DataFrame:
    """A20. One row: the sorted distinct labels of all lists. There are as many as the vocabulary has."""
    return df.select(F.explode(labels).alias("x")).distinct().agg(F.sort_array(F.collect_list("x")).alias(labels))


def pipeline_score(df: DataFrame, success: Column, places: Column, menus: Column) -> DataFrame:
    """A22. The mean of the success share, places over 1,000 and menus over 500 (at most 1 each), times 100."""
    got = lambda c: F.coalesce(F.sum(F.when(success, c)), F.lit(0))
    out = df.agg(F.avg(success.cast("int")).alias("rate"), got(places).alias("places"), got(menus).alias("menus"))
    return out.withColumn("score", (F.col("rate") + F.least(F.col("places") / 1000, F.lit(1.0)) + F.least(F.col("menus") / 500, F.lit(1.0))) / 3 * 100)


def top_counts(counts: DataFrame, value: str, k: int = 10) -> DataFrame:
    """S2. The ``k`` most frequent values, equal ones in alphabetical order."""
    return counts.orderBy(F.desc("n"), value).limit(k)


def priority_select(df: DataFrame, rating: Column, reviews: Column, url: Column, position: str, n: int) -> DataFrame:
    """S1. The ``n`` rows with a URL that score highest on 0.7 rating + 0.3 min(reviews / 100, 5)."""
    score = F.coalesce(rating, F.lit(0.0)) * 0.7 + F.least(F.coalesce(reviews, F.lit(0)) / 100, F.lit(5.0)) * 0.3
    return df.filter(F.coalesce(url != "", F.lit(False))).withColumn("priority_score", score).orderBy(F.desc("priority_score"), position).limit(n)
