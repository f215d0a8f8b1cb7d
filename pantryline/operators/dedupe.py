"""Duplicates, ranks and choices within groups. "First" is always by an explicit ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pantryline.operators.resolve import independent_set
from pantryline.sources.shared import written


def join_by(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``other``, joined by equal keys; null equals null."""
    there = other.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    on = [df[k].eqNullSafe(there[f"_key{i}"]) for i, k in enumerate(keys)]
    return df.join(there, on, how).drop(*(f"_key{i}" for i in range(len(keys))))


def first_wins(df: DataFrame, keys: list[Column | str], ordinal: str) -> DataFrame:
    """W3. The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def first_wins_backfill(df: DataFrame, keys: list[str], ordinal: str, column: str, unknown: str = "unknown") -> DataFrame:
    """W4. The first row of each key; where its ``column`` is unknown or null, the first known value after it."""
    known = F.when(F.col(column).isNotNull() & (F.col(column) != unknown), F.col(column))
    fill = df.groupBy(*keys).agg(F.min_by(known, F.when(known.isNotNull(), F.col(ordinal))).alias("_fill"))
    out = join_by(first_wins(df, keys, ordinal), fill, keys, "left")
    return out.withColumn(column, F.when(F.col(column).isNull() | (F.col(column) == unknown), F.coalesce("_fill", F.col(column))).otherwise(F.col(column))).select(df.columns)


def best_per_group(df: DataFrame, keys: list[str], value: str, confidence: str, sources: str, ordinal: str) -> DataFrame:
    """W1. Of each key the ``value`` with the highest (confidence, number of sources), the first of equals, and all sources.

    Sources are exploded, so a key's set is merged from partial ones and holds each source once.
    """
    rows = df.withColumn("_size", F.size(sources)).withColumn("_source", F.explode_outer(sources))
    order = F.struct(F.col(confidence), F.col("_size"), -F.col(ordinal))
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(confidence).alias(confidence), F.sort_array(F.collect_set("_source")).alias(sources))


def merge_candidates(df: DataFrame, keys: list[str], fields: list[str], priority: str, confidence: str, labels: str, ordinal: str, boost: float = 0.1, skip: dict[str, str] | None = None) -> DataFrame:
    """W2. One row a key: each field's first given value by (confidence, priority, ordinal), all labels, a higher confidence.

    Each further candidate adds ``boost``, up to 1. ``skip``: field: the value that counts as not given beside null and '' (as ``other``
    of a category); a field that no candidate gives is that value. Every field is an aggregate of its own, merged from partial ones.
    """
    skip = skip or {}
    order = F.struct(-F.col(confidence), -F.col(priority), F.col(ordinal))

    def first_given(f: str) -> Column:
        given = F.col(f).isNotNull() & ~F.col(f).cast("string").isin("", *([skip[f]] if f in skip else []))
        found = F.min_by(f, F.when(given, order))
        return (F.coalesce(found, F.lit(skip[f])) if f in skip else found).alias(f)

    rows = df.select("*", F.posexplode_outer(labels).alias("_at", "_label"))
    n = F.count_if(F.coalesce("_at", F.lit(0)) == 0)
    return rows.groupBy(*keys).agg(*map(first_given, fields), F.sort_array(F.collect_set("_label")).alias(labels), F.least(F.max(confidence) + boost * (n - 1), F.lit(1.0)).alias(confidence), n.cast("int").alias("n_candidates"))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """W5. The first ``n`` rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def next_line_price(lines: DataFrame, keys: list[str], ordinal: str, line: str, price: Column, food: Column) -> DataFrame:
    """W6. Food lines with ``price`` (text): their own, or that of the next line if they have none and it is nothing else."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    out = lines.withColumns({"_own": F.nullif(price, F.lit("")), "_food": food})
    out = out.withColumn("_next", F.lead(F.when(~F.col("_food"), F.col("_own"))).over(w))
    return out.filter("_food").withColumn("price", F.coalesce("_own", "_next")).drop("_own", "_food", "_next")


def batches(df: DataFrame, order: list[str], size: int, partition: list[str] | None = None) -> DataFrame:
    """W7. batch (from 1) and position in it of each row in order.

    Without ``partition`` the order is over all rows: ranges of it are numbered apart and their counts added, so no task
    gets all rows. The ranges are written before they are counted: two plans of them need not cut alike.
    """
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order)
        out = df.withColumn("_n", F.row_number().over(w).cast("long"))
    else:
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
        ranged = written(ranged.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id") % (1 << 33)}), "ranges")
        counts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))  # a row a partition
        first = counts.withColumn("_first", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).drop("_c")
        out = ranged.join(F.broadcast(first), "_part").withColumn("_n", F.col("_first") + F.col("_at") + 1).drop("_id", "_part", "_at", "_first")
    return out.withColumns({"batch": F.expr(f"(_n - 1) div {size} + 1"), "position": (F.col("_n") - 1) % size + 1}).drop("_n")


def similarity_dedupe(df: DataFrame, keys: list[str], words: str, ordinal: str, over: float = 0.8) -> DataFrame:
    """W9. Per key, rows in order, each dropped if its word set has a Jaccard similarity over ``over`` with a kept one.

    Without keys over all rows. Out: keys, ordinal and words of the kept rows; ordinals are unique. Rows with one word set are one
    node, the first. Nodes are compared if they share one of their rarest words, as many as a pair over the limit must share one
    of (prefix filter), so no pair is lost; the greedy pass then goes over the links (``independent_set``). Null keys are a key.
    """
    words_of = F.sort_array(F.array_distinct(words))
    rows = df.select(*keys, F.col(ordinal).alias("_o"), F.col(words).alias("_w"), words_of.alias("_set"))
    nodes = written(rows.groupBy(*keys, "_set").agg(F.min("_o").alias("_o")), "word-sets")
    pairs = word_set_candidates(nodes, keys, over)
    side = lambda o, w: nodes.select(F.col("_o").alias(o), F.col("_set").alias(w))
    both = pairs.join(side("lo", "_x"), "lo").join(side("hi", "_y"), "hi")
    alike = F.size(F.array_intersect("_x", "_y")) / F.size(F.array_union("_x", "_y")) > over
    stay = independent_set(nodes.select(F.col("_o").alias("id"), F.col("_o").cast("string").alias("key")), both.filter(alike).select("lo", "hi"))
    kept = rows.join(stay.withColumnRenamed("id", "_o"), "_o", "left_semi")
    return kept.select(*keys, F.col("_o").alias(ordinal), F.col("_w").alias(words))


def word_set_candidates(nodes: DataFrame, keys: list[str], over: float) -> DataFrame:
    """W9. Pairs (lo, hi) of nodes (keys, _o, _set) of one key that can have a Jaccard similarity over ``over``; no such pair is missing.

    Sets share one of their rarest words. At the first word that a pair shares, no more words are left to share than either set has
    from there on (position filter); and words that only one of two sets has show in the sets' 64-bit signatures (suffix
    bound). Both are tested as the index is joined.
    """
    bit = F.transform("_set", lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int")))
    signature = F.aggregate(bit, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    each = nodes.select(*keys, "_o", F.size("_set").alias("_n"), signature.alias("_b"), F.explode("_set").alias("_t"))
    often = each.groupBy(*keys, "_t").agg(F.count("*").alias("_f"))
    ranked = join_by(each, often, [*keys, "_t"]).groupBy(*keys, "_o", "_n", "_b").agg(F.sort_array(F.collect_list(F.struct("_f", "_t"))).alias("_r"))
    prefix = F.slice("_r", F.lit(1), F.col("_n") - F.ceil(F.col("_n") * over).cast("int") + 1)
    keyed = written(ranked.select(*keys, "_o", "_n", "_b", F.posexplode(F.transform(prefix, lambda x: x["_t"])).alias("_at", "_t")), "prefixes")
    other = keyed.withColumnsRenamed({"_o": "_hi", "_n": "_m", "_b": "_c", "_at": "_to"})
    most = F.least(F.col("_n") - F.col("_at"), F.col("_m") - F.col("_to"))
    needed = (F.col("_n") + F.col("_m")) * (over / (1 + over)) - 1e-9
    apart = F.bit_count(F.col("_b").bitwiseXOR(F.col("_c")))
    near = (F.col("_o") < F.col("_hi")) & (F.least("_n", "_m") >= F.greatest("_n", "_m") * over) & (most >= needed) & (F.col("_n") + F.col("_m") - apart >= needed * 2)
    return join_by(keyed, other, [*keys, "_t"]).filter(near).select(F.col("_o").alias("lo"), F.col("_hi").alias("hi")).distinct()


def cascade(df: DataFrame, keys: list[str], rank: str, thresholds: list[int]) -> DataFrame:
    """U2. Strategies by rank from 0: strategy ``k`` counts only if the kept ones before it gave under ``thresholds[k]`` rows."""
    counts = df.groupBy(*keys).agg(*(F.count_if(F.col(rank) == k).alias(f"_n{k}") for k in range(len(thresholds))))
    total, use = F.lit(0), []
    for k, least in enumerate(thresholds):
        use.append((total < least) if k else F.lit(True))
        total = total + F.when(use[k], F.col(f"_n{k}")).otherwise(0)
    flags = counts.select(*keys, F.array(*use).alias("_use"))
    return join_by(df, flags, keys).filter(F.element_at("_use", (F.col(rank) + 1).cast("int"))).select(df.columns)


def source_fallback(df: DataFrame, key: str, source: str, name: str, price: str, ordinal: str, enough: int = 5) -> DataFrame:
    """U5. ``primary`` rows if there are enough; else ``fallback`` rows if they are more; else both, by (name, price).

    Out: the rows with ``label``: primary_url, fallback_website, combined or primary_url_only.
    """
    n = df.groupBy(key).agg(F.count_if(F.col(source) == "primary").alias("_p"), F.count_if(F.col(source) == "fallback").alias("_f"))
    label = F.when(F.col("_p") >= enough, "primary_url").when(F.col("_f") > F.col("_p"), "fallback_website").when(F.col("_f") > 0, "combined").otherwise("primary_url_only")
    both = join_by(df, n.select(key, label.alias("label")), [key])
    one = both.filter(((F.col("label").isin("primary_url", "primary_url_only")) & (F.col(source) == "primary")) | ((F.col("label") == "fallback_website") & (F.col(source) == "fallback")))
    mixed = first_wins(both.filter("label = 'combined'"), [key, name, price], ordinal)
    return one.unionByName(mixed)
