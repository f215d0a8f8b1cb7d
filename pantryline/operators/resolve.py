"""Entity resolution of places across sources.

Pairs are found by a grid of latitude bands, each cut into as many cells of equal longitude as are wide enough for it, all round
the globe: both places of a pair lie in one cell or in neighbours, across the 180th meridian and near the poles too. One side is
given once for each cell that can hold its partners, and the join is on the cell. AQE splits cells that are crowded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pantryline.functions import geo, text
from pantryline.sources.shared import written


def _cells(df: DataFrame, lat: str, lon: str, dlat: float, dlon: float) -> DataFrame:
    return df.withColumns({"_cx": F.floor(F.col(lat) / dlat), "_cy": F.floor(F.col(lon) / dlon)})


def _round(df: DataFrame) -> DataFrame:
    """A row for each of the nine cells round a row's."""
    step = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    return df.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")}).drop("_dx", "_dy")


def _bands(lat: Column, within_m: float) -> Column:
    """The latitude band of a point; a pair lies in one or in two beside each other."""
    return F.floor(lat / (within_m / geo.M_PER_DEGREE * 1.0001))


def _cells_of_band(band: Column, within_m: float) -> Column:
    """How many cells a band has: each as wide as a pair within the distance can be apart in longitude there."""
    height = within_m / geo.M_PER_DEGREE * 1.0001
    top = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * height, F.lit(90.0))
    half = F.lit(math.sin(within_m / 2 / geo.EARTH_M) * 1.0001) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
    width = F.when(half < 1, F.degrees(F.asin(F.least(half, F.lit(1.0))) * 2)).otherwise(360.0)
    return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1))


def _cell(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * cells), cells)


def geo_cells(df: DataFrame, lat: str, lon: str, within_m: float, partners: bool) -> DataFrame:
    """``df`` with (_band, _cell): its own, or with ``partners`` a row for each that places within the distance can lie in."""
    own = _bands(F.col(lat), within_m)
    if not partners:
        return df.withColumn("_band", own).withColumn("_cell", _cell(F.col(lon), _cells_of_band(F.col("_band"), within_m)))
    rows = df.withColumn("_band", F.explode(F.array(own - 1, own, own + 1))).withColumn("_n", _cells_of_band(F.col("_band"), within_m))
    at = _cell(F.col(lon), F.col("_n"))
    return rows.withColumn("_cell", F.explode(F.array_distinct(F.array(*(F.pmod(at + d, F.col("_n")) for d in (-1, 0, 1)))))).drop("_n")


#: Pairs that a cell makes at most before names and phones are keys within it.
CROWDED = 100_000


def similar_names(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str, least: float) -> DataFrame:
    """(keys, x, y): pairs of names of one key with a similarity of ``least`` or more, without those of empty names. None is missing.

    A similarity bounds the edits by the longer name's length. A name of ``b`` is cut into one segment more than it can have edits
    with any partner, so one segment is whole in the partner, shifted by no more than the edits on either side allow (``least`` over
    a half keeps segments from being empty). Segments with their name's length are the join's key; the edit distance
    decides. Both sides are distinct names first, so equal names are compared once.
    """
    off, tiny = 1.0 - least, 1e-9
    whole = lambda c: F.floor(c + tiny).cast("int")
    edits = lambda n: whole(F.floor(n / least + tiny) * off)  # noqa: E731  with any partner
    cut = lambda i: F.floor(i * F.col("_n") / (F.col("_t") + 1)).cast("int")
    left, right = a.select(*keys, x).filter(F.col(x) != "").distinct(), b.select(*keys, y).filter(F.col(y) != "").distinct()
    index = right.withColumn("_n", F.length(y)).withColumn("_t", edits(F.col("_n"))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_t"))))
    index = index.withColumn("_s", F.substring(F.col(y), cut(F.col("_i")) + 1, cut(F.col("_i") + 1) - cut(F.col("_i")))).drop("_t")
    size = F.length(x)
    probe = left.withColumn("_n", F.explode(F.sequence(F.ceil(size * least - tiny).cast("int"), whole(size / least)))).withColumn("_t", edits(F.col("_n")))
    d, apart = whole(F.greatest(size, F.col("_n")) * off), size - F.col("_n")
    probe = probe.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_t")))).withColumn("_by", F.explode(F.sequence(F.ceil((apart - d) / 2).cast("int"), F.floor((apart + d) / 2).cast("int"))))
    at, long = cut(F.col("_i")) + F.col("_by"), cut(F.col("_i") + 1) - cut(F.col("_i"))
    probe = probe.filter((at >= 0) & (at + long <= size)).select(*keys, x, "_n", "_i", F.substring(F.col(x), at + 1, long).alias("_s")).distinct()
    within = F.call_function("levenshtein", F.col(x), F.col(y), whole(F.greatest(F.length(x), F.length(y)) * off))  # -1 if it is more
    return probe.join(index, [*keys, "_n", "_i", "_s"]).filter(within >= 0).select(*keys, x, y).distinct()


PLACE = ["name", "phone", "lat", "lon"]
MATCH = ["a_id", "a_pos", "b_id", "b_pos", "confidence", "distance_m", "name_similarity", "phone_match"]
#: Pairs of places that a task makes at most out of pairs of classes.
PAIRS_IN_TASK = 2_000_000


def _named_places(df: DataFrame) -> DataFrame:
    return df.filter("lat is not null and lon is not null").select("id", "pos", text.name_key(F.col("name")).alias("name"), text.phone_key(F.col("phone")).alias("phone"), "lat", "lon")


def place_classes(df: DataFrame) -> DataFrame:
    """(id, pos, name, phone, lat, lon, n): places that J1 can't tell apart as one, by their plain names and phones and their
    coordinates, with the first one's id and pos. Rows without coordinates are left out."""
    first = F.when(F.count("pos") < F.count("*"), F.min(F.when(F.col("pos").isNull(), F.col("id")))).otherwise(F.min_by("id", "pos"))  # as in an order, null is first
    return _named_places(df).groupBy(*PLACE).agg(first.alias("id"), F.when(F.count("pos") == F.count("*"), F.min("pos")).alias("pos"), F.count("*").alias("n"))


def geo_fuzzy_match(a: DataFrame, b: DataFrame, within_m: float = 100.0, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), least: float = 0.5, crowded: int = CROWDED, in_task: int = PAIRS_IN_TASK) -> DataFrame:
    """J1. Pairs within a distance with name, phone and nearness weighed into a confidence of ``least`` or more.

    ``a``, ``b``: (id, pos, name, lat, lon, phone). Out: a_id, a_pos, b_id, b_pos, confidence, distance_m,
    name_similarity, phone_match. Rows without coordinates match nothing.

    Places of equal plain name, phone and coordinates are one class; classes are compared (``class_pairs``), and only pairs that match are
    given for each of their places. There is a partition for each ``in_task`` pairs: where the ``a`` of a class of ``b`` make more, they
    are dealt over several shares, each of which meets all of the class.
    """
    pairs = written(class_pairs(place_classes(a), place_classes(b), within_m, weights, least, crowded).drop("a_id", "a_pos", "b_id", "b_pos"), "class-pairs")
    per_b = pairs.groupBy("_b").agg((F.sum("_na") * F.max("_nb")).alias("_pairs"), F.sum("_na").alias("_as"))
    shares = per_b.select("_b", "_pairs", F.least(F.ceil(F.col("_pairs") / in_task), F.col("_as")).cast("int").alias("_shares"))
    total = shares.agg(F.sum("_pairs")).first()[0] or 0
    parts = int(total // in_task) + int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def members(df: DataFrame, p: str) -> DataFrame:
        return _named_places(df).select(F.col("id").alias(f"{p}_id"), F.col("pos").alias(f"{p}_pos"), F.struct(*PLACE).alias(f"_{p}"))

    asides = pairs.join(shares.select("_b", "_shares"), "_b").join(members(a, "a"), "_a").withColumn("_share", F.pmod(F.xxhash64("a_id", "a_pos"), F.col("_shares")).cast("int"))
    asides = asides.drop("_a", "_na", "_nb", "_shares").repartition(parts, "_b", "_share")
    bsides = shares.select("_b", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share")).join(members(b, "b"), "_b").repartition(parts, "_b", "_share")
    return asides.join(bsides, ["_b", "_share"]).select(*MATCH)


def best_matches(a: DataFrame, b: DataFrame, decimals: int | None = None, **kwargs: object) -> DataFrame:
    """J1 and J2 in one: ``assign_one_to_one`` of all pairs of ``geo_fuzzy_match``, which are not made.

    The places of a class have equal scores, so all of ``a``'s try the same ``b``, of which the first of its class goes before the others;
    and the first of ``a``'s gets it. So the first places of classes decide. ``decimals``: to which confidences are rounded first.
    """
    pairs = class_pairs(place_classes(a), place_classes(b), **kwargs).select(*MATCH)
    return assign_one_to_one(pairs if decimals is None else pairs.withColumn("confidence", F.round("confidence", decimals)))


def class_pairs(a: DataFrame, b: DataFrame, within_m: float = 100.0, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), least: float = 0.5, crowded: int = CROWDED) -> DataFrame:
    """Pairs of ``place_classes``, by the first place of each; columns as of ``geo_fuzzy_match``, and those of the classes: _a, _b, _na, _nb.

    Cells that would make more than ``crowded`` pairs do not make them all: a pair without equal phones needs a name
    similarity of (least - nearness weight) / name weight, so there those meet that have equal phones, and those of
    ``similar_names``. Where the weights let names differ by a half and more, or nearness alone is enough, nothing can be left out.
    """
    cols = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "pos", "n", *PLACE)))
    left, right, cell = geo_cells(cols(a, "a"), "a_lat", "a_lon", within_m, False), geo_cells(cols(b, "b"), "b_lat", "b_lon", within_m, True), ["_band", "_cell"]
    name, phone, near = weights
    needed = (least - near) / name if name > 0 else 1.0
    full = None
    if needed > 0.5:
        counts = left.groupBy(*cell).agg(F.count("*").alias("_a")).join(right.groupBy(*cell).agg(F.count("*").alias("_b")), cell)
        full = written(counts.filter(F.col("_a") * F.col("_b") > crowded).select(*cell), "crowded")
    if full is None or full.isEmpty():
        pairs = left.join(right, cell)
    else:
        within = lambda df: df.join(full, cell, "left_semi")
        x, y, same = within(left), within(right), (F.col("a_phone") != "") & (F.col("a_phone") == F.col("b_phone"))
        calm = left.join(full, cell, "left_anti").join(right, cell)
        called = x.withColumn("_p", F.col("a_phone")).filter("_p != ''").join(y.withColumn("_p", F.col("b_phone")), [*cell, "_p"]).drop("_p")
        named = similar_names(x, y, cell, "a_name", "b_name", min(needed, 1.0)) if needed <= 1 else None
        pairs = calm.unionByName(called)
        if named is not None:
            pairs = pairs.unionByName(x.join(named, [*cell, "a_name"]).join(y, [*cell, "b_name"]).filter(~same).select(pairs.columns))
    pairs = pairs.withColumn("distance_m", geo.haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).filter(F.col("distance_m") <= within_m)
    pairs = pairs.withColumns({"name_similarity": text.name_similarity(F.col("a_name"), F.col("b_name")), "phone_match": F.when((F.col("a_phone") != "") & (F.col("a_phone") == F.col("b_phone")), 1.0).otherwise(0.0)})
    pairs = pairs.withColumn("confidence", F.col("name_similarity") * name + F.col("phone_match") * phone + (1.0 - F.col("distance_m") / within_m) * near)
    classes = [F.struct(*(F.col(f"{p}_{c}").alias(c) for c in PLACE)).alias(f"_{p}") for p in "ab"]
    return pairs.filter(F.col("confidence") >= least).select(*MATCH, *classes, F.col("a_n").alias("_na"), F.col("b_n").alias("_nb"))


def assign_one_to_one(pairs: DataFrame) -> DataFrame:
    """J2. Each ``a`` tries its best ``b`` only; the first ``a`` in order gets it, and the others stay alone."""
    best = Window.partitionBy("a_id").orderBy(F.desc("confidence"), "b_pos")
    first = Window.partitionBy("b_id").orderBy("a_pos")
    mine = pairs.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    kind = F.when((F.col("name_similarity") >= 0.8) & (F.col("phone_match") == 1), "name_phone_location").when(F.col("phone_match") == 1, "phone_location").otherwise("name_location")
    return mine.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r").withColumn("match_type", kind)


def merge_entities(a: DataFrame, b: DataFrame, matches: DataFrame, prefer: dict[str, str]) -> DataFrame:
    """J3. One row for each match. ``prefer``: column: the side, ``a`` or ``b``, whose value goes first if both give one."""
    left = a.select(F.col("id").alias("a_id"), *(F.col(c).alias(f"_a_{c}") for c in prefer if c in a.columns))
    right = b.select(F.col("id").alias("b_id"), *(F.col(c).alias(f"_b_{c}") for c in prefer if c in b.columns))
    both = matches.select("a_id", "b_id", "confidence", "match_type").join(left, "a_id").join(right, "b_id")

    def pick(c: str) -> Column:
        order = [f"_{s}_{c}" for s in (prefer[c], "ab".replace(prefer[c], "")) if f"_{s}_{c}" in both.columns]
        is_text = isinstance(both.schema[order[0]].dataType, T.StringType)
        return (text.first_present(*map(F.col, order)) if is_text else F.coalesce(*order)).alias(c)

    return both.select(F.concat_ws("_", F.lit("merged"), "a_id", "b_id").alias("id"), "a_id", "b_id", *map(pick, prefer), "confidence", "match_type", F.array(F.lit("a"), F.lit("b")).alias("data_sources"))


def unmatched(side: DataFrame, matches: DataFrame, key: str, label: str) -> DataFrame:
    """J4, U4. Rows of a side whose id no match has."""
    return side.join(matches.select(F.col(key).alias("id")), "id", "left_anti").withColumn("data_sources", F.array(F.lit(label)))


def merge_stats(a: DataFrame, b: DataFrame, matches: DataFrame) -> DataFrame:
    """A21. Matches, the rest of each side, the rate against the smaller side (null if one is empty) and the mean confidence."""
    counted = [df.select(F.lit(x).alias("side"), (F.col("confidence") if x == "m" else F.lit(None)).cast("double").alias("c")) for x, df in (("a", a), ("b", b), ("m", matches))]
    n = {x: F.count_if(F.col("side") == x) for x in "abm"}
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).agg(
        n["m"].alias("n_matches"),
        (n["a"] - n["m"]).alias("a_only"),
        (n["b"] - n["m"]).alias("b_only"),
        (F.try_divide(n["m"], F.least(n["a"], n["b"])) * 100).alias("match_rate"),
        F.coalesce(F.avg("c"), F.lit(0.0)).alias("mean_confidence"),
    )


#: Nodes and links that one task may pass over in the greedy choice: some 100 MB of kept ids.
IN_ONE_TASK = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id that each end of ``links`` (lo, hi), lo before hi, can reach.

    Star contraction: in turns each node hands its greater neighbours and its lesser ones to the least it knows. Each round is an
    aggregate and a join, written to the shared folder, and there are about as many as the logarithm of the longest path.
    """
    now, last = written(links.select("lo", "hi").distinct(), "links"), None
    while True:
        both = now.unionByName(now.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))  # lo: a node, hi: a neighbour
        least = both.groupBy("lo").agg(F.least(F.min("hi"), F.col("lo")).alias("m"))
        large = both.filter("hi > lo").join(least, "lo").select(F.col("m").alias("lo"), "hi").filter("lo < hi").distinct()
        large = written(large, "links")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("x"), F.explode(F.array("lo", "hi")).alias("hi"))
        now = written(small.select(F.col("x").alias("lo"), "hi").filter("lo < hi").distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())


def _greedy(rows: DataFrame) -> DataFrame:
    """Ids kept of rows (root, id, key, lo): nodes with a key, links without; a root's rows pass in the order of ids, in one task."""
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, kept, keys, blocked = None, set(), set(), None
        node, out = None, []

        def close() -> None:
            if node is not None and not blocked and node[1] not in keys:
                kept.add(node[0])
                keys.add(node[1])
                out.append(node[0])

        for batch in batches:
            for r, i, key, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node is None or r != root or i != node[0]:  # the node's own row comes before its links
                    close()
                    if r != root:
                        root, kept, keys = r, set(), set()
                    node, blocked = (i, key), False
                elif lo in kept:
                    blocked = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field("id").type)], names=["id"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field("id").type)], names=["id"])

    return rows.select("root", "id", "key", "lo").mapInArrow(run, T.StructType([T.StructField("id", kind)]))


def independent_set(nodes: DataFrame, edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """Nodes (id, key) that a pass in the order of ids keeps, when it drops each node that has an edge to a kept earlier
    one, or the key of one. Null is a key too.

    ``edges``: (lo, hi), lo before hi. Nodes without edges are settled by an aggregate. The others, with their links, pass through
    one task if they are at most ``in_one_task``; else each connected component (by edges and keys) passes alone, in the task that it
    falls to, and components over that number go in rounds (``_rounds``). No pairs are made within a key.
    """
    nodes = nodes.select("id", F.coalesce(F.concat(F.lit("+"), "key"), F.lit("-")).alias("key"))
    edges = written(edges.select("lo", "hi").distinct(), "edges")
    ends = edges.select(F.col("hi").alias("id")).unionByName(edges.select(F.col("lo").alias("id"))).distinct()
    busy_keys = nodes.join(ends, "id", "left_semi").select("key").distinct()
    busy = written(nodes.join(busy_keys, "key", "left_semi").select("id", "key"), "open")
    calm = nodes.join(busy_keys, "key", "left_anti").groupBy("key").agg(F.min("id").alias("id")).select("id")
    no_key, no_lo = F.lit(None).cast("string"), F.lit(None).cast(nodes.schema["id"].dataType)
    rows = busy.select("id", "key", no_lo.alias("lo")).unionByName(edges.select(F.col("hi").alias("id"), no_key.alias("key"), "lo"))
    order = ["root", "id", F.asc_nulls_first("lo")]
    if busy.count() + edges.count() <= in_one_task:
        return calm.unionByName(_greedy(rows.withColumn("root", F.lit(0)).coalesce(1).sortWithinPartitions(*order)))
    hubs = busy.join(busy.groupBy("key").agg(F.min("id").alias("lo")), "key").filter("lo < id").select("lo", F.col("id").alias("hi"))
    roots = written(components(edges.unionByName(hubs)), "roots")
    rooted = rows.join(roots, "id")
    large = written(rooted.groupBy("root").count().filter(F.col("count") > in_one_task).select("root"), "large")
    small = rooted.join(large, "root", "left_anti").repartition("root").sortWithinPartitions(*order)
    kept = calm.unionByName(_greedy(small))
    if large.isEmpty():
        return kept
    rest = written(rooted.join(large, "root", "left_semi"), "rest")
    return kept.unionByName(_rounds(rest.filter("lo is null").select("id", "key"), rest.filter("lo is not null").select("lo", F.col("id").alias("hi"))))


def _rounds(open_nodes: DataFrame, left: DataFrame) -> DataFrame:
    """As ``independent_set``, for components of any size: in a round those nodes are kept that are the first undecided ones of their
    key and have no undecided earlier neighbour; their key's others and their neighbours go. As many rounds as the longest rising chain."""
    kept = open_nodes.select("id").limit(0)
    while not open_nodes.isEmpty():
        first = open_nodes.groupBy("key").agg(F.min("id").alias("id"))
        take = written(first.join(left.select(F.col("hi").alias("id")), "id", "left_anti").select("id", "key"), "take")
        near = left.join(take.select(F.col("id").alias("lo")), "lo", "left_semi").select(F.col("hi").alias("id"))
        fellows = open_nodes.join(take.select("key"), "key", "left_semi").select("id")
        done = written(near.unionByName(fellows).distinct(), "done")
        kept = kept.unionByName(take.select("id"))
        open_nodes = written(open_nodes.join(done, "id", "left_anti").select("id", "key"), "open")
        for side in ("lo", "hi"):
            left = left.join(done.withColumnRenamed("id", side), side, "left_anti")
        left = written(left.select("lo", "hi"), "edges")
    return kept


def union_dedupe(a: DataFrame, b: DataFrame, degrees: float = 0.001) -> DataFrame:
    """J5. All of ``a``, and the rows of ``b`` in order that duplicate neither ``a`` nor an accepted row of ``b``.

    (id, pos, name, lat, lon). A duplicate has the same plain name, or lies within ``degrees`` each way while one name
    contains the other.
    """
    plain = lambda df: df.withColumn("_key", text.name_key_plain(F.col("name")))
    a, b = plain(a), plain(b)
    near = (F.abs(F.col("lat") - F.col("o_lat")) < degrees) & (F.abs(F.col("lon") - F.col("o_lon")) < degrees) & (F.contains("_key", "o_key") | F.contains("o_key", "_key"))
    fresh = b.join(a.select("_key").distinct(), "_key", "left_anti")
    other = lambda df: df.select(F.col("id").alias("o_id"), F.col("pos").alias("o_pos"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("_key").alias("o_key"), "_cx", "_cy")
    cells = lambda df: _cells(df.filter("lat is not null and lon is not null"), "lat", "lon", degrees, degrees)
    hit = _round(cells(fresh)).join(other(cells(a)), ["_cx", "_cy"]).filter(near).select("id").distinct()
    fresh = fresh.join(hit, "id", "left_anti")
    close = _round(cells(fresh)).join(other(cells(fresh)), ["_cx", "_cy"]).filter(near & (F.col("o_pos") < F.col("pos"))).select(F.col("o_pos").alias("lo"), F.col("pos").alias("hi"))
    stay = independent_set(fresh.select(F.col("pos").alias("id"), F.col("_key").alias("key")), close).withColumnRenamed("id", "pos")
    return a.drop("_key").unionByName(fresh.join(stay, "pos", "left_semi").select(*b.columns).drop("_key"))
