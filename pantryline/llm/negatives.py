"""Hard negatives: rows of another label that score nearly as high for an anchor as one of its own label does.

Scores are inner products of whole numbers. Method (anchor-clustered shared lists): anchors are clustered by angle; for each
cluster all rows are sorted once by an upper bound of their score with any member of length one,
``|row| * cos(max(0, angle to the centre - widest angle of a member))``; every member walks its cluster's list and stops where
the bound, times its own length, is under what it still needs. So what it has found is exact, wherever the clusters lie.

A first walk finds an anchor's positives, the ``n_positives`` best other rows of its label. A second finds, for each of them, the
``n_negatives`` best rows of other labels whose score is at least ``low`` and at most ``high`` hundredths of the positive's.

On Spark: centres come from at most ``SAMPLE`` anchors, by the order of a hash (they decide how early walks stop, not what they find);
lists are one range-sorted table in the shared folder, a row for each cluster and row of the table; anchors are dealt in batches
of one cluster, at most ``members`` to a walk, and a task streams its cluster's list file by file and stops with its last
member. No task holds more than a block of the list, and no group is collected: neither a frequent label nor a frequent
vector makes one.

Nulls: rows without label or vector, or with a null or non-finite number in it, take no part; nor do rows without an id, as
nothing could name them. Equal rows (id, label, vector) count once; different rows of one id are rows of their own, and none
of them is another row of that id. Vectors of different lengths are compared as if zeros followed. Ties of score go by the
lesser id. An anchor without positives, or a positive without rows in its range, has no row in the result. Vectors that are
empty or zero score zero. Scores beyond 64 bits are given as the greatest or least 64-bit number, and ordered exactly. Other
columns are not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantryline.llm.common import freed, new_path, written

#: Anchors that centres are found from, at most.
SAMPLE = 4096
#: Rows of a list that are scored at once.
BLOCK = 4096
ROW = "vec_id long, label long, v array<long>"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Added to cosines, so that rounding never lowers a bound.
SLACK = 1e-6


def usable(df: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """Rows (vec_id, label, v) that take part: distinct, with whole numbers floor(scale * x)."""
    x = F.transform(F.col(vector), lambda y: y.cast("double"))
    good = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(good, x).alias("x")).dropna()
    return rows.select("vec_id", "label", F.transform("x", lambda y: F.floor(y * scale).cast("long")).alias("v")).distinct()


def matrix(column: pa.Array, width: int, exact: bool) -> np.ndarray:
    """Lists of numbers as rows; doubles, or Python's integers where doubles are not exact."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    out = np.zeros((len(column), width), np.int64)
    if len(sizes) and (sizes == width).all():
        out = flat.reshape(-1, width)
    else:
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.astype(object if exact else float)


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, lengths); a zero vector has direction zero."""
    m = m.astype(float)
    size = np.sqrt((m * m).sum(1))
    return m / np.where(size > 0, size, 1)[:, None], size


def centres_of(vectors: np.ndarray, clusters: int, rounds: int = 10) -> np.ndarray:
    """Directions of at most so many clusters by angle, from the farthest vectors onwards."""
    some, _ = unit(vectors)
    centres = some[:1]
    while len(centres) < min(clusters, len(some)):
        near = (some @ centres.T).max(1)
        if near.min() > 1 - 1e-9:
            break
        centres = np.concatenate([centres, some[[near.argmin()]]])
    for _ in range(rounds):
        mine = (some @ centres.T).argmax(1)
        sums = np.stack([some[mine == k].sum(0) if (mine == k).any() else centres[k] for k in range(len(centres))])
        centres = unit(sums)[0]
    return centres


def angles(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of each row to each centre; a zero vector's is zero."""
    way, size = unit(m)
    return np.where(size[:, None] > 0, np.arccos(np.clip(way @ centres.T, -1, 1)), 0)


class Best:
    """The first ``n`` (score, id) by falling score and rising id, of what is added."""

    def __init__(self, n: int, exact: bool) -> None:
        self.n, self.score, self.id = n, np.zeros(0, object if exact else float), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Adds rows."""
        if not len(ids):
            return
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        if score.dtype == object:
            at = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[: self.n]
        else:
            at = np.lexsort((ids, -score))[: self.n]
        self.score, self.id = score[at], ids[at]

    def least(self) -> float:
        """A row under this score changes nothing."""
        return self.score[-1] if len(self.score) == self.n else float("-inf")


def list_files(path: str, cluster: int) -> tuple[fs.FileSystem, list[str]]:
    """The files of a cluster's list, in their order."""
    store, folder = fs.FileSystem.from_uri(path)
    every = store.get_file_info(fs.FileSelector(f"{folder}/cluster={cluster}", allow_not_found=True))
    return store, sorted(x.path for x in every if x.is_file and x.base_name.startswith("part-"))


def walk(path: str, cluster: int, width: int, exact: bool) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (bound of the first row, ids, labels, vectors) of a list, in falling order of the bound."""
    store, files = list_files(path, cluster)
    last = float("inf")
    for name in files:
        with store.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(BLOCK, columns=["bound", "vec_id", "label", "v"]):
                bound = np.asarray(batch.column(0))
                if bound[0] > last or (np.diff(bound) > 0).any():
                    raise ValueError("a list is not in the order of its bounds")
                last = bound[-1]
                yield bound[0], np.asarray(batch.column(1)), np.asarray(batch.column(2)), matrix(batch.column(3), width, exact)


def mine(path: str, cluster: int, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, exact: bool, n_positives: int, n_negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of the result for members of one cluster."""
    size = unit(m)[1] * (1 + SLACK)
    positives = [Best(n_positives, exact) for _ in ids]
    needs = np.full(len(ids), float("-inf"), object)
    for bound, others, kinds, block in walk(path, cluster, m.shape[1], exact):
        open_ = np.flatnonzero(bound * size >= needs)
        if not len(open_):
            break
        scores = m[open_] @ block.T
        for i, row in zip(open_.tolist(), scores, strict=True):
            take = np.flatnonzero((kinds == labels[i]) & (others != ids[i]) & (row >= needs[i]))
            positives[i].add(row[take], others[take])
            needs[i] = positives[i].least()
    # whole-number ranges: ceil(low * p / 100) to floor(high * p / 100)
    ranges = [[(-(-low * int(p) // 100), high * int(p) // 100) for p in b.score] for b in positives]
    negatives = [[Best(n_negatives, exact) for _ in r] for r in ranges]
    infinite = float("inf")
    needs = np.array([min((lo for lo, hi in r if lo <= hi), default=infinite) for r in ranges], object)
    most = [max((hi for lo, hi in r if lo <= hi), default=-infinite) for r in ranges]
    for bound, others, kinds, block in walk(path, cluster, m.shape[1], exact):
        open_ = np.flatnonzero(bound * size >= needs)
        if not len(open_):
            break
        scores = m[open_] @ block.T
        for i, row in zip(open_.tolist(), scores, strict=True):
            take = np.flatnonzero((kinds != labels[i]) & (row >= needs[i]) & (row <= most[i]))
            if not len(take):
                continue
            row, near = row[take], others[take]
            for (lo, hi), best in zip(ranges[i], negatives[i], strict=True):
                inside = (row >= max(lo, best.least())) & (row <= hi)
                best.add(row[inside], near[inside])
            needs[i] = min((max(lo, best.least()) for (lo, hi), best in zip(ranges[i], negatives[i], strict=True) if lo <= hi), default=infinite)
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, int(x)))
    for i, anchor in enumerate(ids.tolist()):
        for p, pid, best in zip(positives[i].score, positives[i].id.tolist(), negatives[i], strict=True):
            for rank, (n, nid) in enumerate(zip(best.score, best.id.tolist(), strict=True), 1):
                yield anchor, pid, rank, nid, clip(p), clip(n)


def hard_negatives(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, clusters: int = 4, members: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, v), as ``usable`` gives.

    ``anchor``: which rows are anchors; ``low``, ``high``: hundredths of the positive's score.
    """
    if n_positives < 1 or n_negatives < 1 or clusters < 1:
        raise ValueError("counts must be positive")
    vectors = written(rows.select("vec_id", "label", "v", F.coalesce(anchor, F.lit(False)).alias("_anchor")), "vectors")
    anchors = vectors.filter("_anchor").drop("_anchor")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    width, square, n = vectors.agg(F.max(F.size("v")), F.max(squares), F.count_if("_anchor")).first()
    if not n:
        return rows.sparkSession.createDataFrame([], MINED)
    exact = square > 2.0**52  # partial sums of doubles are exact below
    sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    centres = centres_of(matrix(sample, width, False), clusters)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = angles(matrix(batch.column(2), width, False), centres)
            yield pa.RecordBatch.from_arrays([pa.array(apart.argmin(1), pa.int32()), pa.array(apart.min(1)), *batch.columns], names=["cluster", "angle", *batch.schema.names])

    members_of = written(anchors.mapInArrow(assign, f"cluster int, angle double, {ROW}"), "members")
    widest = {r[0]: r[1] for r in members_of.groupBy("cluster").agg(F.max("angle")).collect()}  # a row a cluster

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column(2), width, False)
            apart, size = angles(m, centres), unit(m)[1]
            for k, most in sorted(widest.items()):
                bound = size * np.minimum(np.cos(np.maximum(apart[:, k] - most, 0)) + SLACK, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), k), pa.int32()), pa.array(bound), *batch.columns], names=["cluster", "bound", *batch.schema.names])

    order = ["cluster", F.desc("bound"), "vec_id", "label"]
    path = new_path(rows.sparkSession, "lists")
    lists = vectors.drop("_anchor").mapInArrow(bounds, f"cluster int, bound double, {ROW}")
    lists.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("cluster").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MINED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            cluster = np.asarray(batch.column(0))
            for k in np.unique(cluster).tolist():
                at = np.flatnonzero(cluster == k)
                for i in range(0, len(at), members):
                    some = batch.take(pa.array(at[i : i + members]))
                    m = matrix(some.column(3), width, exact)
                    found = list(mine(path, k, np.asarray(some.column(1)), np.asarray(some.column(2)), m, exact, n_positives, n_negatives, low, high))
                    cols = list(zip(*found, strict=True)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
        freed()

    dealt = members_of.select("cluster", "vec_id", "label", "v").repartitionByRange(max(1, -(-n // members)), "cluster", "vec_id", "label")
    return dealt.sortWithinPartitions("cluster").mapInArrow(run, MINED)
