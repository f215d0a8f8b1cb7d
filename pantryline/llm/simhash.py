"""SimHash fingerprints, links by pigeonring filtering, and classes of near copies.

A fingerprint's bit is 1 if it is set in over half of the hashes of a text's word shingles (repeats count). Fingerprints
link at ``radius`` or fewer differing bits; a class is what links connect.

Index. The fingerprint's bits form a ring of ``segments`` segments. By the pigeonring principle, if a pair differs in at
most ``radius`` bits, then some segment starts a chain of which each prefix of ``l`` segments differs in at most
``l * radius / segments`` bits. With ``segments = radius + 1`` the budgets are 0, 1, 2, ...: the first segment is equal,
and the second differs in at most one bit, so one of its halves is equal. The index keys are therefore each segment
with either half of the next one; every pair within the radius shares a key, and under it the chain's budgets are
tested from that segment on, before the full Hamming check.

A wide fingerprint with a radius beyond its segments, as ``one_of_each`` takes, has no keys that meet every pair and let few
others through: there keys of least hashes propose pairs, the ring's chains prune them before the full Hamming check, parity
bitmaps of the sets prune what is surely under the similarity (published as bitmap filter for exact set joins), and the shingle
sets themselves decide.

Scale. Equal fingerprints are one node. Keys with over ``block`` nodes are cut into blocks, and each pair of blocks is
a unit of its own, so no task holds more than two blocks of a key and no pair is lost. Each unit gives a spanning forest
of its links, not the links, so output grows with nodes. Classes come from alternating large-star and small-star
rounds, each written to the shared folder.

Nulls: a null text counts as empty; all texts without words have fingerprint zero and link like any other. A row without
id gets a fingerprint but no class, and joins nothing. In ``near_copies`` rows of one id are one node; in ``one_of_each`` each
text is one. Ids of any ordered type come back as they are; the least of equals stays. Long texts are taken whole. Columns other
than the id and the text are not read; ``one_of_each`` returns them as they are, whatever their names. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantryline.llm.common import apart, text_batches, written

SEED = 42
BITS = np.uint64(64)


@dataclass(frozen=True)
class Ring:
    """``words``: 64-bit words of a fingerprint; ``segments`` of its ring; ``radius``: most differing bits of a link."""

    words: int = 1
    radius: int = 4
    segments: int = 5

    @property
    def exact(self) -> bool:
        """Whether the keys meet every pair within the radius."""
        return self.segments > self.radius

    def mask(self, lo: int, hi: int) -> np.ndarray:
        """Words with the bits from ``lo`` to ``hi`` set, round the ring."""
        n = 64 * self.words
        bits = np.zeros(n, np.uint8)
        bits[np.arange(lo, hi) % n] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    @property
    def bounds(self) -> list[int]:
        """Where segments start, over two rounds."""
        n = 64 * self.words
        return [n * i // self.segments for i in range(2 * self.segments + 1)]

    def keys(self) -> list[tuple[int, np.ndarray]]:
        """(first segment, mask) of each index key."""
        b, out = self.bounds, []
        for i in range(self.segments):
            first = self.mask(b[i], b[i + 1])
            if self.exact and self.segments > 1:
                half = (b[i + 1] + b[i + 2]) // 2
                out += [(i, first | self.mask(b[i + 1], half)), (i, first | self.mask(half, b[i + 2]))]
            else:
                out.append((i, first))
        return out

    def chains(self, start: int) -> list[tuple[np.ndarray, int]]:
        """(mask, most bits) of the chains of 2, 3, ... segments from ``start``."""
        b = self.bounds
        return [(self.mask(b[start], b[start + k]), k * self.radius // self.segments) for k in range(2, self.segments)]

    def chained(self, x: np.ndarray) -> np.ndarray:
        """Whether rows of differing bits have a chain: a segment from which all runs of segments stay within their budgets.

        Every row within the radius has one. Rows without drop out as soon as no segment is left to start from.
        """
        b = self.bounds
        counts = np.stack([np.bitwise_count(x & self.mask(b[i], b[i + 1])).sum(1, dtype=np.int32) for i in range(self.segments)], axis=1)
        rows, run = np.arange(len(x)), counts.copy()
        starts = run * self.segments <= self.radius
        for k in range(1, self.segments):
            some = starts.any(1)
            rows, run, starts, counts = rows[some], run[some], starts[some], counts[some]
            run += np.roll(counts, -k, axis=1)
            starts &= run * self.segments <= (k + 1) * self.radius
        out = np.zeros(len(x), bool)
        out[rows[starts.any(1)]] = True
        return out


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, A-Z lower-cased; of all words if there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    h = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((h(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """Further hashes of hashes: the splitmix64 finaliser."""
    if not i:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def simhash(h: np.ndarray, words: int = 1) -> bytes:
    """Little-endian bytes of the fingerprint of shingle hashes; zero without any."""
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(h), 65280):
        part = h[i : i + 65280]
        wide = np.stack([_mixed(part, k) for k in range(words)], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(part), 8 * words), axis=1, bitorder="little")
        counts += np.add.reduceat(bits, np.arange(0, len(part), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").tobytes()


def _number(fp: bytes) -> int:
    """A number for a fingerprint: its own bits, or a hash of more than 64."""
    return int.from_bytes(fp if len(fp) == 8 else xxhash.xxh64_digest(fp, SEED), "little", signed=True)


def fingerprints(docs: DataFrame, size: int = 4, words: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp binary, node long) of every row; ``fp`` has 8 bytes a word, little-endian; ``node``: a number for it."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("fp", T.BinaryType()), T.StructField("node", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "_text", 8 << 20):
            fps = [simhash(shingle_hashes(x, size), words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(map(_number, fps), pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


KEY = T.StructType([T.StructField("k", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("fp", T.BinaryType())])
EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _words(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _key_rows(nodes: DataFrame, ring: Ring) -> DataFrame:
    """A row for each node and index key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ring.keys()
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                fp = _words(part.column(1), ring.words)
                for i, (start, mask) in enumerate(keys):
                    k = np.full(len(fp), i + 1, np.uint64)
                    for w in range(ring.words):
                        k = _mixed(k ^ (fp[:, w] & mask[w]), w + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.full(len(fp), start, np.int32)), part.column(0), part.column(1)], names=KEY.names)

    return nodes.select("node", "fp").mapInArrow(run, KEY)


def _forest(group: np.ndarray, start: np.ndarray, node: np.ndarray, fp: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its tree) of the links among rows of equal ``group``; rows lie group by group."""
    n = len(group)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    alive = np.arange(n)
    chains = [ring.chains(i) for i in range(ring.segments)] if ring.exact else []
    for shift in range(1, n):
        alive = alive[alive + shift < n]
        alive = alive[group[alive] == group[alive + shift]]
        if not len(alive):
            break
        a = alive[(root[alive] != root[alive + shift]) & (start[alive] == start[alive + shift])]
        x = fp[a] ^ fp[a + shift]
        if ring.exact:
            fits = np.ones(len(a), bool)
            for i in range(ring.segments):
                at = np.flatnonzero(start[a] == i)
                for mask, most in chains[i]:
                    at = at[np.bitwise_count(x[at] & mask).sum(1) <= most] if len(at) else at
                fits[start[a] == i] = False
                fits[at] = True
            a, x = a[fits], x[fits]
        a = a[np.bitwise_count(x).sum(1) <= ring.radius]
        for i in a.tolist():
            p, q = find(i), find(i + shift)
            if p != q:
                root[max(p, q)] = min(p, q)
    for i in range(n):
        if root[i] != i:
            root[i] = find(i)
    rest = np.flatnonzero(root != np.arange(n))
    tree = np.unique(root[rest])
    least = dict(zip(tree.tolist(), node[tree].tolist(), strict=True))
    for r, v in zip(root[rest].tolist(), node[rest].tolist(), strict=True):
        least[r] = min(least[r], v)
    members = np.concatenate([rest, tree])
    low = np.array([least[r] for r in root[members].tolist()], np.int64)
    return node[members][node[members] != low], low[node[members] != low]


def links(nodes: DataFrame, ring: Ring, block: int = 4096) -> DataFrame:
    """Edges (a, b < a) between ``nodes`` (node long, fp) that connect what links within the radius connect."""
    keys = _key_rows(nodes, ring)
    large = written(keys.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > block), "large-keys")
    if large.isEmpty():
        cells = keys.withColumn("cell", F.lit(0).cast("long"))
    else:
        parts = F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))
        own = F.pmod(F.xxhash64("node"), parts).cast("long")
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1), lambda y: F.least(F.col("_own"), y) * (1 << 20) + F.greatest(F.col("_own"), y))
        cells = keys.join(large, "k", "left").withColumn("_own", own).withColumn("cell", F.explode(pairs)).select(*KEY.names, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def work(k, cell, start, node, fp):
            a, b = _forest(np.cumsum(np.concatenate(([0], (k[1:] != k[:-1]) | (cell[1:] != cell[:-1])))) if len(k) else k, start, node, fp, ring)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=EDGE.names)

        def joined():
            return [np.concatenate([x[i] for x in held]) for i in range(5)]

        for batch in batches:
            if not batch.num_rows:
                continue
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            held.append((c["k"].to_numpy(), c["cell"].to_numpy(), c["start"].to_numpy(), c["node"].to_numpy(), _words(c["fp"], ring.words)))
            if sum(len(x[0]) for x in held) < 50_000:
                continue
            k, cell, *rest = joined()
            cut = len(k) - int(np.argmax(((k != k[-1]) | (cell != cell[-1]))[::-1])) if (k[0], cell[0]) != (k[-1], cell[-1]) else 0
            yield from work(k[:cut], cell[:cut], *(x[:cut] for x in rest))
            held = [(k[cut:], cell[cut:], *(x[cut:] for x in rest))]
        if held:
            yield from work(*joined())

    return cells.repartition("k", "cell").sortWithinPartitions("k", "cell").mapInArrow(run, EDGE).distinct()


def classes(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has an edge with the least node that it is connected to; least nodes have no row."""
    now, before = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges"), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == before:
            return now
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        now = written(small.distinct(), "edges")


def near_copies(docs: DataFrame, size: int = 4, ring: Ring = Ring(), block: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text); component_id: the least id of the class."""
    fps = written(fingerprints(docs, size, ring.words), "fingerprints")
    known = fps.filter("doc_id is not null")
    nodes = written(known.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")), "nodes")
    # an id with several fingerprints connects them
    several = known.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("_m")).filter("b != _m").select("doc_id", "b")
    tied = known.join(several, "doc_id").select(F.col("node").alias("a"), "b").filter("a != b")
    roots = classes(links(nodes, ring, block).unionByName(tied))
    found = nodes.join(roots, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root"), "least")
    named = found.groupBy("root").agg(F.min("least").alias("component_id"))
    # as a table of its own, so that a join whose one fingerprint has many rows can be split
    out = fps.join(written(found.join(named, "root").select("node", "component_id"), "classes"), "node", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


NODE = [T.StructField("node", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
#: Bits of a set's bitmap: bit ``i`` tells whether an odd number of the set's hashes is ``i`` modulo their number.
PARITY = 2048
#: Keys of a set, and least hashes in each: a pair of similarity s shares no key with a probability of (1 - s ** 4) ** 30, 1.4e-7 at 0.8.
BANDS, ROWS = 30, 4
_XOR, _TIMES = np.random.default_rng(SEED).integers(0, 1 << 64, (2, 1, BANDS * ROWS), np.uint64)
_TIMES |= np.uint64(1)


def least_hash_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a set of hashes: each from the least of its hashes in ``ROWS`` orders. None of an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 512):
        least = np.minimum(least, ((h[i : i + 512, None] ^ _XOR) * _TIMES).min(0))
    k = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        k = _mixed(k ^ least[i::ROWS], i + 1)
    return k.view(np.int64)


def _set_number(h: np.ndarray) -> int:
    """A number for a set of hashes (ascending)."""
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def parity(h: np.ndarray) -> bytes:
    """The bitmap of a set of hashes. Where two sets' bitmaps differ, the sets do: they differ in that many hashes or more."""
    odd = np.bincount((h % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def shingle_sets(docs: DataFrame, size: int, ring: Ring) -> DataFrame:
    """(doc_id, node, fp, bits, size, keys) of every row.

    ``node``: a number for its shingle set; ``fp``, ``bits``, ``size`` and ``keys``: of the set, so repeats don't count.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "_text", 8 << 20):
            sets = [np.unique(shingle_hashes(x, size)) for x in batch.column(1).to_pylist()]
            of = lambda f, kind: pa.array([f(h) for h in sets], kind)  # noqa: B023, E731
            columns = [of(_set_number, pa.int64()), of(lambda h: simhash(h, ring.words), pa.binary()), of(parity, pa.binary()), of(len, pa.int64()), of(least_hash_keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(x.name for x in NODE)])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], *NODE]))


def _numbered(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` with ``_node``, the number of each row's shingle set."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", 8 << 20):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_set_number(np.unique(shingle_hashes(x or b"", size))) for x in texts], pa.int64())], names=[*batch.schema.names, "_node"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("_node", T.LongType())]))


def _hashes(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, h) of the ``wanted`` (doc_id, node): the shingle set itself. A row whose text has another set is left out."""
    rows = docs.join(wanted, "doc_id").select("node", F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    schema = T.StructType([NODE[0], T.StructField("h", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "_text", 2 << 20):
            sets = [(n, np.unique(shingle_hashes(x, size))) for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            sets = [(n, h) for n, h in sets if _set_number(h) == n]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in sets], pa.int64()), pa.array([h.view(np.int64) for _, h in sets], pa.list_(pa.int64()))], names=["node", "h"])

    return rows.mapInArrow(run, schema)


@dataclass
class Unit:
    """Rows that are compared with each other where ``group`` is equal; they lie group by group. ``bits`` are empty in the first round."""

    group: np.ndarray
    node: np.ndarray
    root: np.ndarray
    size: np.ndarray
    fp: np.ndarray
    bits: np.ndarray

    def pairs(self, ring: Ring, most: int | None, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(larger node, smaller node) of unequal roots that may be ``least`` similar; of each row the first ``most``.

        Pairs without a chain round the ring are pruned before the full Hamming check; then those whose bitmaps differ in more
        bits than sets of that similarity differ in hashes: of ``a + b`` hashes at most a share of (1 - s) / (1 + s).
        """
        n = len(self.group)
        alive, hits = np.arange(n), np.zeros(n, np.int64)
        out = [(self.node[:0], self.node[:0])]
        up, down = least[1] + least[0], least[1] - least[0]
        for shift in range(1, n):
            alive = alive[alive + shift < n]
            alive = alive[self.group[alive] == self.group[alive + shift]]
            if most is not None:
                alive = alive[hits[alive] < most]
            if not len(alive):
                break
            a = alive[self.root[alive] != self.root[alive + shift]]
            if not len(a):
                continue
            x = self.fp[a] ^ self.fp[a + shift]
            chained = ring.chained(x)
            a, x = a[chained], x[chained]
            a = a[np.bitwise_count(x).sum(1) <= ring.radius]
            if self.bits.shape[1] and len(a):
                apart = np.bitwise_count(self.bits[a] ^ self.bits[a + shift]).sum(1, dtype=np.int64)
                a = a[apart * up <= (self.size[a] + self.size[a + shift]) * down]
            hits[a] += 1
            out.append((np.maximum(self.node[a], self.node[a + shift]), np.minimum(self.node[a], self.node[a + shift])))
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _proposals(cells: DataFrame, ring: Ring, most: int | None, least: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a, b < a) of ``cells`` (k, cell, at, node, root, size, fp, bits), unit by unit; ``at``: the order in a unit."""
    names = ("k", "cell", "node", "root", "size", "fp", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def work(k, cell, *rest):
            a, b = Unit(np.cumsum(np.concatenate(([0], (k[1:] != k[:-1]) | (cell[1:] != cell[:-1])))), *rest).pairs(ring, most, least)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=EDGE.names)

        def joined():
            return [np.concatenate([x[i] for x in held]) for i in range(len(names))]

        def words(column: pa.Array) -> np.ndarray:
            return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)

        for batch in batches:
            if not batch.num_rows:
                continue
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            held.append((*(c[x].to_numpy() for x in names[:5]), *(words(c[x]) for x in names[5:])))
            if sum(len(x[0]) for x in held) < 50_000:
                continue
            k, cell, *rest = joined()
            cut = len(k) - int(np.argmax(((k != k[-1]) | (cell != cell[-1]))[::-1])) if (k[0], cell[0]) != (k[-1], cell[-1]) else 0
            if cut:
                yield from work(k[:cut], cell[:cut], *(x[:cut] for x in rest))
            held = [(k[cut:], cell[cut:], *(x[cut:] for x in rest))]
        if held:
            yield from work(*joined())

    return cells.repartition("k", "cell").sortWithinPartitions("k", "cell", "at").select(*names).mapInArrow(run, EDGE).distinct()


def _neighbours(known: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """Cells of the first round: a key's nodes in blocks, in one of three orders, so that each meets others in each of them."""
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block))
    cells = known.select("k", own.cast("long").alias("cell"), F.xxhash64("node", F.pmod("k", F.lit(3))).alias("at"), "node", "root")
    return cells.join(nodes.select("node", "size", "fp", F.lit(b"").alias("bits")), "node")


def _between_roots(known: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """Cells of later rounds: of keys that nodes of several roots share, all pairs of blocks but those within one root.

    A root with over ``block`` nodes of a key has blocks of its own; the others of a key share blocks.
    """
    spread = written(known.groupBy("k", "root").agg(F.count("*").alias("c")), "roots")
    still = spread.groupBy("k").agg(F.count("*").alias("roots"), F.sum("c").alias("m")).filter("roots > 1").select("k", "m")
    rows = written(known.select("k", "node", "root").join(still, "k").join(spread, ["k", "root"]), "open")
    large = rows.filter(F.col("m") > block)
    small = rows.filter(F.col("m") <= block).select("k", F.lit(0).cast("long").alias("cell"), "node", "root")
    heavy = F.col("c") > block
    own = F.when(heavy, F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / block)))).otherwise(F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("root"), F.ceil(F.col("m") / block))))
    large = large.select("k", "node", "root", own.alias("own"), F.when(heavy, F.col("root")).alias("alone"))
    # some entries for each ``block`` nodes of a key
    blocks = large.select("k", "own", "alone").distinct().groupBy("k").agg(F.collect_list(F.struct("own", "alone")).alias("blocks"))
    met = F.filter("blocks", lambda b: ~F.coalesce(b["alone"] == F.col("alone"), F.lit(False)))
    cell = F.transform(met, lambda b: F.xxhash64(F.least(b["own"], F.col("own")), F.greatest(b["own"], F.col("own"))))
    crossed = large.join(blocks, "k").select("k", F.explode(F.array_distinct(cell)).alias("cell"), "node", "root")
    cells = small.unionByName(crossed).withColumn("at", F.col("node"))
    return cells.join(nodes.select("node", "size", "fp", "bits"), "node")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, least: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) of which the shingle sets have a Jaccard similarity of ``least`` (a fraction) or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(_hashes(docs, nodes.join(ends, "node", "left_semi").select("doc_id", "node"), size), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.filter(least[1] * same >= least[0] * (F.size("x") + F.size("y") - same)).select("a", "b").distinct()


def similar_texts(docs: DataFrame, size: int, ring: Ring, least: tuple[int, int] = (4, 5), block: int = 4096, rounds: tuple[int | None, ...] = (1, 16, None)) -> DataFrame:
    """(doc_id, node, leader) of every row with an id: classes of what pairs with a similarity of ``least`` or more connect.

    ``node``: a number for the row's shingle set; ``leader``: struct (doc_id, node) of the class's row with the least id.

    Sets that share a key of least hashes are compared, those with fingerprints within ``ring.radius`` of each other are
    proposed, and each link is a proposed pair whose shingle sets are as similar. Equal sets are one node. A pair that
    verified links connect already need not be tested, so rounds propose a few pairs of each node first and all that are
    left, between classes, last: a dense class costs as many tests as it has nodes, and no pair is left out.
    """
    rows = written(shingle_sets(docs.filter("doc_id is not null"), size, ring), "shingle-sets")
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(x).alias(x) for x in ("fp", "bits", "size"))), "nodes")
    keys = rows.select(F.explode("keys").alias("k"), "node").distinct()
    shared = keys.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    keys = written(keys.join(shared, "k"), "keys")
    edges = docs.sparkSession.createDataFrame([], EDGE)
    tested, roots = None, edges
    for most in rounds:
        known = keys.join(roots.select(F.col("a").alias("node"), F.col("b").alias("_root")), "node", "left").withColumn("root", F.coalesce("_root", "node"))
        cells = _neighbours(known, nodes, block) if tested is None else _between_roots(known, nodes, block)
        found = _proposals(cells, ring, most, least)
        found = written(found if tested is None else found.join(tested, ["a", "b"], "left_anti"), "proposals")
        tested = found if tested is None else tested.unionByName(found)
        if found.isEmpty():
            continue
        edges = written(edges.unionByName(verified(docs, found, nodes, size, least)), "verified")
        roots = classes(edges)
    each = nodes.join(roots, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root"), "doc_id")
    leaders = each.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("leader"))
    # as a table of its own, so that a join whose one node has many rows can be split
    found = written(each.select("node", "root").join(leaders, "root").select("node", "leader"), "classes")
    return rows.select("doc_id", "node").join(found, "node")


def one_of_each(docs: DataFrame, size: int = 5, ring: Ring = Ring(words=4, radius=80, segments=8), block: int = 4096) -> DataFrame:
    """``docs`` without near copies: of each class the row with the least id stays.

    A class is what pairs with a similarity of 0.8 or more connect: Jaccard, over sets of ``size``-word shingles, tested
    exactly for each pair that keys and fingerprints propose. Bits differ with the angle between the sets: at 0.8 in 38.8
    of 256 (deviation 5.7), between unrelated texts in 128 (8), so a radius of 80 leaves out no pair that counts. Exact ring
    keys for it are no filter: a first segment of nine bits that may differ in two lets a tenth of all pairs through.

    Rows without id stay. Rows of one id are judged by their own texts: with texts that are not alike each can stay; of rows of
    one id with one shingle set at most one stays, that with the least hash of all its columns.
    """
    plain, back = apart(docs, "doc_id", "text")
    found = written(similar_texts(plain.select("doc_id", "text"), size, ring, block=block), "found")
    found = found.withColumn("_first", (F.col("leader.doc_id") == F.col("doc_id")) & (F.col("leader.node") == F.col("node")))
    ids = written(found.groupBy("doc_id").agg(F.count("*").alias("_n"), F.max("_first").alias("_first")), "ids")
    several = written(ids.filter("_n > 1").select("doc_id"), "repeated")
    out = plain.join(ids.filter("_n > 1 or not _first").select("doc_id"), "doc_id", "left_anti").select(plain.columns)
    if several.isEmpty():
        return back(out)
    keep = found.filter("_first").join(several, "doc_id").select("doc_id", F.col("node").alias("_node")).distinct()
    again = _numbered(plain.join(several, "doc_id", "left_semi").select(plain.columns), size).join(keep, ["doc_id", "_node"], "left_semi")
    row = F.struct(*plain.columns)
    again = again.groupBy("doc_id", "_node").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_r")).select("_r.*")
    return back(out.unionByName(again))
