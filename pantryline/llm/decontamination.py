"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words are runs of letters and digits, lower-cased; shingles have five words (an item or text with fewer words is one
shingle), and repeats count as weights. For an item of ``m`` words every window of ``m`` words of a text is meant (the
whole text, if it is shorter). Windows that share no shingle with an item of their size have a similarity of zero, so
only the others are fingerprinted. A window's 64-bit fingerprint is looked up in eight blocks of eight bits: if it is
within ``radius`` = 23 bits of an item's, one block is within two, and each block's sorted list gives all items that near. What
stays within the radius is verified by the exact weighted Jaccard similarity of the shingle counts. At a similarity of 0.8
fingerprints differ in 10 bits (deviation 3), so the radius is beyond four deviations.

Texts pass through once, without a shuffle. Items go to the tasks in blocks of at most ``item_bytes`` of text, a pass
over the texts for each block, whose finds are written before the next index is built: the driver has one at a time. An index holds some 50 bytes for each word of its items, all in flat arrays; windows are looked
up in slices of a bounded number of shingles, and of windows times the items that share a shingle with them.

Nulls: a null text or item counts as empty, and an item without words is nowhere. Empty texts hold nothing; long ones are read
whole. Repeated items and rows are reported each; of a text's windows the best is, the first of equals. Ids of any type come back
as they are. Other columns, whatever their names, are not read by ``leaks`` and come back as they are from ``without_leaks``.
Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pantryline.llm.common import freed, text_batches, written

TOKEN = re.compile(r"[^\W_]+")
SIZE, RADIUS, BLOCKS, NEAR = 5, 23, 8, 2
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Bytes that differ from each byte in two bits or fewer.
NEIGHBOURS = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(x)) <= NEAR) for x in range(256)]
#: Shingles whose bits are summed at once, cells of windows times items, and characters of words that a task keeps.
SPAN, CELLS, KEPT = 1 << 16, 1 << 22, 16 << 20


class WordHashes(dict):
    """64-bit hash of each word met."""

    def __missing__(self, word: str) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word.encode(), 7)
        return out

    def of(self, text: str) -> np.ndarray:
        """Hashes of a text's words."""
        words = TOKEN.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Hashes of the shingles of ``size`` words; of all words if there are fewer."""
    size = min(size, len(words))
    if not size:
        return words[:0]
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h += words[i : i + n] * ODD[i]
    h = (h ^ (h >> np.uint64(31))) * ODD[0]
    return h ^ (h >> np.uint64(29))


def _fingerprints(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.packbits(2 * bits > size[:, None], axis=1, bitorder="little")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two shingle arrays."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return (x & y).total() / max(1, (x | y).total())


def _bit_sums(h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each bit is set in the ``n`` hashes from each start; at most ``SPAN`` hashes and a window are open at once."""
    out, lo = np.zeros((len(starts), 64), np.int64), 0
    unpacked = lambda a, b: np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    while lo < len(starts):
        base = int(starts[lo])
        hi = lo + max(1, int(np.searchsorted(starts[lo:], base + SPAN)))
        end = int((starts[lo:hi] + n[lo:hi]).max())
        if hi - lo == 1:
            for a in range(base, end, SPAN):
                out[lo] += unpacked(a, min(end, a + SPAN)).sum(0, dtype=np.int64)
        else:  # windows near each other share their sums
            sums = np.zeros((end - base + 1, 64), np.int32)
            np.cumsum(unpacked(base, end), axis=0, dtype=np.int32, out=sums[1:])
            out[lo:hi] = sums[starts[lo:hi] - base + n[lo:hi]] - sums[starts[lo:hi] - base]
        lo = hi
    return out


def _runs(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(first, last) start of each run of windows that touch."""
    cut = np.flatnonzero(np.diff(starts) > n)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


@dataclass
class Sized:
    """The items of one number of words: ids, shingles one item after the other, ``n`` each, and fingerprints."""

    ids: list
    shingles: np.ndarray
    n: int

    def __post_init__(self) -> None:
        at = np.arange(len(self.ids)) * self.n
        self.prints = _fingerprints(_bit_sums(self.shingles, at, np.full(len(at), self.n)), np.full(len(at), self.n))
        #: of each shingle: its items, from ``first`` on
        order = np.argsort(self.shingles, kind="stable")
        self.items = (order // self.n).astype(np.int32)
        self.known, first = np.unique(self.shingles[order], return_index=True)
        self.first = np.append(first, len(order))

    def of(self, item: int) -> np.ndarray:
        """An item's shingles."""
        return self.shingles[item * self.n : (item + 1) * self.n]

    def sharing(self, h: np.ndarray) -> np.ndarray:
        """The items that have one of the shingles; all others have a similarity of zero with them."""
        h = np.unique(h)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        at = at[self.known[at] == h]
        many = self.first[at + 1] - self.first[at]
        return np.unique(self.items[np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))])

    def near(self, prints: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(distance, window, item) of fingerprints within the radius of those of ``items``, for windows in slices, nearest first in each.

        Each block's list holds the items in the order of their bytes; a window looks up all bytes near its own.
        """
        mine = self.prints[items]
        order = np.argsort(mine, axis=0, kind="stable").astype(np.int32)
        first = [np.searchsorted(mine[order[:, b], b], np.arange(257)) for b in range(BLOCKS)]
        step = max(1, CELLS // max(1, len(items)))
        for lo in range(0, len(prints) if len(items) else 0, step):
            part = prints[lo : lo + step]
            some = np.zeros((len(part), len(items)), bool)
            for b in range(BLOCKS):
                for byte in np.unique(part[:, b]).tolist():
                    listed = np.concatenate([order[first[b][x] : first[b][x + 1], b] for x in NEIGHBOURS[byte].tolist()])
                    some[np.ix_(part[:, b] == byte, listed)] = True
            w, i = np.nonzero(some)
            d = np.bitwise_count(part[w].view(np.uint64)[:, 0] ^ mine[i].view(np.uint64)[:, 0]).astype(np.int64)
            ok = d <= RADIUS
            yield from sorted(zip(d[ok].tolist(), (w[ok] + lo).tolist(), items[i[ok]].tolist(), strict=True))


class Items:
    """An index of benchmark items."""

    def __init__(self, rows: list[tuple[object, str]]) -> None:
        hashes, by_size = WordHashes(), {}
        for item, text in rows:
            words = hashes.of(text or "")
            if len(words):
                by_size.setdefault(len(words), []).append((item, shingles(words)))
        self.by_size = {m: Sized([i for i, _ in x], np.concatenate([h for _, h in x]), len(x[0][1])) for m, x in by_size.items()}
        # the sizes of items that have a shingle: flat, with the place where each shingle's begin
        pairs = [(h := np.unique(x.shingles), np.full(len(h), m, np.int32)) for m, x in sorted(self.by_size.items())]
        every = np.concatenate([h for h, _ in pairs]) if pairs else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.sizes = np.concatenate([m for _, m in pairs])[order] if pairs else np.zeros(0, np.int32)
        self.known, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(self.sizes)).astype(np.int64)
        self.spans = sorted({min(SIZE, m) for m in self.by_size})  # words of a shingle: under five for short items

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Where shingles are those of an item, as a place in ``known``; -1 elsewhere."""
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        return np.where(self.known[at] == h, at, -1) if len(self.known) else np.full(len(h), -1)

    def windows(self, h: np.ndarray, span: int, n_words: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item size, shingles of a window, starts) of the windows that share a shingle with an item of that size."""
        at = self.hits(h)
        where = np.flatnonzero(at >= 0)
        many = self.first[at[where] + 1] - self.first[at[where]]
        place = np.repeat(where, many)
        size = self.sizes[np.repeat(self.first[at[where]] - (np.cumsum(many) - many), many) + np.arange(len(place))]
        for m in np.unique(size).tolist():
            if min(SIZE, m) == span or n_words < span:
                n = min(m - span + 1, len(h)) if m >= span else 1
                p = place[size == m]
                # starts from p - n + 1 to p, within the text
                edge = np.zeros(len(h) + 1, np.int32)
                np.add.at(edge, np.maximum(0, p - n + 1), 1)
                np.add.at(edge, np.minimum(p, len(h) - n) + 1, -1)
                yield m, n, np.flatnonzero(np.cumsum(edge)[: len(h) - n + 1] > 0)

    def find(self, words: np.ndarray, least: float) -> list[tuple[object, int, int, int, float]]:
        """(item, first word, words, distance, similarity) of a text: the best window of each item found."""
        best: dict[tuple[int, int], tuple] = {}
        for span in self.spans:
            h = shingles(words, span)
            for m, n, starts in self.windows(h, span, len(words)):
                for s, d, i, j in self._verified(h, starts, n, m, least):
                    row = (-j, d, s, min(m, len(words)) if len(h) == 1 else n + span - 1)
                    if (m, i) not in best or row < best[m, i]:
                        best[m, i] = row
        return [(self.by_size[m].ids[i], s, n, d, -j) for (m, i), (j, d, s, n) in sorted(best.items())]

    def _verified(self, h: np.ndarray, starts: np.ndarray, n: int, m: int, least: float) -> Iterator[tuple]:
        sized, whole = self.by_size[m], {}
        for lo in range(0, len(starts), 4096):
            part = starts[lo : lo + 4096]
            size = np.full(len(part), n)
            items = sized.sharing(np.concatenate([h[s : e + n] for s, e in _runs(part, n)]))
            for d, w, i in sized.near(_fingerprints(_bit_sums(h, part, size), size), items):
                s = int(part[w])
                if whole.get(i, (65, 0)) <= (d, s):
                    continue
                j = similarity(h[s : s + n], sized.of(i))
                if j >= least:
                    yield s, d, i, j
                if j == 1:
                    whole[i] = d, s


def _blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[Items]:
    """Indexes over parts of the items, each of a bounded number of bytes on the driver."""
    rows = items.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.select(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    parts = -(-size // most)
    for i in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(parts)) == i) if parts > 1 else rows
        yield Items([(r["key"], r["text"]) for r in part.collect()])


def _scan(batches: Iterator[pa.RecordBatch], at: int, text: str, index: Items, least: float) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
    hashes = WordHashes()
    for batch in text_batches(batches, text, 4 << 20):
        if len(hashes) > 300_000 or sum(map(len, hashes)) > KEPT:
            hashes.clear()
        words = [hashes.of(x or "") for x in batch.column(at).to_pylist()]
        found: list[list[tuple]] = [[] for _ in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        doc, every = np.repeat(np.arange(len(words)), sizes), np.concatenate(words) if words else np.zeros(0, np.uint64)
        maybe = set(np.flatnonzero(sizes < SIZE).tolist())  # a text of a few words is one shingle of them
        for span in index.spans:
            if len(every) >= span:
                maybe.update(doc[np.flatnonzero(index.hits(shingles(every, span)) >= 0)].tolist())
        for i in maybe:
            found[i] = index.find(words[i], least)
        yield batch, found
    hashes.clear()
    freed()


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_bytes: int = 16 << 20) -> DataFrame:
    """A row for each row of ``docs`` and item that it holds: (key, item_key, first_word, n_words, distance, similarity).

    The best window of each, the first of equals.
    """
    rows = docs.select(key, F.col(text).alias("_text"))
    kind = items.schema[item_key].dataType
    schema = T.StructType([rows.schema[0], T.StructField(item_key, kind), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("similarity", T.DoubleType())])

    def pass_over(index: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _scan(batches, 1, "_text", index, least):
                at = [i for i, x in enumerate(found) for _ in x]
                cols = list(zip(*(y for x in found for y in x), strict=True)) or [()] * 5
                kinds = (to_arrow_type(kind), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names) if at else pa.RecordBatch.from_arrays([batch.column(0).slice(0, 0), *(pa.array([], t) for t in (to_arrow_type(kind), *kinds[1:]))], names=schema.names)

        return rows.mapInArrow(run, schema)

    parts, last = [], None
    for index in _blocks(items, item_key, "text", item_bytes):
        if last is not None:  # so that the driver holds one index at a time
            parts.append(written(last, "found-so-far"))
        last = pass_over(index)
    parts += [last] if last is not None else []
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, least: float = 0.8, text: str = "text", item_key: str = "item_id", item_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    out, at = docs, docs.columns.index(text)

    def passing(index: Items) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _scan(batches, at, text, index, least):
                yield batch.filter(pa.array([not x for x in found]))

        return run

    for i, index in enumerate(_blocks(items, item_key, "text", item_bytes)):
        out = (written(out, "clean-so-far") if i else out).mapInArrow(passing(index), docs.schema)
    return out
