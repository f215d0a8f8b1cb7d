"""Bytes of texts that lie in strings of some length which start elsewhere too, found by suffix order.

Method: suffixes are sorted in two stages. Those smaller than their successor are sorted directly; the others are induced from
them by a scan over the buckets of first symbols, in which each sorted suffix puts the one before it into its bucket. Then
the common prefixes of neighbours are computed: a string of ``length`` bytes starts twice if its suffix shares so many with a
neighbour.

On Spark no task can sort all texts, so suffixes that can share ``length`` bytes meet first. Of each such string the leftmost least
hash of its ``GRAM``-byte substrings is its anchor, which equal strings have in the same place. The strings of one anchor start at
consecutive bytes, and they make a piece: those starts and the bytes up to the last one's end. Pieces that are equal are counted
before they move, and one of them is fetched, with that count; pieces of one anchor meet in one task, which sorts the suffixes at
their starts and marks those that share ``length`` bytes with a neighbour, or whose piece is there several times. Anchors that occur
once are never fetched. What is found goes back to all places of an equal piece.

An anchor with more than ``KINDS`` different pieces (a passage that very many texts hold, at whose edge each goes on otherwise) is not
one task's: its strings are grouped one by one, by 128-bit digests, which Spark deals and pre-aggregates like any key.

Texts are written once, as numbered units (one a task), and read three times. What the passes ask of a unit, or tell it, is a table by
unit in the shared folder that the unit's task reads; texts are never shuffled. A task holds a batch of texts, one unit's requests, and
about ``FLUSH`` starts to sort.

Strings do not cross texts; bytes are those of UTF-8, so what is kept may end inside a character. Nulls: a null text counts as
empty; a text shorter than ``length`` keeps all. Texts of any length are taken whole. Of equal texts of ``length`` bytes and more, all
lose everything, and so do repeated rows: nobody is the first. Columns of the caller come back as they are, but the text
and those called like an added one. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantryline.llm.common import apart, freed, new_path, written

#: Bytes of the substrings whose least hash is an anchor.
GRAM = 32
#: Bytes hashed at once; places within a block take so many bits of a number.
BLOCK, PLACE = 1 << 18, 20
#: Starts sorted at once, or those of one anchor if they are more.
FLUSH = 1 << 19
#: Different pieces of one anchor that one task takes.
KINDS = 4096
#: Where a unit's number starts in a place.
UNIT = 40
SPANS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "end")]))
ADDED = ("n_bytes", "n_removed", "spans", "kept")
NUMBERS = np.random.default_rng(2024).integers(0, 1 << 64, 256, dtype=np.uint64)


# The order of suffixes


def smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; ends (symbol 0) count as such."""
    step = np.diff(symbols, append=np.int16(1))
    turns = np.flatnonzero(step)  # equal symbols go with the next that differ
    out = np.repeat(step[turns] > 0, np.diff(turns, prepend=-1))
    out[symbols == 0] = True
    return out


def suffix_order(symbols: np.ndarray, raw: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places in ``wanted`` in the order of their suffixes, right in the first ``depth`` symbols.

    ``symbols``: bytes plus one, and 0 behind each piece; ``raw``: the bytes, and any behind each piece. A suffix ends with its piece.
    """
    n = len(symbols)
    direct = smaller_than_next(symbols)
    stops = np.flatnonzero(direct)
    stop = np.repeat(stops, np.diff(stops, prepend=-1))  # the next directly sorted suffix, from each place on
    at = np.flatnonzero(wanted)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(stop[at] + 1, minlength=n + 1)
    needed = np.cumsum(edge)[:n] > 0
    mine = np.flatnonzero(needed & direct)
    ends = np.flatnonzero(symbols == 0)
    until = np.minimum(mine + depth, ends[np.searchsorted(ends, mine)])
    keys = [raw[i:j] for i, j in zip(mine.tolist(), until.tolist(), strict=True)]
    mine = mine[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)]
    del keys
    first = symbols[mine]
    queue, out = {}, []
    for c in np.unique(symbols[needed]).tolist():
        waves = [np.concatenate(queue.pop(c))] if c in queue else []
        while waves and len(waves[-1]):  # equal symbols before those
            before = waves[-1][waves[-1] > 0] - 1
            waves.append(before[(symbols[before] == c) & needed[before]])
        bucket = np.concatenate([*waves, mine[np.searchsorted(first, c) : np.searchsorted(first, c, "right")]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before] & (symbols[before] > c)]
        kinds = symbols[before]
        before = before[np.argsort(kinds, kind="stable")]
        found, cut = np.unique(np.sort(kinds), return_index=True)
        for k, part in zip(found.tolist(), np.split(before, cut[1:]), strict=False):
            queue.setdefault(k, []).append(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def adjacent_prefixes(raw: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each place in order shares with the next, up to ``length``; all have so many."""
    padded = raw + bytes(16)
    words = np.ndarray((len(raw) + 8,), "<u8", padded, strides=(1,))
    out, open_ = np.zeros(max(0, len(order) - 1), np.int64), np.arange(max(0, len(order) - 1))
    for j in range(0, length, 8):
        apart_ = words[order[open_] + j] ^ words[order[open_ + 1] + j]
        same = apart_ == 0
        low = apart_[~same]
        out[open_[~same]] += (np.log2((low & (~low + np.uint64(1))).astype(float)) // 8).astype(np.int64)
        open_ = open_[same]
        out[open_] += 8
    return np.minimum(out, length)


def repeated_starts(pieces: list[bytes], sizes: list[int], counts: list[int], length: int) -> list[np.ndarray]:
    """For each piece, which of its first ``sizes`` places start a string of ``length`` bytes that starts elsewhere too."""
    raw = b"\0".join(pieces) + b"\0"
    first = np.cumsum([0, *(len(x) + 1 for x in pieces[:-1])])
    symbols = np.frombuffer(raw, np.uint8).astype(np.int16) + np.int16(1)
    symbols[first + [len(x) for x in pieces]] = 0
    edge = np.zeros(len(raw) + 1, np.int64)
    edge[first] += 1
    edge[first + sizes] -= 1
    wanted = np.cumsum(edge[:-1]) > 0
    order = suffix_order(symbols, raw, wanted, length)
    same = np.flatnonzero(adjacent_prefixes(raw, order, length) >= length)
    twice = np.zeros(len(raw), bool)
    twice[order[same]] = twice[order[same + 1]] = True
    return [twice[b : b + m] | (n > 1) for b, m, n in zip(first.tolist(), sizes, counts, strict=True)]


def ranges(flags: np.ndarray) -> np.ndarray:
    """[from, to, from, to ...] of the runs of true."""
    return np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))


# Anchors and pieces


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first start, number of starts) of the pieces of a block; ``starts``: where strings start."""
    gram = min(GRAM, length)
    h, done = NUMBERS[data], 1
    while done < gram:
        step = min(done, gram - done)
        a, b = h[: len(h) - step], h[step:]
        h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        done += step
    least, done, wide = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while done < wide:
        step = min(done, wide - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    place = (least[starts] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(starts) != 1)]))
    return h[place[cut]].view(np.int64), starts[cut], np.diff(np.append(cut, len(starts)))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts of a column, where each starts, and the end)."""
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``anchors``, for texts of any length, in blocks; starts count from the first text's."""
    last, i, most = len(offsets) - 1, 0, (1 << PLACE) - 2 * length
    while i < last:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        if j == i + 1 and high - low > most:  # one long text: its starts in parts
            spans = [(b, min(b + most // 2, high - length + 1)) for b in range(low, high - length + 1, most // 2)]
            blocks = [(b, e + length - 1, np.arange(e - b)) for b, e in spans]
        else:
            many = np.maximum(np.diff(offsets[i : j + 1]) - length + 1, 0)
            begin = offsets[i:j] - low
            blocks = [(low, high, np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum()))]
        for b, e, starts in blocks:
            if len(starts):
                a, s, m = anchors(data[b:e], starts, length)
                yield a, s + b, m
        i = j


def numbered(df: DataFrame, text: str) -> DataFrame:
    """``df`` written, with ``_at``: the unit, and behind it the text's first byte within the unit."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << UNIT
        for batch in batches:
            _, offsets = bytes_of(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offsets[:-1] + at)], names=[*batch.schema.names, "_at"])
            at += int(offsets[-1])

    path = new_path(df.sparkSession, "units")
    schema = T.StructType([*df.schema, T.StructField("_at", T.LongType())])
    df.mapInArrow(number, schema).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def marks(texts: DataFrame, text: str, length: int) -> DataFrame:
    """(a, p, at, size): hash of the anchor, digest of the piece, its place, its starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            at, view = np.asarray(batch.column(1)), memoryview(data)
            for a, s, m in pieces_of(data, offsets, length):
                p = [xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(s.tolist(), (s + m + length - 1).tolist(), strict=True)]
                doc = np.searchsorted(offsets, s, "right") - 1
                cols = [a, np.array(p, np.uint64).view(np.int64), at[doc] + s - offsets[doc], m.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "p", "at", "size"])
        freed()

    return texts.select(text, "_at").mapInArrow(run, "a long, p long, at long, size int")


class ByUnit:
    """A table in the shared folder that tasks read by unit."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.path, self.columns = new_path(df.sparkSession, name), df.columns
        self.held = (None, None, None)  # a task's last unit, its rows and their places
        rows = df.withColumn("unit", F.shiftright("at", UNIT))
        rows.repartition("unit").sortWithinPartitions("unit", "at").write.partitionBy("unit").parquet(self.path)

    def rows(self, unit: int) -> pa.Table | None:
        """A unit's rows by place; None if there are none."""
        store, folder = fs.FileSystem.from_uri(self.path)
        every = store.get_file_info(fs.FileSelector(f"{folder}/unit={unit}", allow_not_found=True))
        found = []
        for x in every:
            if x.is_file and x.base_name.startswith("part-"):
                with store.open_input_file(x.path) as f:
                    found.append(pq.ParquetFile(f).read(columns=self.columns))
        return pa.concat_tables(found).sort_by("at").combine_chunks() if found else None

    def within(self, at: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, pa.Table]]:
        """(number of the text, its rows) for texts at places; texts without rows are left out."""
        for i, (low, n) in enumerate(zip(at.tolist(), sizes.tolist(), strict=True)):
            if low >> UNIT != self.held[0]:
                table = self.rows(low >> UNIT)
                self.held = (low >> UNIT, table, None if table is None else np.asarray(table.column("at").combine_chunks()))
            _, table, places = self.held
            if table is not None:
                x, y = np.searchsorted(places, (low, low + n)).tolist()
                if y > x:
                    yield i, table.slice(x, y - x)


def fetched(texts: DataFrame, text: str, wanted: ByUnit, length: int) -> DataFrame:
    """(a, p, n, size, piece) of the wanted pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            at, raw = np.asarray(batch.column(1)), memoryview(data)
            for i, rows in wanted.within(at, np.diff(offsets)):
                low = np.asarray(rows.column("at").combine_chunks()) - at[i] + offsets[i]
                high = low + np.asarray(rows.column("size").combine_chunks()) + length - 1
                piece = pa.array([bytes(raw[x:y]) for x, y in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
                cols = [rows.column(x).combine_chunks() for x in ("a", "p", "n", "size")]
                yield pa.RecordBatch.from_arrays([*cols, piece], names=["a", "p", "n", "size", "piece"])

    return texts.select(text, "_at").mapInArrow(run, "a long, p long, n long, size int, piece binary")


def sorted_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """(a, p, starts): ranges of starts whose strings start elsewhere too, among the pieces of one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            found = repeated_starts([r[4] for r in held], [r[3] for r in held], [r[2] for r in held], length)
            rows = [(r[0], r[1], ranges(x)) for r, x in zip(held, found, strict=True) if x.any()]
            if rows:
                a, p, starts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], names=["a", "p", "starts"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= FLUSH and r[0] != last:
                    yield from flush()
                    held, size = [], 0
                held.append(r)
                size, last = size + r[3], r[0]
        if held:
            yield from flush()
        freed()

    return pieces.repartition("a").sortWithinPartitions("a", "p").mapInArrow(run, "a long, p long, starts array<int>")


def single_strings(pieces: DataFrame, length: int) -> DataFrame:
    """As ``sorted_pieces``, string by string: for anchors with very many different pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, p, n, size, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = [xxhash.xxh3_128_intdigest(piece[i : i + length]) for i in range(size)]
                cols = [np.array([x >> 64 for x in one], np.uint64).view(np.int64), np.array([x & (1 << 64) - 1 for x in one], np.uint64).view(np.int64), np.full(size, a), np.full(size, p), np.full(size, n), np.arange(size, dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["x", "y", "a", "p", "n", "start"])

    each = written(pieces.mapInArrow(run, "x long, y long, a long, p long, n long, start int"), "strings")
    again = each.groupBy("x", "y").agg(F.sum("n").alias("n")).filter("n > 1").select("x", "y")
    found = each.join(again, ["x", "y"]).groupBy("a", "p").agg(F.sort_array(F.collect_list("start")).alias("at"))  # at most ``length`` a piece
    return found.select("a", "p", F.flatten(F.transform("at", lambda i: F.array(i, i + 1))).alias("starts"))


def without_repeats(df: DataFrame, text: str = "text", length: int = 200, kinds: int = KINDS) -> DataFrame:
    """``df`` without the text, with n_bytes, n_removed, spans (start and end of the removed runs) and kept (the other bytes)."""
    if length < 2:
        raise ValueError("strings have two bytes or more")
    plain, back = apart(df, text, own=ADDED)
    texts = numbered(plain.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit(""))), text)
    found_marks = marks(texts, text, length)
    pieces = found_marks.groupBy("a", "p").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.max("size").alias("size"))
    often = pieces.groupBy("a").agg(F.sum("n").alias("_all"), F.count("*").alias("_kinds")).filter("_all > 1")
    several = pieces.join(often.select("a", (F.col("_kinds") > kinds).alias("crowded")), "a")
    several = written(several, "several")
    parts = []
    for crowded, finish in ((False, sorted_pieces), (True, single_strings)):
        some = several.filter(F.col("crowded") == crowded).drop("crowded")
        if not some.isEmpty():
            parts.append(finish(fetched(texts, text, ByUnit(some, "wanted"), length), length))
    schema = T.StructType([*(x for x in texts.schema if x.name not in (text, "_at")), *(T.StructField(x, T.LongType()) for x in ADDED[:2]), T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())])
    told = None
    if parts:
        found = written(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "found")
        told = ByUnit(found_marks.join(found, ["a", "p"]).select("at", "starts"), "told")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.schema.get_field_index(text)
            data, offsets = bytes_of(batch.column(mine))
            at, sizes = np.asarray(batch.column(batch.schema.get_field_index("_at"))), np.diff(offsets)
            removed, spans, kept = np.zeros(len(sizes), np.int64), [[] for _ in sizes], [None] * len(sizes)
            for i, rows in told.within(at, sizes) if told else ():
                lists = rows.column("starts").combine_chunks()
                edges = np.asarray(lists.flatten()) + np.repeat(np.asarray(rows.column("at").combine_chunks()) - at[i], np.diff(np.asarray(lists.offsets)))
                n = int(sizes[i])
                edge = np.bincount(edges[::2], minlength=n + 1) - np.bincount(edges[1::2] + length - 1, minlength=n + 1)
                out = np.cumsum(edge[:n]) > 0
                removed[i] = out.sum()
                spans[i] = [{"start": x, "end": y} for x, y in ranges(out).reshape(-1, 2).tolist()]
                kept[i] = data[offsets[i] : offsets[i + 1]][~out].tobytes()
            for i, x in enumerate(kept):
                if x is None:
                    kept[i] = data[offsets[i] : offsets[i + 1]].tobytes()
            others = [c for k, c in enumerate(batch.columns) if batch.schema.names[k] not in (text, "_at")]
            yield pa.RecordBatch.from_arrays([*others, pa.array(sizes), pa.array(removed), pa.array(spans, span_type), pa.array(kept, pa.binary())], names=schema.names)
        freed()

    return back(texts.mapInArrow(run, schema))
