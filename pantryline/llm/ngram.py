"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

A text's tokens are its words, A-Z lower-cased, and one end. The probability of a token mixes the maximum-likelihood
estimates of all orders up to ``order`` and the uniform one over the training vocabulary and one unknown token. The mixture
weights depend on the bucket of the context: the longest context that training has, and the octave of its count. They
are learned by expectation-maximisation on held-out counts: part of the training texts (``heldout``) is deleted from
the counts, its tokens are binned by bucket and by the estimates' size, and each bucket's weights are fitted to them. The
final estimates come from all training texts.

Flow. Each scan task cuts its texts into units of about ``unit_bytes``. A unit's distinct n-grams go as sorted hashes with
their counts, cut by their leading bits, to parts: there counts are summed and answered in the order asked. A second
exchange brings the answers and the unit's token numbers together; those come from a second scan, which is less than to shuffle
them twice. So a frequent n-gram travels once a unit, not once a text or token, and the work in a part or a unit is bounded. The
answered units are written to the shared folder once; weights and scores are taken from them. Both scans must cut the same
units, as scans of files do (a checksum tells if they did not); for rows whose order a shuffle made, ``write_first`` writes
them to the shared folder before.

Hashes stand for words and n-grams. Words have 64 bits: two of n distinct ones share one with a probability of about
n*n / 2**65. N-grams have 10 bits more than the number of the text's bytes (64 at most), so that of the distinct ones fewer
than one in two thousand shares its hash, whatever the input's size.

Nulls: a null text counts as empty: one token, the end. A null condition counts as false, a null id stays null. Repeated rows
are scored and counted each, whatever their ids. Ids of any type come back as they are. Other columns are neither read nor
returned, so none can clash. Without training texts every probability is that of one unknown token, 1. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantryline.llm.common import text_batches, text_bytes, trimmed, whole_number, written

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
REQUEST, UNIT, STATS, CELLS = 0, 1, 2, 3
#: Bins of an estimate in an octave, for the held-out counts; a cell's estimates count by their means.
FINE = 2
NONE = np.zeros(0, np.uint64)
LONGS = ("dest", "unit", "kind", "level", "part", "n", "check")
BYTES = ("p0", "p1", "p2", "p3")
BEGIN, END = b"\x00 begin", b"\x00 end"  # no word has a space


def _schema(ids: T.DataType) -> tuple[T.StructType, pa.Schema]:
    """Of the rows that travel: unit, request, sums and cells alike."""
    fields = [T.StructField(x, T.LongType()) for x in LONGS] + [T.StructField(x, T.BinaryType()) for x in BYTES]
    arrow = [(x, pa.int64()) for x in LONGS] + [(x, pa.binary()) for x in BYTES]
    return T.StructType([*fields, T.StructField("ids", T.ArrayType(ids))]), pa.schema([*arrow, ("ids", pa.list_(pa.int64() if isinstance(ids, T.LongType) else pa.string()))])


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, as many as the largest needs, compressed: small numbers take little."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return zstandard.compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 6)


def unpack(b: bytes, n: int) -> np.ndarray:
    """The ``n`` integers that ``pack`` got."""
    out = np.zeros((n, 8), np.uint8)
    b = zstandard.decompress(b)
    if n:
        out[:, : len(b) // n] = np.frombuffer(b, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view(np.uint64)


def _row(**x) -> dict:
    return {"dest": 0, "unit": 0, "kind": 0, "level": 0, "part": 0, "n": 0, "check": 0, "p0": b"", "p1": b"", "p2": b"", "p3": b"", "ids": None} | x


class Tokens:
    """The tokens of a unit: ``order - 1`` beginnings, the words and an end for each text, as numbers of local words.

    Number 0 is the beginning, 1 the end; ``hashes`` has each number's hash.
    """

    def __init__(self, order: int, numbers: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        self.order, self.numbers, self.lengths, self.hashes = order, numbers, lengths, hashes
        size = lengths + order - 1
        first = np.cumsum(size) - size
        #: where tokens count: all but the beginnings
        self.event = np.ones(len(numbers), bool)
        for k in range(order - 1):
            self.event[first + k] = False
        #: the last beginning of each text, which is a context
        self.start = first + order - 2
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), size)

    @classmethod
    def of(cls, order: int, texts: list[bytes]) -> Tokens:
        """From texts."""
        chunks, words, sizes, held = [], [], [], 0
        for x in texts:
            w = x.lower().split()
            sizes.append(len(w))
            words += w
            held += len(x)
            if held > 1 << 20:  # as Arrow, words take a third of what they take in a list
                chunks.append(pa.array(words, pa.binary()))
                words, held = [], 0
        chunks.append(pa.array(words, pa.binary()))
        coded = pa.chunked_array(chunks).dictionary_encode().unify_dictionaries().combine_chunks()
        names, indices = [BEGIN, END, *coded.dictionary.to_pylist()], coded.indices.to_numpy()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        sizes = np.array(sizes, np.int64)
        first = np.cumsum(sizes + order) - sizes - order  # where each text begins
        numbers = np.zeros(int((sizes + order).sum()), np.int32)
        numbers[np.arange(len(indices)) + np.repeat(first + order - 1 - (np.cumsum(sizes) - sizes), sizes)] = indices + 2
        numbers[first + order - 1 + sizes] = 1
        return cls(order, numbers, sizes + 1, hashes)

    def at(self, level: int) -> np.ndarray:
        """Where n-grams of this order are counted: at tokens, and as contexts at the last beginnings."""
        if level == self.order or self.order == 1:
            return np.flatnonzero(self.event)
        where = self.event.copy()
        where[self.start] = True
        return np.flatnonzero(where)

    def keys(self) -> Iterator[tuple[int, np.ndarray]]:
        """(order, hash of the n-gram that ends at each place) from order 2 on; a context is the key before."""
        h = self.hashes[self.numbers]
        key = h
        h = h * B
        for level in range(2, self.order + 1):
            new = np.empty_like(key)
            new[:1], new[1:] = key[:1], key[:-1]
            key = new
            for by, times in ((31, A), (29, B), (32, None)):
                key ^= key >> np.uint64(by)
                if times is not None:
                    key *= times
                if by == 31:
                    key += h
                    key += np.uint64(level)
            yield level, key

    def distinct(self, bits: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(order, places, distinct hashes in order, number of each place's hash); ``bits``: of hashes from order 2 on."""
        order = np.argsort(self.hashes, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        at = self.at(1)
        yield 1, at, self.hashes[order], rank[self.numbers[at]]
        for level, key in self.keys():
            at = self.at(level)
            yield level, at, *_ranked(key[at] >> np.uint64(64 - bits))


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each value's place among them."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], place


def _units(docs: DataFrame, order: int, unit_bytes: int, ids_kind: T.DataType) -> DataFrame:
    """A row for each unit with its token numbers."""
    schema, arrow = _schema(ids_kind)

    def rows(name: int, check: int, tokens: Tokens, ids: list, train: np.ndarray, out: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist([_row(dest=name, unit=name, kind=UNIT, n=len(tokens.numbers), check=check, p0=pack(tokens.numbers), p1=pack(tokens.lengths), p2=tokens.hashes.tobytes(), p3=pack(train + 2 * out), ids=ids)], schema=arrow)

    return _by_unit(docs, order, unit_bytes, schema, rows)


def _requests(docs: DataFrame, order: int, unit_bytes: int, parts_bits: int, bits: int, ids_kind: T.DataType) -> DataFrame:
    """Units' distinct n-grams with their counts in training and deleted texts, a row for each unit, order and part."""
    schema, arrow = _schema(ids_kind)

    def rows(name: int, check: int, tokens: Tokens, ids: list, train: np.ndarray, out: np.ndarray) -> Iterator[pa.RecordBatch]:
        for level, at, keys, place in tokens.distinct(bits):
            doc = tokens.doc[at]
            every = np.bincount(place, weights=train[doc], minlength=len(keys)).astype(np.uint64)
            deleted = np.bincount(place, weights=out[doc], minlength=len(keys)).astype(np.uint64)
            part = (keys >> np.uint64((64 if level == 1 else bits) - parts_bits)).astype(np.int64) if parts_bits else np.zeros(len(keys), np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(keys)]
            yield pa.RecordBatch.from_pylist([_row(dest=int(part[a]), unit=name, kind=REQUEST, level=level, part=int(part[a]), n=b - a, check=check, p0=pack(np.diff(keys[a:b])), p1=pack(every[a:b]), p2=pack(deleted[a:b]), p3=keys[a : a + 1].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], schema=arrow)

    return _by_unit(docs, order, unit_bytes, schema, rows)


def _by_unit(docs: DataFrame, order: int, unit_bytes: int, schema: T.StructType, rows: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0

        def unit() -> Iterator[pa.RecordBatch]:
            ids, texts, train, out = ([y for x in held for y in x[i]] for i in range(4))
            train = np.array(train, np.int64)
            tokens = Tokens.of(order, texts)
            check = xxhash.xxh64_intdigest(tokens.numbers.tobytes() + tokens.hashes.tobytes()) >> 1
            yield from rows((held[0][4] << 24) + number, check, tokens, ids, train, np.array(out, np.int64) * train)

        for batch in text_batches(batches, "_text", unit_bytes):
            part = batch.to_pydict()
            held.append((part["_id"], part["_text"], part["_train"], part["_out"], part["_part"][0]))
            size += sum(map(len, part["_text"]))
            if size >= unit_bytes // 2:
                yield from unit()
                number, held, size = number + 1, [], 0
        if held:
            yield from unit()
        held = []
        trimmed()

    # the number of the scan's own partition, whatever stands above it in a plan
    return docs.withColumn("_part", F.spark_partition_id()).mapInArrow(run, schema)


def _answered(requests: DataFrame, ids_kind: T.DataType) -> DataFrame:
    """Requests summed and answered, part by part."""
    schema, arrow = _schema(ids_kind)

    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        for level in sorted({r["level"] for r in rows}):
            mine = [r for r in rows if r["level"] == level]
            keys = np.concatenate([np.cumsum(np.concatenate((np.frombuffer(r["p3"], np.uint64), unpack(r["p0"], r["n"] - 1)))) for r in mine])
            distinct, place = _ranked(keys)
            del keys
            every = np.bincount(place, weights=np.concatenate([unpack(r["p1"], r["n"]) for r in mine])).astype(np.uint64)
            deleted = np.bincount(place, weights=np.concatenate([unpack(r["p2"], r["n"]) for r in mine])).astype(np.uint64)
            a = 0
            for r in mine:
                at = place[a : a + r["n"]]
                a += r["n"]
                # what is deleted of an n-gram matters to units that delete some of it: only their held-out tokens ask
                lost = np.where(unpack(r["p2"], r["n"]) > 0, deleted[at], 0)
                out.append(_row(dest=r["unit"], unit=r["unit"], kind=REQUEST, level=level, part=r["part"], n=r["n"], check=r["check"], p1=pack(every[at]), p2=pack(lost)))
            if level == 1:
                real = distinct != np.uint64(xxhash.xxh64_intdigest(BEGIN))
                n, v, lost = every[real].sum(), (every[real] > 0).sum(), deleted[real].sum()
                out.append(_row(dest=-1 - rows[0]["dest"], unit=-1, kind=STATS, n=int(n), level=int(v), part=int(lost)))  # all, distinct, deleted
        del rows, mine, distinct, place, every, deleted
        trimmed()
        return pa.Table.from_pylist(out, schema=arrow)

    return requests.groupBy("dest").applyInArrow(run, schema)


def _buckets(ctx: list[np.ndarray], n: int) -> np.ndarray:
    """Of ``n`` tokens: 64 times the number of orders whose context is there, plus the octave of the longest one's count.

    ``ctx``: counts of the contexts of orders 2, 3, ...; a longer one is there only if the shorter ones are.
    """
    out = np.zeros(n, np.int64)
    for k, c in enumerate(ctx, 1):
        with np.errstate(divide="ignore"):
            octave = np.floor(np.log2(c.astype(float)))
        out = np.where(c > 0, 64 * k + np.where(c > 0, octave, 0).astype(np.int64), out)
    return out


def _estimates(event: list[np.ndarray], ctx: list[np.ndarray]) -> list[np.ndarray]:
    """Of orders 2, 3, ...; zero where the context is not there."""
    return [np.divide(c, x, out=np.zeros(len(c)), where=x > 0) for c, x in zip(event[1:], ctx, strict=True)]


def _counts(tokens: Tokens, by_level: dict[int, np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """At each token: counts of its n-grams of orders 1, 2, ..., and of the contexts of orders 2, 3, ..."""
    full = []
    for level in range(1, tokens.order + 1):
        x = np.zeros(len(tokens.numbers))
        x[tokens.at(level)] = by_level[level]
        full.append(x)
    at = np.flatnonzero(tokens.event)
    return [x[at] for x in full], [x[at - 1] for x in full[:-1]]


def cell_code(bucket: np.ndarray, estimates: list[np.ndarray]) -> np.ndarray:
    """A number for a bucket and the bins of the estimates; bin 0 is an estimate of zero."""
    code = bucket
    for x in estimates:
        with np.errstate(divide="ignore"):
            code = code * 1200 + np.where(x > 0, np.round(FINE * np.log2(np.where(x > 0, x, 1))) + 600, 0).astype(np.int64)
    return code


def _joined(answered: DataFrame, order: int, bits: int, ids_kind: T.DataType) -> DataFrame:
    """One row for each unit with the counts at its places, and rows of its held-out tokens by bucket and bin."""
    schema, arrow = _schema(ids_kind)

    def run(table: pa.Table) -> pa.Table:
        kind, level_of, part_of = (np.asarray(table.column(x)) for x in ("kind", "level", "part"))
        if kind[0] == STATS:
            return table
        there = np.flatnonzero(kind == UNIT).tolist()
        unit = table.slice(there[0], 1).to_pylist()[0] if there else {"check": None, "ids": []}
        docs = len(unit["ids"])
        if set(table.column("check").to_pylist()) != {unit["check"]}:
            raise ValueError("the input was not read in the same order twice; pass write_first")
        tokens = Tokens(order, unpack(unit["p0"], unit["n"]).astype(np.int32), unpack(unit["p1"], docs).astype(np.int64), np.frombuffer(unit["p2"], np.uint64))
        unit["p0"] = b""
        at = np.flatnonzero(tokens.event)
        held = at[(unpack(unit["p3"], docs) >= 2)[tokens.doc[at]]]

        def answers(level: int, column: str) -> np.ndarray:
            """The level's counts in the order of its parts; rows are read one by one, and counts take four bytes where they can."""
            mine = np.flatnonzero((kind == REQUEST) & (level_of == level))
            mine = mine[np.argsort(part_of[mine])].tolist()
            found = [unpack(table.column(column)[i].as_py(), table.column("n")[i].as_py()) for i in mine]
            return np.concatenate([x.astype(np.uint32) for x in found] if all(int(x.max(initial=0)) < 1 << 32 for x in found) else found)

        every, event, ctx = {}, [], []
        for level, at, _, place in tokens.distinct(bits):
            found = answers(level, "p1")
            every[level] = pack(found[place])
            # of held-out tokens alone: their n-grams, and those before them as contexts
            found = found.astype(np.int64) - answers(level, "p2").astype(np.int64)
            event.append(found[place[np.searchsorted(at, held)]].astype(float))
            if level < order:
                ctx.append(found[place[np.searchsorted(at, held - 1)]].astype(float))
            del found, place, at
        out = [unit | {"dest": 0, "p0": every[1], "p2": every.get(2, b""), "p3": every.get(3, b"")}]
        if len(event[0]):
            ml = [event[0], *_estimates(event, ctx)]  # the first is a count: the number of all tokens is not known yet
            cell, place, n = np.unique(cell_code(_buckets(ctx, len(event[0])), ml), return_inverse=True, return_counts=True)
            sums = np.stack([np.bincount(place, weights=x) for x in ml])
            out.append(_row(kind=CELLS, n=len(cell), p0=cell.tobytes(), p1=n.astype(np.int64).tobytes(), p2=sums.tobytes()))
        del tokens, event, ctx, every
        trimmed()
        return pa.Table.from_pylist(out, schema=arrow)

    return answered.groupBy("dest").applyInArrow(run, schema)


def em_weights(n: np.ndarray, ml: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Mixture weights that maximise the likelihood of ``n`` tokens each with the estimates ``ml`` (cells by components)."""
    w = (ml.max(0) > 0) / max(1, (ml.max(0) > 0).sum())
    for _ in range(rounds):
        share = w * ml
        new = (n[:, None] * share / share.sum(1, keepdims=True)).sum(0) / n.sum()
        done = np.abs(new - w).max() < 1e-7
        w = new
        if done:
            break
    w[0] = max(w[0], 1e-6)  # an unknown token is always possible
    return w / w.sum()


def mixture_weights(table: DataFrame, order: int, tokens: int, vocabulary: int) -> np.ndarray:
    """Weights by bucket (rows) and component: uniform, order 1, 2, ...

    The cells are bounded by the bins, whatever the input; each bucket is fitted in a task of its own.
    """
    names = [f"s{k}" for k in range(1, order + 1)]
    schema = ", ".join(["cell long", "n long", *(f"{x} double" for x in names)])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sums = np.frombuffer(r["p2"]).reshape(order, r["n"])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["p0"], np.int64)), pa.array(np.frombuffer(r["p1"], np.int64)), *map(pa.array, sums)], names=["cell", "n", *names])

    every = table.filter(F.col("kind") == CELLS).select("n", "p0", "p1", "p2").mapInArrow(cells, schema)
    every = every.groupBy("cell").agg(*(F.sum(x).alias(x) for x in ("n", *names))).withColumn("bucket", F.expr(f"cell div {1200 ** order}L"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(float)
        ml = np.stack([np.full(len(n), 1 / (vocabulary + 1)), pdf["s1"].to_numpy() / n / max(1, tokens), *(pdf[x].to_numpy() / n for x in names[1:])], axis=1)
        w = em_weights(n, ml)
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])] * len(w), "k": range(len(w)), "w": w})

    found = {}
    for r in every.groupBy("bucket").applyInPandas(fit, "bucket long, k long, w double").collect():  # at most 64 buckets an order
        found.setdefault(r["bucket"], {})[r["k"]] = r["w"]
    out = np.zeros((64 * order, order + 1))
    if not vocabulary:  # nothing was trained: one unknown token is all that there is
        out[:, 0] = 1
        return out
    for b in range(len(out)):
        near = sorted((x for x in found if x // 64 == b // 64), key=lambda x: abs(x - b))
        if near:
            out[b] = [found[near[0]][k] for k in range(order + 1)]
        else:  # no held-out token with such a context: all that can be there, alike
            out[b, : b // 64 + 2] = 1 / (b // 64 + 2)
    return out


def interpolated_scores(docs: DataFrame, train: Column, heldout: Column, order: int = 3, key: str = "doc_id", text: str = "text", unit_bytes: int = 8 << 20, write_first: bool = False) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``train``: rows to learn from; ``heldout``: of those, the rows whose counts are deleted to learn the mixture weights.
    ``score``: log10 of the text's probability; ``base_score``: that of single tokens with 0.5 added to counts; ``n_known``:
    tokens that training has.
    """
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    kind = docs.select(F.col(key)).schema[0].dataType
    ids_kind = T.LongType() if whole_number(kind) else T.StringType()
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rows = docs.select(F.col(key).cast(ids_kind).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"), flag(train).alias("_train"), flag(heldout).alias("_out"))
    size = text_bytes(docs, text)
    parts_bits, bits = (size // (2 * unit_bytes)).bit_length(), min(64, max(40, size.bit_length() + 10))
    rows = written(rows, "ngram-rows") if write_first else rows
    answered = _answered(_requests(rows, order, unit_bytes, parts_bits, bits, ids_kind), ids_kind)
    table = written(_joined(answered.unionByName(_units(rows, order, unit_bytes, ids_kind)), order, bits, ids_kind), "ngram-units")
    n, v, deleted = table.filter(F.col("kind") == STATS).agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "level", "part"))).first()
    weights = mixture_weights(table, order, n - deleted, v)
    schema = T.StructType([T.StructField(key, ids_kind), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(x, T.DoubleType()) for x in ("base_score", "score"))])
    arrow = _schema(ids_kind)[1].field("ids").type.value_type

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = r["ids"]
                lengths = unpack(r["p1"], len(ids)).astype(np.int64)
                tokens = Tokens(order, np.zeros(int(lengths.sum()) + (order - 1) * len(ids), np.int8), lengths, NONE)
                event, ctx = _counts(tokens, {k: unpack(r[p], len(tokens.at(k))) for k, p in zip(range(1, order + 1), ("p0", "p2", "p3"), strict=False)})
                bucket = _buckets(ctx, len(event[0]))
                p = (weights[:, 0] / (v + 1))[bucket] + weights[:, 1][bucket] * event[0] / max(1, n)
                for k, ml in enumerate(_estimates(event, ctx), 2):
                    p += weights[:, k][bucket] * ml
                doc = tokens.doc[tokens.event]
                by_doc = lambda x: np.bincount(doc, weights=x, minlength=len(ids))  # noqa: B023, E731
                base = by_doc(np.log10((event[0] + 0.5) / (n + 0.5 * (v + 1))))
                known = by_doc(event[0] > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), n)), pa.array(base), pa.array(by_doc(np.log10(p)))], names=schema.names)
        trimmed()

    scored = table.filter(F.col("kind") == UNIT).select("ids", "p0", "p1", "p2", "p3").mapInArrow(score, schema)
    return scored.withColumn(key, F.col(key).cast(kind)) if kind != ids_kind else scored
