"""N-best SentencePiece segmentation and its inverse.

The lattice of a text holds every piece of a SentencePiece vocabulary that matches somewhere, and for a character that
no piece covers its UTF-8 bytes' pieces, at ``UNKNOWN`` below the lowest score. A forward Viterbi pass gives the best
score up to each place; a backward A-star search from the end takes those as its heuristic, which is exact, so complete
segmentations leave the queue in the order of their scores.

The lattice falls apart between two characters that stand beside each other in no piece, as before each space that ends
a word. Words and parts are kept by a task: Viterbi passes from both ends give a part's best segmentation and its loss to the
second best (the best path through any edge beside the best one), and the A-star search lists its others when a text
needs them. The N best of a text are those of its words' combinations: only the N-1 words with the smallest loss to their
second best can differ from their best.

Texts are normalised as the vocabulary says: one space in front, spaces as they are. Decoding gives the text back exactly,
also with U+2581 in it, which is spelled in bytes. Ties of score: the order of the search, which depends on the part
alone, then the earlier part.

Nulls: a null text counts as empty; an empty text has one segmentation of no pieces and score 0; a null id stays null. Long texts
are segmented whole. Repeated rows give repeated results. Columns other than the id and the text are not read by ``encode``, so
none can clash; ``decode`` returns them as they are, whatever their names, but for one called like the text, which gives way to
it. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantryline.llm.common import apart, freed, text_batches

MARK, UNKNOWN, LEAST = "▁", 10.0, float("-inf")
#: Words, and characters of words and parts, that a task keeps.
KEPT_WORDS, KEPT_CHARS = 500_000, 24 << 20
#: Longer parts are searched one by one.
LONGEST = 24


def packed(ids: tuple[int, ...]) -> bytes:
    """Little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}i", *ids)


def codes(names: list[str], size: int) -> np.ndarray:
    """Code points of strings of one size, a row each."""
    return np.frombuffer("".join(names).encode("utf-32-le"), "<u4").reshape(-1, size).astype(np.uint64)


def hashes(text: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the first 1, 2, ... columns."""
    out, h = [], np.full(len(text), 7, np.uint64)
    for k in range(text.shape[1]):
        h = (h ^ text[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


class Lattice:
    """A vocabulary's pieces, with spaces for their marks."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        every = range(sp.get_piece_size())
        plain = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = {i: sp.id_to_piece(i).replace(MARK, " ") for i in plain}
        self.pieces = {names[i]: (i, sp.get_score(i)) for i in plain}
        #: what a piece or the beginning of one is: (id, score), or None for a beginning alone
        self.table = {p[:n]: None for p in self.pieces for n in range(1, len(p))} | self.pieces
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in every if sp.is_byte(i)}
        self.bytes_of = {i: p.encode() for i, p in names.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.lowest = min(s for _, s in self.pieces.values() if s > -1e8) - UNKNOWN  # some pieces have a far lower placeholder
        # by length: hashes in order, scores and ids, for many parts at once
        self.by_size: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64),) * 3]
        for size in range(1, 1 + max(map(len, self.pieces))):
            names = [x for x in self.pieces if len(x) == size] or ["\0" * size]
            h = hashes(codes(names, size))[-1]
            order = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise AssertionError("two pieces share a hash")
            score, number = (np.array([self.pieces.get(x, (-1, LEAST))[k] for x in names])[order] for k in (1, 0))
            self.by_size.append((h[order], score.astype(float), number.astype(np.int32)))
        within = re.escape("".join(sorted({c for p in self.pieces if len(p) > 1 for c in p} - {" "})))
        self.parts = re.compile(f" *[{within}]+| +|[^ {within}]", re.DOTALL)

    def cut(self, text: str) -> list[str]:
        """The parts of a word."""
        out, a, pairs = [], 0, self.pairs
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in pairs:
                out.append(text[a:k])
                a = k
        out.append(text[a:])
        return out

    def edges(self, text: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each end: (start, ids, score) of what ends there."""
        n, get = len(text), self.table.get
        out: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                found = get(text[i:j], False)
                if found:
                    out[j].append((i, (found[0],), found[1]))
                elif found is False:
                    break
            if text[i] not in self.pieces:
                out[i + 1].append((i, tuple(self.byte[b] for b in text[i].encode()), self.lowest))
        return out

    def viterbi(self, text: str) -> tuple[float, tuple[int, ...], float]:
        """(score, ids, loss to the second best) of a part's best segmentation; the loss is infinite without a second."""
        n, get, edges = len(text), self.table.get, []
        most, rest, via = [0.0] + [LEAST] * n, [LEAST] * n + [0.0], [0] * (n + 1)
        for i in range(n):
            here = most[i]
            for j in range(i + 1, n + 1):
                found = get(text[i:j], False)
                if found:
                    if here + found[1] > most[j]:
                        most[j], via[j] = here + found[1], len(edges)
                    edges.append((i, j, *found))
                elif found is False:
                    break
            if text[i] not in self.pieces:
                if here + self.lowest > most[i + 1]:
                    most[i + 1], via[i + 1] = here + self.lowest, len(edges)
                edges.append((i, i + 1, -1, self.lowest))
        for i, j, _, s in reversed(edges):
            if s + rest[j] > rest[i]:
                rest[i] = s + rest[j]
        path, on, j = [], set(), n
        while j:
            on.add(via[j])
            i, _, x, _ = edges[via[j]]
            path.append((x,) if x >= 0 else tuple(self.byte[b] for b in text[i].encode()))
            j = i
        second = max((most[i] + s + rest[j] for k, (i, j, _, s) in enumerate(edges) if k not in on), default=LEAST) if len(edges) > len(on) else LEAST
        return most[n], tuple(chain.from_iterable(reversed(path))), most[n] - second

    def viterbi_of(self, names: list[str]) -> list[tuple[float, bytes, float]]:
        """Of many parts: (score, ids as bytes, loss), as ``viterbi`` gives them; parts of one length go together."""
        out: dict[str, tuple[float, bytes, float]] = {}
        by_length: dict[int, list[str]] = {}
        for x in names:
            by_length.setdefault(len(x), []).append(x)
        for n, group in by_length.items():
            for lo in range(0, len(group), 4096):
                part = group[lo : lo + 4096]
                if n <= LONGEST and len(part) >= 16:
                    out.update(zip(part, self._together(part, n), strict=True))
        for x in names:
            if out.get(x) is None:
                score, ids, loss = self.viterbi(x)
                out[x] = (score, packed(ids), loss)
        return [out[x] for x in names]

    def _together(self, names: list[str], n: int) -> list[tuple[float, bytes, float] | None]:
        """Parts of ``n`` characters; None for those that need a byte's piece."""
        m, text = len(names), codes(names, n)
        most, rest = np.full((n + 1, m), LEAST), np.full((n + 1, m), LEAST)
        most[0] = rest[n] = 0.0
        size, number = np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.int32)
        plain, edges = np.ones(m, bool), {}
        for i in range(n):
            for k, h in enumerate(hashes(text[:, i : i + len(self.by_size) - 1]), 1):
                known, scores, ids = self.by_size[k]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                s = np.where(known[at] == h, scores[at], LEAST)
                if k == 1:
                    plain &= s > LEAST
                if not (s > LEAST).any():
                    continue
                edges[i, k] = s
                x = most[i] + s
                better = x > most[i + k]
                most[i + k][better], size[i + k][better], number[i + k][better] = x[better], k, ids[at][better]
        for (i, k), s in reversed(edges.items()):
            np.maximum(rest[i], s + rest[i + k], out=rest[i])
        # the best path's pieces by the place where they start
        rows, end = np.arange(m), np.full(m, n)
        used, chosen = np.zeros((n, m), np.int64), np.zeros((n, m), np.int32)
        while (open_rows := rows[(end > 0) & plain]).size:
            j = end[open_rows]
            k = size[j, open_rows]
            used[j - k, open_rows], chosen[j - k, open_rows] = k, number[j, open_rows]
            end[open_rows] = j - k
        second = np.full(m, LEAST)
        for (i, k), s in edges.items():
            np.maximum(second, np.where(used[i] == k, LEAST, most[i] + s + rest[i + k]), out=second)
        flat = chosen.T[used.T > 0].astype("<i4").tobytes()
        ends = np.cumsum((used > 0).sum(0)) * 4
        starts = np.concatenate(([0], ends[:-1]))
        with np.errstate(invalid="ignore"):
            loss = most[n] - second
        return [(x, flat[a:b], y) if ok else None for x, a, b, y, ok in zip(most[n].tolist(), starts.tolist(), ends.tolist(), loss.tolist(), plain.tolist(), strict=True)]

    def best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best (score, ids) of a part, best first."""
        edges, most = self.edges(text), [0.0]
        for j in range(1, len(text) + 1):
            most.append(max((most[i] + s for i, _, s in edges[j]), default=float("-inf")))
        # (minus the whole path's score, a number for ties, place, score behind it, ids behind it as a linked list)
        queue, out, number = [(-most[-1], 0, len(text), 0.0, ())], [], 0
        while queue and len(out) < n:
            _, _, at, behind, path = heapq.heappop(queue)
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((behind, tuple(ids)))
                continue
            for i, ids, s in edges[at]:
                number += 1
                heapq.heappush(queue, (-(most[i] + s + behind), number, i, s + behind, (ids, path)))
        return out

    def decode(self, ids: Iterator[int]) -> str:
        """The text of a segmentation."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode().removeprefix(" ")


@cache
def lattice(model: str) -> Lattice:
    """One a worker."""
    return Lattice(model)


class Words:
    """What a task keeps of words: their best ids as bytes, score and loss, and the N best of those that were asked for."""

    def __init__(self, lattice: Lattice, n: int) -> None:
        self.lattice, self.n = lattice, n
        self.parts: dict[str, tuple[float, bytes, float]] = {}
        self.number: dict[str, int] = {}
        self.ids: dict[str, bytes] = {}
        self.score, self.loss = np.zeros(1024), np.zeros(1024)
        self.others: dict[str, list[tuple[float, bytes]]] = {}
        self.chars = 0

    def add(self, texts: list[str]) -> list[list[str]]:
        """The words of texts, each with its spaces. New ones are added, all together."""
        split = [self.lattice.parts.findall(f" {x}") if x else [] for x in texts]
        new = {w: self.lattice.cut(w) for w in set(chain.from_iterable(split)).difference(self.number)}
        fresh = list(set(chain.from_iterable(new.values())).difference(self.parts))
        self.chars += sum(map(len, new)) + sum(map(len, fresh))
        for name, found in zip(fresh, self.lattice.viterbi_of(fresh), strict=True):
            ids = struct.unpack(f"<{len(found[1]) // 4}i", found[1])
            if b"".join(map(self.lattice.bytes_of.__getitem__, ids)) != name.encode():
                raise AssertionError(f"{name!r} does not decode")
            self.parts[name] = found
        while len(self.loss) < len(self.ids) + len(new):
            self.score, self.loss = np.concatenate([self.score, self.score]), np.concatenate([self.loss, self.loss])
        for w, names in new.items():
            i = self.number[w] = len(self.ids)
            found = [self.parts[x] for x in names]
            self.ids[w] = b"".join(x[1] for x in found)
            self.score[i], self.loss[i] = sum(x[0] for x in found), min(x[2] for x in found)
        return split

    def _best_of(self, word: str) -> list[tuple[float, bytes]]:
        """(loss, ids) of a word's N best, from those of its parts; only the N-1 parts of least loss can differ from their best."""
        if word not in self.others:
            parts = self.lattice.cut(word)
            loss = [self.parts[x][2] for x in parts]
            few = set(sorted((k for k in range(len(parts)) if loss[k] < np.inf), key=lambda k: (loss[k], k))[: self.n - 1])
            ways: list[tuple[float, tuple]] = [(0.0, ())]
            for k in sorted(few):
                score, mine, _ = self.parts[parts[k]]
                rest = [(score - s, packed(ids)) for s, ids in self.lattice.best(parts[k], self.n)]
                # of equals the Viterbi pass's goes first
                every = [(0.0, mine), *(x for x in rest if x[1] != mine)][: self.n]
                ways = sorted(((d + e, (*way, (k, x))) for d, way in ways for e, x in every), key=lambda x: x[0])[: self.n]
            best = [self.parts[x][1] for x in parts]
            self.others[word] = [(d, b"".join({**dict(enumerate(best)), **dict(way)}.values())) for d, way in ways]
        return self.others[word]

    def segmentations(self, words: list[str]) -> Iterator[tuple[float, bytes]]:
        """The N best of a text: (score, ids as little-endian 32-bit integers)."""
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        score, loss = float(self.score[at].sum()), self.loss[at]
        best = list(map(self.ids.__getitem__, words))
        few = min(self.n - 1, len(words))
        # the words of least loss, the earlier of equals
        few_at = sorted(np.flatnonzero(loss <= np.partition(loss, few - 1)[few - 1]).tolist(), key=lambda k: (loss[k], k))[:few] if few else []
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        for k in sorted(few_at):
            if loss[k] < np.inf:
                ways = sorted(((d + e, (*way, (k, r))) for d, way in ways for r, (e, _) in enumerate(self._best_of(words[k]))), key=lambda x: x[0])[: self.n]
        for d, way in ways:
            mine = best
            for k, r in way:
                if r:
                    mine = mine[:] if mine is best else mine
                    mine[k] = self._best_of(words[k])[r][1]
            yield score - d, b"".join(mine)


def encode(docs: DataFrame, model: str, n: int = 4, ids_of: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its ``n`` best segmentations (fewer, if there are fewer), best first.

    (key, round_trip boolean, scores array<double>, n_pieces array<long>, ids_crc32 array<long>, ids
    array<array<int>>); ``round_trip``: the best decodes to the text; ``ids_crc32``: of the ids as little-endian 32-bit
    integers; ``ids``: those of the first ``ids_of`` segmentations, left out if that is 0.
    """
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lists = [T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("n_pieces", T.ArrayType(T.LongType())), T.StructField("ids_crc32", T.ArrayType(T.LongType()))]
    schema = T.StructType([rows.schema[0], T.StructField("round_trip", T.BooleanType()), *lists, *([T.StructField("ids", T.ArrayType(T.ArrayType(T.IntegerType())))] * bool(ids_of))])

    def ends(sizes: list[int]) -> pa.Array:
        return pa.array(np.cumsum([0, *sizes]), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Words(lattice(model), n)
        for batch in text_batches(batches, "_text", 2 << 20):
            if len(kept.ids) > KEPT_WORDS or kept.chars > KEPT_CHARS:
                kept = Words(lattice(model), n)
            best, back = [], []
            texts = batch.column(1).to_pylist()
            for x, words in zip(texts, kept.add(texts), strict=True):
                back.append("".join(words).removeprefix(" ") == x)  # each part's best was decoded when it was added
                best.append(list(kept.segmentations(words)))
            at = ends(list(map(len, best)))
            flat = [y for x in best for y in x]
            cols = [batch.column(0), pa.array(back, pa.bool_())]
            for values, kind in (([s for s, _ in flat], pa.float64()), ([len(y) // 4 for _, y in flat], pa.int64()), ([zlib.crc32(y) for _, y in flat], pa.int64())):
                cols.append(pa.ListArray.from_arrays(at, pa.array(values, kind)))
            if ids_of:
                first = [y for x in best for _, y in x[:ids_of]]
                inner = pa.ListArray.from_arrays(ends([len(y) // 4 for y in first]), pa.array(np.frombuffer(b"".join(first), "<i4"), pa.int32()))
                cols.append(pa.ListArray.from_arrays(ends([min(ids_of, len(x)) for x in best]), inner))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        del kept
        freed()

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in place of any column ``name``; null ids give a null text."""
    plain, back = apart(encoded, ids, own=("_text",))
    at = plain.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else lattice(model).decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "_text"])

    return back(plain.mapInArrow(run, T.StructType([*plain.schema, T.StructField("_text", T.StringType())])), _text=name)
