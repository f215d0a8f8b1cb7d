"""Runs of periodic words in texts, and the texts with each run cut back to its first period.

A run is a stretch of consecutive words with a smallest period ``q`` (words ``q`` apart are equal) that no neighbouring word
extends. Those are listed that have at least ``least_words`` words and ``repeats`` periods.

Method: Ukkonen's suffix trees of the words and of the words reversed; Euler tours of both, whose least string depth between two
leaves (a sparse table answers in constant time) is the longest common extension of two places, forwards and backwards; the
longest Lyndon word at each place for the order of words and for its reverse, read off the next smaller and the next greater
suffix. Each run has such a Lyndon word for a root, so every one is extended in both directions, and the distinct stretches
of two periods or more are the runs.

Trees are built for the stretches only that a listed run can lie in: within a run, ``GRAM`` words (of ``least_words`` 24 and three
periods; see ``gram``) come again at most a third of the stretch further on, so every place of a run is covered by such repeats. A stretch
has no listed run that is not one of the text, and the other way round: the words before and behind it do not extend its runs.

Memory is linear in the longest such stretch, about 700 bytes a word; texts are taken one by one. Nulls: a null text counts as
empty; it has no run, and nothing is left of it. Texts of any length are taken whole. Equal texts and repeated rows give equal
results. All columns of the caller come back as they are, but for those called like an added one; an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantryline.llm.common import apart, freed

RUN = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))
ADDED = ("n_words", "runs", "collapsed")


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of ``s``, whose last symbol occurs nowhere else: where each node's edge starts and ends, and
    (node << 32 | first symbol): child."""
    n = len(s)
    start, end, link, edge = [0], [0], [0], {}
    node = at = length = pending = 0
    for i, c in enumerate(s):
        pending += 1
        made = 0
        while pending:
            if not length:
                at = i
            key = node << 32 | s[at]
            child = edge.get(key)
            if child is None:
                edge[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if made:
                    link[made] = node
                    made = 0
            else:
                b = start[child]
                size = min(end[child], i + 1) - b
                if length >= size:  # walk down
                    node, at, length = child, at + size, length - size
                    continue
                if s[b + length] == c:
                    if made:
                        link[made] = node
                    length += 1
                    break
                split = len(start)
                start += (b, i)
                end += (b + length, n)
                link += (0, 0)
                edge[key] = split
                edge[split << 32 | c] = split + 1
                edge[split << 32 | s[b + length]] = child
                start[child] = b + length
                if made:
                    link[made] = split
                made = split
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - pending + 1
    return start, end, edge


class Extensions:
    """Longest common extensions of places of a sequence of positive numbers, in constant time, and the order of its suffixes."""

    def __init__(self, s: list[int]) -> None:
        n = len(s) + 1
        start, end, edge = suffix_tree([*s, 0])
        keys = np.sort(np.fromiter(edge, np.int64, len(edge)))  # by parent, then by symbol
        kids = [edge[k] for k in keys.tolist()]
        first_kid = np.searchsorted(keys >> 32, np.arange(len(start) + 1)).tolist()
        tour, first, leaves, depth = [], [0] * n, [], [0] * len(start)
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:  # back in a node after one of its children
                tour.append(depth[~v])
                continue
            d = depth[v]
            low, high = first_kid[v], first_kid[v + 1]
            if low == high:
                first[n - d] = len(tour)
                leaves.append(n - d)
            tour.append(d)
            for k in reversed(kids[low:high]):
                depth[k] = d + end[k] - start[k]
                stack += (~v, k)
        self.first, self.order, self.size = np.array(first), leaves, n - 1
        rows = [np.array(tour, np.int32)]
        while 2 << (len(rows) - 1) <= len(tour):
            half, row = 1 << (len(rows) - 1), rows[-1]
            rows.append(np.minimum(row[:-half], row[half:]))
        self.rows = rows

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and at ``b`` share; ``a`` and ``b`` differ. The end is a place too, of an empty suffix."""
        x, y = self.first[a], self.first[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.log2(high - low + 1).astype(np.int64)
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        return out


def lyndon_roots(order: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the longest Lyndon words at each place, for the order of symbols and for its reverse.

    ``order``: the suffixes in their order, the empty one included. A longest Lyndon word reaches to the next smaller suffix, or in the
    reverse order to the next greater one.
    """
    rank = [0] * (n + 1)
    for r, i in enumerate(order):
        rank[i] = r
    smaller, greater, down, up = [0] * n, [0] * n, [], []
    for i in range(n, -1, -1):
        r = rank[i]
        while down and rank[down[-1]] > r:
            down.pop()
        while up and rank[up[-1]] < r:
            up.pop()
        if i < n:
            smaller[i] = down[-1] - i
            greater[i] = up[-1] - i if up else 0
        down.append(i)
        up.append(i)
    at = np.arange(n)
    both = np.concatenate([smaller, greater]).astype(np.int64)
    there = both > 0
    return np.concatenate([at, at])[there], both[there]


def runs_of(s: list[int]) -> np.ndarray:
    """All runs (start, length, period) of a sequence of positive numbers, of two periods or more, by start and period."""
    n = len(s)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    ahead = Extensions(s)
    place, period = lyndon_roots(ahead.order, n)
    right = ahead.common(place, place + period)
    del ahead
    behind = Extensions(s[::-1])
    left = behind.common(n - place, n - place - period)
    length = left + period + right
    found = np.stack([place - left, length, period], axis=1)[length >= 2 * period]
    return np.unique(found, axis=0)[:, [0, 1, 2]]


def gram(least_words: int, repeats: int) -> int:
    """Words that come again one period on within any listed run: what is left of its least length without a period."""
    return max(1, least_words - least_words // repeats)


def stretches(words: list[bytes], size: int, repeats: int) -> list[tuple[int, int]]:
    """Stretches [from, to) that hold all runs of ``repeats`` periods and more: covered by ``size`` words that come again.

    Words are compared by hashes here; equal words have equal ones, so none is missed.
    """
    if len(words) < size + 1:
        return []
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    code, done = h, 1
    while done < size:
        step = min(done, size - done)  # the two halves may overlap
        a, b = code[: len(code) - step], code[step:]
        code = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        done += step
    at = np.argsort(code, kind="stable")
    same = code[at[1:]] == code[at[:-1]]
    here, there = at[:-1][same], at[1:][same]  # a place and the next with the same words
    out, left = [], [(0, len(words))]
    while left:
        low, high = left.pop()
        inside = (here >= low) & (there + size <= high) & ((there - here) * repeats <= high - low)
        a, b = here[inside], there[inside] + size
        if not len(a):
            continue
        edge = np.zeros(high - low + 1, np.int64)
        np.add.at(edge, a - low, 1)
        np.add.at(edge, b - low, -1)
        covered = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
        turns = np.flatnonzero(np.diff(covered)).reshape(-1, 2) + low
        for x, y in turns.tolist():
            (out if (x, y) == (low, high) else left).append((x, y))
    return sorted(out)


def text_runs(words: list[bytes], least_words: int, repeats: int) -> list[tuple[int, int, int]]:
    """The listed runs of a text, by start and period."""
    out = []
    for low, high in stretches(words, gram(least_words, repeats), repeats):
        number = {}
        found = runs_of([number.setdefault(w, len(number) + 1) for w in words[low:high]])
        found = found[(found[:, 1] >= least_words) & (found[:, 1] >= repeats * found[:, 2])]
        out += [(low + s, n, q) for s, n, q in found.tolist()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(df: DataFrame, text: str = "text", least_words: int = 24, repeats: int = 3) -> DataFrame:
    """``df`` with n_words, runs (an array of start, length and period, by start and period; words count from 0) and collapsed,
    the kept words joined by single spaces.

    ``repeats``: 2 or more. Spark deals the rows; a task takes a text at a time.
    """
    if repeats < 2 or least_words < 2:
        raise ValueError("a run has at least two periods")
    plain, back = apart(df, text, own=ADDED)
    schema = T.StructType([*plain.schema, T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        for batch in batches:
            sizes, every, left = [], [], []
            for x in batch.column(batch.schema.get_field_index(text)):
                words = (x.as_py() or "").encode().split()  # bytes.split takes ASCII white space alone
                found = text_runs(words, least_words, repeats)
                sizes.append(len(words))
                every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                left.append(b" ".join(collapsed(words, found)).decode())
            new = [pa.array(sizes, pa.int64()), pa.array(every, run_type), pa.array(left, batch.schema.field(text).type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *ADDED])
        freed()

    return back(plain.withColumn(text, F.col(text).cast("string")).mapInArrow(run, schema))
