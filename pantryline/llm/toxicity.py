"""Toxicity: a counterfactual-regularised classifier.

Features are a text's lower-cased words and the first 3 to 7 characters of longer ones: one feature if a text has it, and
another if it has it twice or more and in at least one of 128 words, as a slur's stem in an inflected language has. Of a
bounded sample of labelled rows (``most`` per label, those whose ids hash lowest), each text with identity terms is
copied with each term swapped for another of its kind, and the squared change of the logit is penalised beside the
logistic loss, so the terms' own weights meet: a group's mere mention moves no score. The intercept is set to the labels'
frequencies.

Sample, features (``vocabulary`` at most) and weights are bounded whatever the input's size; scoring passes over all texts
without a shuffle, with the weights in the closure.

Nulls: a null text counts as empty and gets the score of the intercept, as an empty one does; a long text is scored whole.
Rows with a null label or id teach nothing; of repeated labels for one id the largest counts, and of repeated texts for one id
the first by their features. Without rows of both labels every score is the share of label 1 (0.5 without any). Equal texts
score alike. Other columns come back as they are, whatever their names; one that is called like the score gives way to it. An
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantryline.llm.common import apart, freed, text_batches

#: Kinds of identity terms; within a kind each can stand for another. Replace or extend for other languages.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "arab", "european"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual"),
    ("women", "men"),
    ("woman", "man"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("muslime", "christen", "juden"),
    ("frauen", "männer"),
    ("musulmans", "chrétiens", "juifs"),
    ("femmes", "hommes"),
    ("musulmanes", "cristianos", "judíos"),
    ("mujeres", "hombres"),
)
TOKEN = re.compile(r"\w+")


#: A feature is dense in a text that has it twice or more and in one of so many words at least.
DENSE, SPACE = 128, 1 << 24
#: Words, and characters of them, that a task keeps.
KEPT_WORDS, KEPT_BYTES = 200_000, 16 << 20


def stems(word: str) -> tuple[str, ...]:
    """A word and its beginnings."""
    return (word, *(f"^{word[:n]}" for n in range(3, 8) if len(word) > n))


def number(stem: str, dense: bool = False) -> int:
    """A feature's number, of 24 bits: so the counts of all features fit an array."""
    return zlib.crc32(f"{stem}+".encode() if dense else stem.encode()) % SPACE


def features(words: Counter[str]) -> set[int]:
    """Numbers of a text's features, from its words' counts."""
    counts: Counter[str] = Counter()
    for w, c in words.items():
        for x in stems(w):
            counts[x] += c
    n = words.total()
    return {number(x) for x in counts} | {number(x, True) for x, c in counts.items() if c > 1 and c * DENSE >= n}


def swapped(words: Counter[str], kinds: tuple[tuple[str, ...], ...] = IDENTITY) -> list[Counter[str]]:
    """Word counts with the identity terms of every kind moved on by one, by two, ... to all others of their kind."""
    present = [kind for kind in kinds if any(w in words for w in kind)]
    out = []
    for step in range(1, max(map(len, present), default=1)):
        to = {w: kind[(i + step) % len(kind)] for kind in present for i, w in enumerate(kind)}
        new: Counter[str] = Counter()
        for w, c in words.items():
            new[to.get(w, w)] += c
        if new != words and new not in out:
            out.append(new)
    return out


@dataclass(frozen=True)
class Model:
    """Weights by feature number, and the intercept."""

    weights: dict[int, float]
    intercept: float

    def logit(self, words: Counter[str], known: dict[str, tuple]) -> float:
        """Of a text's word counts. ``known``: numbers of a word's stems that weigh anything, filled on the way."""
        weights, counts = self.weights, {}
        for w, c in words.items():
            mine = known.get(w)
            if mine is None:
                pairs = ((number(x), number(x, True)) for x in stems(w))
                known[w] = mine = tuple(x for x in pairs if x[0] in weights or x[1] in weights)
            for x in mine:
                counts[x] = counts.get(x, 0) + c
        z, n = self.intercept, words.total()
        for (once, dense), c in counts.items():
            z += weights.get(once, 0.0)
            if c > 1 and c * DENSE >= n:
                z += weights.get(dense, 0.0)
        return z


def fit(x: list[np.ndarray], y: np.ndarray, changed: list[tuple[int, np.ndarray]], share: float, must: set[int], vocabulary: int = 4096, penalty: float = 1.0, ridge: float = 1e-4, steps: int = 300) -> Model:
    """Weights from feature arrays ``x``, labels ``y`` and ``changed`` (row, features after a swap).

    ``share``: of label 1 among all labels. ``must``: features of identity terms, which are kept whatever they tell.
    """
    if not len(y) or y.min() == y.max():
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, float(np.log(share / (1 - share))))
    n, n1 = len(y), int(y.sum())
    df, df1 = np.zeros(SPACE, np.int32), np.zeros(SPACE, np.int32)
    for v, label in zip(x, y, strict=True):  # a text has a feature once
        df[v] += 1
        if label:
            df1[v] += 1
    names = np.flatnonzero(df >= 5)
    a = df1[names].astype(float)
    b, c = df[names] - a, n1 - a
    d = n - n1 - b
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n1 * (n - n1), 1)
    good = np.flatnonzero(chi > 25)
    best = good[np.argsort(-chi[good], kind="stable")[:vocabulary]]
    chosen = np.union1d(names[best], np.array(sorted(must), names.dtype))
    k = len(chosen)
    slot = df  # no longer needed
    slot[:] = -1
    slot[chosen] = np.arange(k)

    def placed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        mine = [i[i >= 0] for i in (slot[v] for v in parts)]
        return np.repeat(np.arange(len(parts)), [len(i) for i in mine]), np.concatenate(mine) if mine else np.zeros(0, np.int32)

    r, f = placed(x)
    cr, cf = placed([v for _, v in changed])
    base = np.array([i for i, _ in changed], np.int64)
    w, bias = np.zeros(k), float(np.log(n1 / (n - n1)))
    m, v, t = np.zeros(k + 1), np.zeros(k + 1), 0
    for t in range(1, steps + 1):
        z = np.bincount(r, weights=w[f], minlength=n)
        err = (1 / (1 + np.exp(-np.clip(z + bias, -30, 30))) - y) / n
        if len(base):
            diff = 2 * penalty * (z[base] - np.bincount(cr, weights=w[cf], minlength=len(base))) / len(base)
            pull = err + np.bincount(base, weights=diff, minlength=n)
            g = np.bincount(f, weights=pull[r], minlength=k) - np.bincount(cf, weights=diff[cr], minlength=k)
        else:
            g = np.bincount(f, weights=err[r], minlength=k)
        g = np.append(g + ridge * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    bias += np.log(share / (1 - share)) - np.log(n1 / (n - n1))
    return Model({int(i): float(z) for i, z in zip(chosen, w, strict=True) if z}, float(bias))


def train(docs: DataFrame, labels: DataFrame, usable: Column, target: str = "toxic", most: int = 5_000, vocabulary: int = 4096, penalty: float = 1.0, kinds: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, target) where ``usable`` holds.

    At most ``most`` rows of each label are read, those whose ids hash lowest, so at most twice as many reach one task.
    """
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    # ids whose hash lies under a bound, and then the lowest of them exactly
    parts = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])  # 16 bytes a row, twice ``most`` rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(sample), "doc_id").select("doc_id", "_y", "_text")
    schema = T.StructType([T.StructField("doc_id", texts.schema[0].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType()), T.StructField("swaps", T.ArrayType(T.BinaryType()))])
    pack = lambda s: np.array(sorted(features(s)), np.uint32).tobytes()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "_text", 4 << 20):
            sets = [Counter(TOKEN.findall(s.lower())) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(pack, sets), pa.binary()), pa.array([[pack(s) for s in swapped(x, kinds)] for x in sets], pa.list_(pa.binary()))], names=schema.names)

    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    must = {i for kind in kinds for w in kind for x in stems(w) for i in (number(x), number(x, True))}

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "x"], kind="stable").drop_duplicates("doc_id")
        x = [np.frombuffer(b, np.uint32) for b in pdf["x"]]
        changed = [(i, np.frombuffer(b, np.uint32)) for i, s in enumerate(pdf["swaps"]) for b in s]
        model = fit(x, pdf["y"].to_numpy(), changed, share, must, vocabulary, penalty)
        del x, changed
        freed()
        return pd.DataFrame({"f": [*model.weights, -1], "w": [*model.weights.values(), model.intercept]})

    rows = texts.mapInArrow(extract, schema).groupBy().applyInPandas(learn, "f long, w double").collect()
    weights = {r["f"]: r["w"] for r in rows}
    if not weights:
        return fit([], np.zeros(0), [], share, must)
    intercept = weights.pop(-1)
    return Model(weights, intercept)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name`` from 0 to 1."""
    plain, back = apart(docs, text, own=("_score",))
    at = plain.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in text_batches(batches, text, 4 << 20):
            z = np.array([model.logit(Counter(TOKEN.findall((s or "").lower())), known) for s in batch.column(at).to_pylist()])
            if len(known) > KEPT_WORDS or sum(map(len, known)) > KEPT_BYTES:
                known.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*batch.schema.names, "_score"])
        known.clear()
        freed()

    return back(plain.mapInArrow(run, T.StructType([*plain.schema, T.StructField("_score", T.DoubleType())])), _score=name)
