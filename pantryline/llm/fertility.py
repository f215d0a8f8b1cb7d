"""Quality rules from tokeniser fertility, with rejection bands per language.

Public vocabularies measure each text word by word: characters per token (a SentencePiece vocabulary and a byte-level
one), the share of byte-fallback tokens, and the entropy of the text's token counts. A band per language and length
class is learned from all texts that pass the base rules: the median plus and minus ``width`` robust deviations, taken
from the quartiles and never under a floor. A text outside a band of its class is rejected. Classes with under ``least`` texts
back off, to the language's nearest length class first; no text goes without bands.

Base rules: under 50 words, or over half of the words in repeated windows of three words.

Quartiles are those of the measures to three decimals, counted exactly: they do not depend on how rows are dealt to tasks.

Nulls: a null text has no words and fails the base rules; a null language is a language of its own, and so is an empty one.
Empty and very long texts have measures like any other. Repeated rows are measured alike, and equal measures are judged
alike. Other columns come back as they are, whatever their names; one that is called like an added column gives way to it.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantryline.llm.common import apart, freed, text_batches, written

SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
#: Words, and bytes of them, that a task keeps.
KEPT_WORDS, KEPT_BYTES = 300_000, 24 << 20
LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_pieces", "n_byte_pieces", "n_byte_tokens")
#: Measure: least deviation, so that a class of equal texts doesn't reject its neighbours.
MEASURES = {"chars_per_piece": 0.02, "chars_per_byte_token": 0.02, "byte_share": 0.01, "entropy_rate": 0.02}


@dataclass(frozen=True)
class Vocabularies:
    """Files: a SentencePiece model with byte fallback, and a tiktoken rank table with its pre-tokenizer's pattern."""

    pieces: str
    ranks: str
    pattern: str


@cache
def _encoders(v: Vocabularies):
    import base64

    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=v.pieces)
    with open(v.ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return pieces, tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})


class Words:
    """Numbers for words, and what their tokens are. A task starts anew beyond ``KEPT_WORDS`` or ``KEPT_BYTES``."""

    def __init__(self, v: Vocabularies) -> None:
        self.pieces, self.bytes = _encoders(v)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        """Forgets all words."""
        self.number: dict[bytes, int] = {}
        self.size = 0
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.byte_tokens, self.byte_pieces = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Each text's words by number; new words are encoded."""
        if len(self.number) > KEPT_WORDS or self.size > KEPT_BYTES:
            self.clear()
        known = len(self.number)
        get = self.number.setdefault
        out = [np.fromiter((get(w, len(self.number)) for w in x), np.int64, len(x)) for x in texts]
        if new := [w.decode() for w in islice(self.number, known, None)]:
            self.size += sum(map(len, new))
            ids, encode = self.pieces.encode(new, num_threads=1), self.bytes.encode_ordinary
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
            self.ids = np.concatenate([self.ids, flat])
            self.byte_pieces = np.concatenate([self.byte_pieces, np.add.reduceat(self.is_byte[flat], np.cumsum(sizes) - sizes, dtype=np.int64)])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.byte_tokens = np.concatenate([self.byte_tokens, np.fromiter((len(encode(" " + w)) for w in new), np.int64, len(new))])
        return out


@cache
def _worker_words(v: Vocabularies) -> Words:
    return Words(v)


def repeated_words(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word lies in a three-word window that its text has twice or more. Both lie text by text."""
    out = np.zeros(len(words), bool)
    if len(words) < 3:
        return out
    at = np.flatnonzero(doc[:-2] == doc[2:])
    if not len(at):
        return out
    if words.max() >= 1 << 21:
        _, first = np.unique(words[at] << 32 | words[at + 1], return_inverse=True)
        key = first << 32 | words[at + 2]
    else:
        key = words[at] << 42 | words[at + 1] << 21 | words[at + 2]
    order = np.argsort(key, kind="stable")  # equal keys stay in the order of texts
    same = (key[order][1:] == key[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    for k in range(3):
        out[at[hit] + k] = True
    return out


def _measured(texts: list[bytes], words: Words) -> dict[str, np.ndarray]:
    n = len(texts)
    split = [x.split() for x in texts]
    numbers = words.numbers(split)
    size = np.fromiter(map(len, split), np.int64, n)
    doc = np.repeat(np.arange(n), size)
    w = np.concatenate(numbers) if n else np.zeros(0, np.int64)
    lines = [[y for y in x.split(b"\n") if y.strip()] for x in texts]
    total = lambda v: np.bincount(doc, weights=v, minlength=n).astype(np.int64)
    count = words.start[w + 1] - words.start[w]
    ends = np.cumsum(count)
    piece = words.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(words.start[w] - (ends - count), count)]
    pair, times = np.unique(np.repeat(doc, count) * len(words.is_byte) + piece, return_counts=True)
    pieces = total(count)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.log2(pieces) - np.bincount(pair // len(words.is_byte), weights=times * np.log2(times), minlength=n) / pieces
    return {
        "n_words": size,
        "word_chars": np.fromiter((len(x.translate(None, SPACE).decode()) for x in texts), np.int64, n),
        "n_symbols": np.fromiter((len(x) - len(x.translate(None, SYMBOLS)) for x in texts), np.int64, n),
        "n_dup_lines": np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, n),
        "n_repeat_words": total(repeated_words(w, doc)),
        "n_pieces": pieces,
        "n_byte_pieces": total(words.byte_pieces[w]),
        "n_byte_tokens": total(words.byte_tokens[w]),
        "entropy": np.where(pieces > 0, entropy, 0.0),
    }


def measure(docs: DataFrame, vocabularies: Vocabularies, text: str = "text") -> DataFrame:
    """``docs`` with the base counts (long), n_pieces, n_byte_pieces, n_byte_tokens and entropy (bits) beside its columns."""
    own = (*LONGS, "entropy")
    plain, back = apart(docs, text, own=own)
    schema = T.StructType([*plain.schema, *(T.StructField(x, T.DoubleType() if x == "entropy" else T.LongType()) for x in own)])
    at = plain.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words(vocabularies)
        for batch in text_batches(batches, text, 4 << 20):
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            found = _measured(texts, words)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[x]) for x in own)], names=[*batch.schema.names, *own])
        words.clear()
        freed()

    return back(plain.mapInArrow(run, schema))


def base_failed() -> Column:
    """Too few words, or over half of them repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratios(measured: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return measured.withColumns(
        {
            "chars_per_piece": share("word_chars", "n_pieces"),
            "chars_per_byte_token": share("word_chars", "n_byte_tokens"),
            "byte_share": share("n_byte_pieces", "n_pieces"),
            # against the most that so many tokens of the vocabulary could have
            "entropy_rate": F.coalesce(F.try_divide(F.col("entropy"), F.log2(F.greatest(F.col("n_pieces"), F.lit(1)))), F.lit(0.0)),
            "length_class": F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int"),
        }
    )


def _language(column: str) -> Column:
    """A language's key; null and empty ones have keys of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def bands(measured: DataFrame, language: str = "lang", width: float = 5.0, least: int = 100) -> DataFrame:
    """A row for each language and length class that texts have: (language, length_class, MEASURE_low, MEASURE_high).

    From the texts that pass the base rules: those of the class; without ``least`` of them those of the language's nearest
    length class with as many (the shorter of two), as much wider as it is farther; else of the language over all lengths, if
    it has a tenth of ``least``; else of the nearest length class over all languages; else of all texts. Under ``least``
    texts the spread grows by sqrt(least / texts). Bands are null only if no text passes the base rules.
    """
    names = [f"{x}_{e}" for x in MEASURES for e in ("low", "high")]

    def of(df: DataFrame, *group: str) -> DataFrame:
        # a map of at most some ten thousand values for each group, filled from partial ones
        cols = [F.percentile(F.round(x, 3), [0.25, 0.5, 0.75]).alias(f"_{x}") for x in MEASURES]
        out = df.groupBy(*group).agg(F.count("*").alias("_n"), *cols).filter("_n > 0")
        wider = F.sqrt(F.greatest(least / F.col("_n"), F.lit(1.0)))
        for x, floor in MEASURES.items():
            q = F.col(f"_{x}")
            spread = F.greatest((q[2] - q[0]) / 1.349, F.lit(floor)) * wider
            out = out.withColumns({f"{x}_low": q[1] - width * spread, f"{x}_high": q[1] + width * spread})
        return out.select(*group, "_n", *names)

    fine = _ratios(measured.select(_language(language).alias("_lang"), *LONGS, "entropy"))
    good = fine.filter(~base_failed())
    each = fine.select("_lang", "length_class").distinct()
    steps = F.abs(F.col("length_class") - F.col("_class"))
    wide = lambda x: steps * (F.col(f"{x}_high") - F.col(f"{x}_low")) / 2
    moved = F.struct(*(y for x in MEASURES for y in ((F.col(f"{x}_low") - wide(x)).alias(f"{x}_low"), (F.col(f"{x}_high") + wide(x)).alias(f"{x}_high"))))

    def nearest(name: str, *group: str) -> DataFrame:
        # languages times 40 rows at most
        full = of(good, *group, "length_class").filter(F.col("_n") >= least).withColumnRenamed("length_class", "_class")
        pairs = each.join(full, list(group)) if group else each.select("length_class").distinct().crossJoin(full)
        return pairs.groupBy(*group, "length_class").agg(F.min_by(moved, F.struct(steps, "_class")).alias(name))

    language_wide = of(good, "_lang").filter(10 * F.col("_n") >= least).select("_lang", F.struct(*names).alias("_language"))
    every = of(good).select(F.struct(*names).alias("_every"))
    both = each.join(nearest("_near", "_lang"), ["_lang", "length_class"], "left").join(language_wide, "_lang", "left")
    both = both.join(nearest("_near_all"), "length_class", "left").join(F.broadcast(every), how="left")
    found = F.coalesce("_near", "_language", "_near_all", "_every")
    return both.select("_lang", "length_class", *(found[x].alias(x) for x in names))


JUDGED = (*MEASURES, "base_failed", "kept")


def judge(measured: DataFrame, limits: DataFrame, language: str = "lang") -> DataFrame:
    """``measured`` with its measures, base_failed and kept. ``limits``: of ``bands``; their number, languages times 40 at most, is checked."""
    limits = F.broadcast(limits) if limits.count() <= 100_000 else limits
    plain, back = apart(measured, language, *LONGS, "entropy", own=JUDGED)
    fine = _ratios(plain.withColumn("_lang", _language(language)))
    inside = F.lit(True)
    for x in MEASURES:
        inside = inside & F.coalesce(F.col(x).between(F.col(f"{x}_low"), F.col(f"{x}_high")), F.lit(True))
    out = fine.join(limits, ["_lang", "length_class"], "left").withColumn("base_failed", base_failed())
    return back(out.withColumn("kept", ~F.col("base_failed") & inside))


def quality(docs: DataFrame, vocabularies: Vocabularies, language: str = "lang", width: float = 5.0) -> DataFrame:
    """``docs`` (text, a language column, ...) with all measures, base_failed and kept.

    The measured rows are written once to the shared folder, as the bands are learned from them and then judge them.
    """
    plain, back = apart(docs, "text", language, own=(*LONGS, "entropy", *JUDGED))
    measured = written(measure(plain, vocabularies), "measured")
    return back(judge(measured, written(bands(measured, language, width), "bands"), language))
