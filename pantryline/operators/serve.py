"""The star schema as views, and the searches over them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantryline.functions import text
from pantryline.sources.shared import new_path, written


def eq_filters(df: DataFrame, **given: object) -> DataFrame:
    """F1, F2, F3. Rows that equal all given values; a None is no condition."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in given.items() if v is not None), df)


def search_text(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """F4. Rows with the term, in any case, in one of the columns."""
    return df.filter(reduce(Column.__or__, (F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns)))


def exclude_labels(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """F5. Rows with none of the labels; a null list has none."""
    return df.filter(~F.arrays_overlap(F.coalesce(column, F.array().cast("array<string>")), text.strings(labels)))


def require_labels(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """F6. Rows with all of the labels."""
    return df.filter(F.size(F.array_except(text.strings(labels), F.coalesce(column, F.array().cast("array<string>")))) == 0)


def items_with_details(items: DataFrame, links: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """A2, J6. Items with the sorted distinct labels of each (links, label column); an empty list without any.

    Links are aggregated before they are joined, so several kinds do not multiply.
    """
    for df, label in links:
        grouped = df.filter(F.col(label).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(label)).alias(f"{label}s"))
        items = items.join(grouped, key, "left").withColumn(f"{label}s", F.coalesce(f"{label}s", F.array().cast("array<string>")))
    return items


def place_summary(places: DataFrame, items: DataFrame, key: str, updated: str) -> DataFrame:
    """A1. Each place with its number of items and the last update of any."""
    n = items.groupBy(key).agg(F.count("*").alias("n_items"), F.max(updated).alias("last_update"))
    return places.join(n, key, "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def place_stats(places: DataFrame, items: DataFrame, links: DataFrame, key: str, item: list[str], price: str, label: str) -> DataFrame:
    """A3. Of each place: items, items with any label, distinct labels, mean, least and most price, and items by label.

    Labels are counted from distinct (item, label) pairs, so an item with several counts once in all but the breakdown.
    """
    pairs = links.filter(F.col(label).isNotNull()).select(key, *item, label).distinct()
    by_item = pairs.select(key, *item).distinct().withColumn("_labelled", F.lit(1))
    base = items.join(by_item, [key, *item], "left").groupBy(key).agg(F.count("*").alias("n_items"), F.count("_labelled").alias("n_labelled"), F.avg(price).alias("avg_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"))
    counts = pairs.groupBy(key, label).agg(F.count("*").alias("n"))
    split = counts.groupBy(key).agg(F.count("*").alias("n_labels"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias("breakdown"))
    out = places.select(key).join(base, key, "left").join(split, key, "left")
    return out.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_items", "n_labelled", "n_labels")})


def dim_lookup(df: DataFrame, names: str, dim: DataFrame, dim_name: str, dim_id: str, key: str) -> DataFrame:
    """J7. (key, dim id) of each name in the lists of ``df`` that the dimension has. The dimension is a seed table of ten rows or so."""
    each = df.select(key, F.explode(names).alias(dim_name)).distinct()
    return each.join(dim.select(dim_name, dim_id), dim_name).select(key, dim_id)


def box_lookup(points: DataFrame, boxes: DataFrame, step: float = 0.25) -> DataFrame:
    """J9. Each point (lat, lon, ...) with the columns of each box (south, west, north, east, ...) that holds it, north and east excluded.

    Boxes are cut into cells of ``step`` degrees and met by cell, so neither side is compared with all of the other.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))
    cut = boxes.withColumn("_x", F.explode(cells("south", "north"))).withColumn("_y", F.explode(cells("west", "east")))
    inside = (F.col("lat") >= F.col("south")) & (F.col("lat") < F.col("north")) & (F.col("lon") >= F.col("west")) & (F.col("lon") < F.col("east"))
    return points.withColumns({"_x": F.floor(F.col("lat") / step), "_y": F.floor(F.col("lon") / step)}).join(cut, ["_x", "_y"]).filter(inside).drop("_x", "_y")


def enrich(base: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """J8. Rows with their details; a detail that is given wins."""
    d = detail.withColumnsRenamed({c: f"_d_{c}" for c in detail.columns if c != key})
    out = base.join(d, key, "left")
    shared = [c for c in base.columns if c != key and c in detail.columns]
    new = [c for c in detail.columns if c not in base.columns]
    picked = {c: F.coalesce(f"_d_{c}", c) for c in shared} | {c: F.col(f"_d_{c}") for c in new}
    return out.withColumns(picked).select(*base.columns, *new)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, contact: list[str], other: list[str], count: str) -> DataFrame:
    """J10. (key, change_type, field, old_value, new_value) between two snapshots.

    change_type: new, removed, menu_changed (``count`` differs) or updated (a ``contact`` or ``other`` field differs; null
    equals null).
    """
    fields = [*contact, *other, count]
    o = old.select(key, F.lit(True).alias("_old"), *(F.col(c).cast("string").alias(f"o_{c}") for c in fields))
    n = new.select(key, F.lit(True).alias("_new"), *(F.col(c).cast("string").alias(f"n_{c}") for c in fields))
    none = F.lit(None).cast("string")

    def row(kind: str, field: Column, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("change_type"), field.alias("field"), a.alias("old_value"), b.alias("new_value"))

    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    cases = [F.when(F.col("_old").isNull(), row("new", none, none, none)), F.when(F.col("_new").isNull(), row("removed", none, none, none))]
    cases += [F.when(both & ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), row("menu_changed" if c == count else "updated", F.lit(c), F.col(f"o_{c}"), F.col(f"n_{c}"))) for c in fields]
    joined = o.join(n, key, "full_outer")
    return joined.select(key, F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("c")).select(key, "c.*")


def dictionary_tags(df: DataFrame, key: str, words: str, dictionary: DataFrame) -> DataFrame:
    """J11. (key, label, weight): of each label the largest weight among its keywords that are words of the row.

    ``dictionary``: (keyword, label, weight).
    """
    each = df.select(key, F.explode(F.array_distinct(words)).alias("keyword"))
    return each.join(dictionary, "keyword").groupBy(key, "label").agg(F.max("weight").alias("weight"))


#: Phrases whose hashes a task holds at once: 16 bytes each, a number and their length.
PHRASES_IN_TASK = 1_000_000
#: Words that a step of the search takes at once.
WORDS_AT_ONCE = 1_000_000
#: Rows of overlapping matches that are gone through one by one, not a step of all at once.
FEW = 64
HASHED = "n int, h1 long, h2 long, id long"
HASHES = pa.schema([("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64())])


def _word_hashes(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word among the different ones, and of each of these two 64-bit hashes; a null is like no word."""
    coded = flat.dictionary_encode(null_encoding="encode")
    each = b"".join(b"\xff" * 16 if w is None else hashlib.blake2b(w.encode(), digest_size=16).digest() for w in coded.dictionary.to_numpy(zero_copy_only=False))
    return coded.indices.to_numpy(), np.ascontiguousarray(np.frombuffer(each, "<u8").reshape(-1, 2).T)


def _gram_hashes(words: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """The hash of the ``n`` words from each place on (or each of ``at``), out of the hashes of the words."""
    size = len(words) - n + 1
    out = np.full(size if at is None else len(at), n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (words[i : i + size] if at is None else words[at + i])
    return out


def _hash_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = np.asarray(batch.column(0).value_lengths())
        codes, hashes = _word_hashes(batch.column(0).flatten())
        words, begin = hashes[:, codes], np.cumsum(lengths) - lengths
        h = np.zeros((2, len(lengths)), np.uint64)
        for n in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == n)
            for i in (0, 1):
                h[i, of] = _gram_hashes(words[i], n, begin[of])
        yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), *(pa.array(x.view(np.int64)) for x in h), batch.column(1)], names=["n", "h1", "h2", "id"])


class PhraseBlocks:
    """The hashes of phrases (their words ``w``, ``id``) in the shared folder, in blocks of some ``in_task``; a task holds one block at a time."""

    def __init__(self, phrases: DataFrame, in_task: int) -> None:
        spark, path = phrases.sparkSession, new_path(phrases.sparkSession, "phrases")
        phrases.select("w", "id").mapInArrow(_hash_phrases, HASHED).write.parquet(path)
        hashed = spark.read.schema(HASHED).parquet(path)
        n = max(1, -(-hashed.count() // in_task))
        self.folders, self.held = [path], (None, {})
        if n > 1:
            path = new_path(spark, "phrase-blocks")
            hashed.withColumn("block", F.pmod("h1", F.lit(n))).repartition(n, "block").sortWithinPartitions("block", "h1").write.partitionBy("block").parquet(path)
            self.folders = [f"{path}/block={i}" for i in range(n)]

    def block(self, i: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]]:
        """By number of words, most first: both hashes and the ids in the order of the first hash, and which values its upper bits have."""
        if self.held[0] != i:
            self.held = (None, {})
            store, folder = fs.FileSystem.from_uri(self.folders[i])
            tables = [HASHES.empty_table()]
            for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if x.is_file and x.base_name.startswith("part-"):
                    with store.open_input_file(x.path) as f:
                        tables.append(pq.ParquetFile(f).read(columns=HASHES.names, use_threads=False).cast(HASHES))
            n, h1, h2, ids = (c.to_numpy() for c in pa.concat_tables(tables).columns)
            found = {}
            for k in sorted(np.unique(n).tolist(), reverse=True):
                of = np.flatnonzero(n == k)
                of = of[np.argsort(h1[of].view(np.uint64), kind="stable")]
                first, bits = h1[of].view(np.uint64), min(24, (16 * len(of)).bit_length())
                there, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
                there[first >> shift] = True
                found[k] = (first, h2[of].view(np.uint64), ids[of], there, shift)
            self.held = (i, found)
        return self.held[1]

    def longest(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word of some rows: its row, the number of words of the longest phrase that begins there (0: none), and that phrase's id."""
        lengths = np.asarray(words.value_lengths().fill_null(0))
        codes, hashes = _word_hashes(words.flatten())
        each, row, ends = hashes[:, codes], np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths)
        best, ids = np.zeros(len(codes), np.int32), np.zeros(len(codes), np.int64)
        for i in range(len(self.folders)):
            for n, (first, second, numbers, there, shift) in self.block(i).items():
                if n > len(codes):
                    continue
                side = hashes if n == 1 else each  # a single word is sought once, however often it comes
                grams = _gram_hashes(side[0], n)
                at = np.flatnonzero(there[grams >> shift])
                if n > 1:
                    at = at[(ends[row[at]] - at >= n) & (best[at] < n)]
                known = np.minimum(np.searchsorted(first, grams[at]), len(first) - 1)
                same = (first[known] == grams[at]) & (second[known] == _gram_hashes(side[1], n, at))
                at, known = at[same], known[same]
                if n == 1:
                    number = np.full(hashes.shape[1], -1)
                    number[at] = known
                    at = np.flatnonzero((number[codes] >= 0) & (best == 0))
                    known = number[codes[at]]
                best[at], ids[at] = n, numbers[known]
        return row, best, ids


def _leftmost(places: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which matches (ascending first places, numbers of words) stay, if of those that overlap the leftmost does."""
    ends = places + n
    begins = np.ones(len(places), bool)  # what no match before it reaches stays anyway
    begins[1:] = np.maximum.accumulate(ends)[:-1] <= places[1:]
    following, kept = np.append(np.searchsorted(places, ends), len(places)), begins.copy()
    begins = np.append(begins, True)
    at = np.flatnonzero(begins[:-1] & (n > 1))
    while len(at) > FEW:
        at = following[at]
        at = at[~begins[at]]
        kept[at] = True
    for i in at.tolist():
        while not begins[i := int(following[i])]:
            kept[i] = True
    return kept


def _search(df: DataFrame, key: str, words: str, blocks: PhraseBlocks, rest: str, found: Callable[..., list[pa.Array]]) -> DataFrame:
    """(key, columns ``rest``) of the phrases in each row. ``found``: of some rows' words, and the matches' rows, places, numbers of words and
    ids, the rows again and the columns."""
    rows = df.select(key, F.col(words).alias("_words"))
    out = T.StructType([rows.schema.fields[0], *T.StructType.fromDDL(rest).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(np.asarray(whole.column(1).value_lengths().fill_null(0)))
            begin = 0
            while begin < len(sizes):
                done = int(sizes[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(sizes, done + WORDS_AT_ONCE, "right")))
                batch = whole.slice(begin, stop - begin)
                begin = stop
                row, best, ids = blocks.longest(batch.column(1))
                places = np.flatnonzero(best)
                places = places[_leftmost(places, best[places])]
                if len(places):
                    owner, *columns = found(batch.column(1), row[places], places, best[places], ids[places])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *columns], names=out.names)

    return rows.mapInArrow(run, out)


def _unique(columns: dict[str, np.ndarray | pa.Array], least: str | None = None) -> list[pa.Array]:
    """The different rows of some columns; ``least``: of this one the least value is taken."""
    grouped = pa.table(columns).group_by([c for c in columns if c != least], use_threads=False).aggregate([(least, "min")] if least else [])
    return [grouped.column(f"{c}_min" if c == least else c).combine_chunks() for c in columns]


def phrase_matches(df: DataFrame, key: str, words: str, phrases: DataFrame, once: bool = False, in_task: int = PHRASES_IN_TASK) -> DataFrame:
    """J11. (key, pos, n, phrase): where the phrases of a table lie in the word lists of ``df``; of those that overlap the leftmost stays,
    and of those that begin at one word the longest. ``once``: each phrase but once a row (its first place).

    ``phrases``: (phrase), single spaces between words. Phrases are told apart by 128-bit hashes, made by Spark and read from the shared folder;
    a task goes over its rows' words at each length that phrases have. So words are neither moved nor multiplied. More than ``in_task`` phrases
    are blocks, which a task reads one after the other for the same words.
    """

    def found(lists: pa.ListArray, row: np.ndarray, places: np.ndarray, n: np.ndarray, _: np.ndarray) -> list[pa.Array]:
        flat, lengths = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0))
        of = {k: np.flatnonzero(n == k) for k in np.unique(n).tolist()}
        phrase = pa.concat_arrays([pc.binary_join_element_wise(*(flat.take(pa.array(places[at] + i)) for i in range(k)), " ") for k, at in of.items()])
        at = np.concatenate(list(of.values()))
        pos = places - (np.cumsum(lengths) - lengths)[row]
        columns = {"row": row[at], "pos": pos[at].astype(np.int32), "n": n[at], "phrase": phrase}
        return _unique(columns, "pos") if once else list(pa.table(columns).combine_chunks().to_batches()[0].columns)

    each = phrases.filter("phrase != ''").select(F.split("phrase", " ").alias("w")).distinct().withColumn("id", F.lit(0).cast("long"))
    return _search(df, key, words, PhraseBlocks(each, in_task), "pos int, n int, phrase string", found)


def dictionary_phrases(df: DataFrame, key: str, words: str, dictionary: DataFrame, in_task: int = PHRASES_IN_TASK) -> DataFrame:
    """J11. (key, label, weight): of each label the largest weight among its phrases that ``phrase_matches`` finds in the row.

    ``dictionary``: (phrase, label, weight); a phrase may have several labels. Phrases of the same labels and weights are one kind, and a row of
    ``df`` leaves a task once for each kind that is found in it, not for each phrase.
    """

    def found(_: pa.ListArray, row: np.ndarray, __: np.ndarray, ___: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        return _unique({"row": row, "_kind": ids})

    labelled = written(dictionary.filter("phrase != ''").groupBy("phrase").agg(F.sort_array(F.collect_set(F.struct("label", "weight"))).alias("_labels")), "labelled")
    kinds = written(labelled.select("_labels").distinct().withColumn("_kind", F.monotonically_increasing_id()), "kinds")
    each = labelled.join(kinds, "_labels").select(F.split("phrase", " ").alias("w"), F.col("_kind").alias("id"))
    of_rows = _search(df, key, words, PhraseBlocks(each, in_task), "_kind long", found)
    return of_rows.join(kinds.select("_kind", F.inline("_labels")), "_kind").groupBy(key, "label").agg(F.max("weight").alias("weight"))
