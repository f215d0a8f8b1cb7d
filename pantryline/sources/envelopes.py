"""Large JSON envelopes of places (SRC1), read by many tasks: a file is cut into byte ranges.

Whether a range begins within a text, and within which lists and objects, is not known from its bytes. So there are two passes. In the
first a task says of its range, for both cases (begins within a text or not), how it ends: within a text or not, how many brackets it
closes that were open before, and which it leaves open, with their names. One task a file puts these together in order, a short
row a range. In the second pass a task knows how its range begins, finds the records that begin in it, and reads on behind its end
until the last of them is whole. Records go to Spark as JSON texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pantryline.sources.places import PLACE_JSON
from pantryline.sources.shared import written

TOKEN = re.compile(rb'"(?:[^"\\]+|\\.)*+"|[{}\[\]]|"', re.S)
QUOTE = re.compile(rb'(?:[^"\\]|\\.)*?"', re.S)
NAME = re.compile(rb'"([^"\\]{1,64})"\s*:\s*\Z')
#: Bytes before a bracket that its name is looked for in, and bytes read at once behind a range.
BACK, AHEAD = 256, 1 << 20
#: Where records lie, the first that a file has: the brackets open round them, each with its name.
HOMES = ["[", "{ [restaurants", "{ [all_restaurants", "{ [merged_restaurants", "{ {summary [restaurants"]


def _open(path: str) -> pa.NativeFile:
    uri = path if "://" in path else path.replace("file:/", "file:///", 1)
    store, name = fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)
    return store.open_input_file(name)


def _read(path: str, start: int, end: int) -> tuple[bytes, int]:
    """(bytes from up to ``BACK`` before ``start`` on, place of ``start`` in them); a range never begins behind a backslash."""
    low = max(0, start - BACK)
    with _open(path) as f:
        f.seek(low)
        data = f.read(end - low)
    return data, start - low


def _name(data: bytes, at: int) -> str:
    found = NAME.search(data, max(0, at - BACK), at)
    return found[1].decode("utf-8", "replace") if found else ""


def _escaped(data: bytes, at: int) -> int:
    """``at``, moved on if the byte there is escaped by one before."""
    n = 0
    while n < at and data[at - 1 - n : at - n] == b"\\":
        n += 1
    return at + n % 2


def summary(data: bytes, at: int, inside: bool) -> tuple[bool, int, list[str]]:
    """(whether it ends within a text, brackets closed that were open before, those left open) of a range that begins at ``at``."""
    if inside:
        first = QUOTE.match(data, _escaped(data, at))
        if not first:
            return True, 0, []
        at = first.end()
    closed, stack = 0, []
    for m in TOKEN.finditer(data, at):
        c = m[0]
        if c in b"{[":
            stack.append(m.start())
        elif c == b'"':  # no end within the range
            return True, closed, [data[p : p + 1].decode() + _name(data, p) for p in stack]
        elif c in b"}]":
            if stack:
                stack.pop()
            else:
                closed += 1
    return False, closed, [data[p : p + 1].decode() + _name(data, p) for p in stack]


def records(path: str, start: int, end: int, inside: bool, stack: list[str]) -> Iterator[tuple[int, str]]:
    """(number of the home, text) of the records that begin in a range, in their order."""
    data, at = _read(path, start, end)
    last, stack, begun, home = at + end - start, list(stack), None, None
    if inside:
        first = QUOTE.match(data, _escaped(data, at))
        if not first:
            return
        at = first.end()
    homes = {x: i for i, x in enumerate(HOMES)}
    with _open(path) as f:
        f.seek(end)
        while True:
            again = False
            for m in TOKEN.finditer(data, at):
                c = m[0]
                if m.start() >= last and begun is None:
                    return
                if c == b'"':
                    at, again = m.start(), True  # the text goes on behind what is read
                    break
                at = m.end()
                if c in b"{[":
                    if c == b"{" and begun is None and len(stack) <= 3 and " ".join(stack) in homes:
                        begun, home = (m.start(), len(stack)), homes[" ".join(stack)]
                    stack.append(c.decode() + (_name(data, m.start()) if len(stack) < 4 else ""))
                elif c in b"}]":
                    if stack:
                        stack.pop()
                    if begun is not None and len(stack) == begun[1]:
                        yield home, data[begun[0] : m.end()].decode("utf-8", "replace")
                        begun = None
            if begun is None and not again:
                return
            if begun is None and at >= last:
                return
            more = f.read(AHEAD)
            if not more:
                return
            data += more


def read_large_places_json(spark: SparkSession, path: str, record: str = PLACE_JSON, range_bytes: int = 64 << 20) -> DataFrame:
    """SRC1. As ``places.read_places_json``, for files of any size: (source_pos, the record's fields), and ``path``.

    A file's records are those of the first home that it has any in. Elements that are not objects have no row and no place in the
    count. A record is held whole by one task; names of lists are looked for in the ``BACK`` bytes before them.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / range_bytes) - 1, F.lit(0)))
    ranges = files.withColumn("k", F.explode(cuts)).select("path", "k", (F.col("k") * range_bytes).alias("start"), F.least((F.col("k") + 1) * range_bytes, F.col("length")).alias("end"))
    ranges = ranges.repartition("path", "k")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                data, at = _read(r.path, r.start, r.end)
                both = [summary(data, at, x) for x in (False, True)]
                out.append((r.path, r.k, r.start, r.end, [x[0] for x in both], [x[1] for x in both], both[0][2], both[1][2]))
            yield pd.DataFrame(out, columns=["path", "k", "start", "end", "inside", "closed", "open0", "open1"])

    schema = "path string, k long, start long, end long, inside array<boolean>, closed array<int>, open0 array<string>, open1 array<string>"
    told = ranges.mapInPandas(summed, schema)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        inside, stack, out = False, [], []
        for r in pdf.sort_values("k").itertuples(index=False):
            out.append((r.path, r.k, r.start, r.end, inside, list(stack)))
            case = int(inside)
            stack = [*stack[: max(0, len(stack) - int(r.closed[case]))], *(r.open1 if case else r.open0)]
            inside = bool(r.inside[case])
        return pd.DataFrame(out, columns=["path", "k", "start", "end", "inside", "stack"])

    begun = written(told.groupBy("path").applyInPandas(joined, "path string, k long, start long, end long, inside boolean, stack array<string>"), "json-ranges")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, held, size = {}, [], 0
                for home, text in records(r["path"], r["start"], r["end"], r["inside"], r["stack"]):
                    held.append((r["path"], home, r["k"], n.get(home, 0), text))
                    n[home], size = n.get(home, 0) + 1, size + len(text)
                    if size > 4 << 20:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        cols = zip(*held, strict=True)
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["path", "home", "k", "i", "text"])

    found = written(begun.repartition("path", "k").mapInArrow(parsed, "path string, home int, k long, i long, text string"), "json-records")
    counts = found.groupBy("path", "home", "k").agg(F.count("*").alias("n"))  # a row a range
    first = counts.withColumn("before", F.sum("n").over(Window.partitionBy("path", "home").orderBy("k")) - F.col("n"))
    first = first.withColumn("_r", F.rank().over(Window.partitionBy("path").orderBy("home"))).filter("_r = 1").select("path", "home", "k", "before")
    out = found.join(first, ["path", "home", "k"]).select((F.col("before") + F.col("i")).alias("source_pos"), F.from_json("text", record).alias("p"), "path")
    return out.select("source_pos", "p.*", "path")
