"""What several operators of this folder share: words, folds, Arrow batches, and column names that don't clash."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantryline.sources.shared import new_path, shared_dir, written

__all__ = ["WORD", "apart", "fold", "freed", "lower_ascii", "new_path", "shared_dir", "text_batches", "text_bytes", "trimmed", "whole_number", "written"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def apart(df: DataFrame, *needed: str, own: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with the ``needed`` columns under their names and all others as ``_c0``, ``_c1``, ... by place, and the way back.

    So no name that an operator uses inside can clash with a caller's column, whatever that is called and in whatever
    case. The way back takes the result and gives the caller's columns in their order, then the columns ``own`` that the
    operator adds, under the names given (``back(out, score="points")`` calls the column ``score`` ``points``). A caller's
    column with the name of an added one gives way to it.
    """
    names = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    at = {names[x]: x for x in needed}
    plain = df.toDF(*(at.get(i, f"_c{i}") for i in range(len(df.columns))))
    inner, outer = plain.columns, df.columns

    def back(out: DataFrame, **renamed: str) -> DataFrame:
        added = {x: renamed.get(x, x) for x in own}
        taken = {x.lower() for x in added.values()}
        mine = [F.col(i).alias(o) for i, o in zip(inner, outer, strict=True) if o.lower() not in taken and i in out.columns]
        return out.select(*mine, *(F.col(x).alias(y) for x, y in added.items()))

    return plain, back


def whole_number(kind: T.DataType) -> bool:
    """Whether values are integers that a long holds."""
    return isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows (one number reaches the driver)."""
    return df.select(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0


def text_batches(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or one row if that is longer."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        size, start = 0, 0
        for i, x in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
            if size and size + (x or 0) > most:
                yield batch.slice(start, i - start)
                size, start = 0, i
            size += x or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def freed() -> None:
    """Gives back memory that a task held: the worker goes on to tasks of other kinds."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def trimmed() -> None:
    """As ``freed``, and what the C library keeps of freed arrays goes back too, where it can (glibc)."""
    freed()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
