"""A change feed over snapshots: state keeps each place's last fields, and what differs is emitted."""

from __future__ import annotations

import heapq
import itertools
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState

from pantryline.sources.store import upsert_by_key

CHANGE = "place_id string, change_type string, field string, old_value string, new_value string, seq long"
CHANGE_COLUMNS = [x.split()[0] for x in CHANGE.split(", ")]
#: Rows that a place gives at once.
OUT_ROWS = 10_000


def _order(place: str | None) -> tuple[bool, str]:
    """Places by name, null last."""
    return place is None, place or ""


class PlaceState:
    """The last row of one place at a time, ``place``, in the map of its bucket."""

    def __init__(self, states: MapState) -> None:
        self.states, self.place = states, None

    def get(self) -> tuple | None:
        """What is known, or None."""
        return self.states.getValue((self.place,))

    def update(self, last: tuple) -> None:
        """Keeps a row."""
        self.states.updateValue((self.place,), last)

    def clear(self) -> None:
        """Forgets the place."""
        self.states.removeKey((self.place,))


class ChangeProcessor(StatefulProcessor):
    """ST1. The last (seq, fields) of each place of a bucket. A row that is not later than its place's last is ignored, and so is one without ``seq``.

    ``fields`` are compared as text; volatile columns are left out of them. First sight is silent, or with ``announce`` a ``new`` row;
    a row whose ``removed`` is true forgets the place, and with ``announce`` gives a ``removed`` row. A place not seen for ``ttl_ms``
    is forgotten too. Rows without ``place_id`` are of the place that is the key.
    """

    def __init__(self, fields: list[str], count: str | None = None, announce: bool = False, ttl_ms: int | None = None) -> None:
        self.fields, self.count, self.announce, self.ttl_ms = fields, count, announce, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Opens the state."""
        row = "seq long, " + ", ".join(f"`{f}` string" for f in self.fields)
        self.last = PlaceState(handle.getMapState("last", "place_id string", row, self.ttl_ms))

    def _rows(self, chunk: pd.DataFrame, key: tuple) -> Iterator[tuple]:
        """(place, seq, removed, fields ...) by place and ``seq``. As lists: a frame's own operations take longer than the rows of most buckets."""
        given = lambda c: [None if pd.isna(x) else x for x in chunk[c].tolist()]
        place = given("place_id") if "place_id" in chunk else [key[0]] * len(chunk)
        seq = [None if x is None else int(x) for x in given("seq")]
        columns = [place, seq, given("removed") if "removed" in chunk else [False] * len(chunk), *map(given, self.fields)]
        known = [i for i, x in enumerate(seq) if x is not None]  # a row without seq has no place in the order
        return (tuple(c[i] for c in columns) for i in sorted(known, key=lambda i: (*_order(place[i]), seq[i])))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        """The last landed row of each place, before the first batch."""
        for place, seq, _, *fields in self._rows(initialState, key):
            self.last.place = place
            self.last.update((seq, *(None if x is None else str(x) for x in fields)))

    def _changes(self, place: str, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Changes of a place in the order of ``seq``; its state is written after the last."""
        self.last.place = place
        last = known = self.last.get()
        for _, seq, removed, *fields in rows:
            now = [None if x is None else str(x) for x in fields]
            if last is not None and seq <= last[0]:
                continue
            if removed:
                if last is not None and self.announce:
                    yield (place, "removed", None, None, None, seq)
                last = None
                continue
            if last is None and self.announce:
                yield (place, "new", None, None, None, seq)
            for f, old, new in zip(self.fields, last[1:] if last is not None else now, now, strict=True):
                if old != new:
                    yield (place, "menu_changed" if f == self.count else "updated", f, old, new, seq)
            last = (seq, *now)
        if last is not None:
            self.last.update(tuple(last))
        elif known is not None:
            self.last.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Changes of the bucket's places, ``OUT_ROWS`` at once.

        Rows come in chunks; each is sorted alone, and the chunks are merged row by row.
        """
        merged = heapq.merge(*(self._rows(chunk, key) for chunk in rows), key=lambda r: (*_order(r[0]), r[1]))
        found = itertools.chain.from_iterable(self._changes(place, mine) for place, mine in itertools.groupby(merged, key=lambda r: r[0]))
        while True:
            out = list(itertools.islice(found, OUT_ROWS))
            yield pd.DataFrame(out, columns=CHANGE_COLUMNS)
            if len(out) < OUT_ROWS:
                return

    def close(self) -> None:
        """Nothing is open."""


def change_feed(rows: DataFrame, fields: list[str], count: str | None = None, announce: bool = False, ttl_ms: int | None = None, landed: DataFrame | None = None, buckets: int = 4096) -> DataFrame:
    """ST1. ``rows``: a stream of (place_id, seq, fields ..., perhaps removed). Needs the RocksDB state store.

    ``landed``: a table (place_id, seq, fields ...) of what is known already, as yesterday's snapshot: the feed compares with its
    latest rows from the first batch on. It is read when the checkpoint is new, and not again.
    With ``ttl_ms`` a place's state ends so long after it was last written, so the store is bounded by what is seen in that time.
    Places are handled by ``buckets`` of their hash, since a group costs much more than a place's rows; with one for each place that was most of the
    time. A bucket's rows of a batch are in one task's memory; the number of buckets must stay while the checkpoint lives.
    """
    removed = F.coalesce(F.col("removed").cast("boolean"), F.lit(False)) if "removed" in rows.columns else F.lit(False)
    place, text = F.col("place_id").cast("string").alias("place_id"), [F.col(f).cast("string").alias(f) for f in fields]
    # as text, since in pandas a list of longs with a null is one of doubles
    seq, key = F.col("seq").cast("string"), max(["", *fields], key=len) + "_bucket"  # a name that no field has
    some = lambda df, *more: df.select(place, F.col("seq").cast("long").alias("seq"), *text, *more).filter("seq is not null")
    by_bucket = lambda df: df.withColumns({"seq": seq, key: F.pmod(F.xxhash64("place_id"), F.lit(buckets)).cast("int")}).groupBy(key)
    before = {}
    if landed is not None:
        latest = some(landed).groupBy("place_id").agg(F.max(F.struct("seq", *fields)).alias("last")).select("place_id", "last.*")
        before = {"initialState": by_bucket(latest)}
    processor = ChangeProcessor(fields, count, announce, ttl_ms)
    return by_bucket(some(rows, removed.alias("removed"))).transformWithStateInPandas(statefulProcessor=processor, outputStructType=CHANGE, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None", **before)


def cycle_sink(path: str, metrics: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """ST3, ST4, ST5. A ``foreachBatch`` writer: rows, counters and quality figures of each batch, in folders by its number.

    A batch that is run again overwrites its own folders, so it counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch_id={number}")
        counters = batch.agg(F.count("*").alias("n_changes"), F.count_distinct("place_id").alias("n_places"), F.count_if(F.col("change_type") == "menu_changed").alias("n_menu_changes"))
        counters.write.mode("overwrite").parquet(f"{path}/counters/batch_id={number}")
        if metrics:
            metrics(batch).write.mode("overwrite").parquet(f"{path}/quality/batch_id={number}")
        batch.unpersist()

    return write


def run_cycles(changes: DataFrame, path: str, checkpoint: str, every: str | None = None, metrics: Callable[[DataFrame], DataFrame] | None = None):
    """ST2. Starts the feed into ``cycle_sink``: every ``every`` (as "15 minutes"), or all that is there, once."""
    writer = changes.writeStream.foreachBatch(cycle_sink(path, metrics)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class PlaceTable:
    """ST3. A table of places by key, in hash buckets, as a row of versions.

    A batch writes the buckets that its keys fall into, merged with their rows before, as files of its own number; a manifest of that
    number then says which version each bucket has. Readers see the latest manifest. So a batch writes in proportion to the buckets
    that it touches; one that is run again reads the manifest before its own and writes the same files once more; and one that
    dies before its manifest changes nothing. Manifests before the last ``keep``, and files that none of the kept ones names, are removed.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, keep: int = 2) -> None:
        if keep < 2:
            raise ValueError("the manifest before the last must stay, for a batch that is run again")
        self.spark, self.path, self.key, self.buckets, self.keep = spark, path, key, buckets, keep
        jvm = spark._jvm.org.apache.hadoop.fs
        self._at = lambda x: jvm.Path(f"{path}/{x}")
        self._store = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(x.getPath().getName() for x in self._store.listStatus(at)) if self._store.exists(at) else []

    def manifests(self) -> list[int]:
        """The numbers of the manifests that are there."""
        return sorted(int(x.split("-")[1]) for x in self._names("manifests") if x.startswith("batch-"))

    def versions(self, number: int) -> dict[int, int]:
        """Bucket: the version that it has in a manifest, or in the last before it; one small file."""
        before = [n for n in self.manifests() if n <= number]
        if not before:
            return {}
        rows = self.spark.read.schema("bucket int, version long").json(f"{self.path}/manifests/batch-{before[-1]}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _folders(self, versions: dict[int, int]) -> list[str]:
        return [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]

    def read(self, schema: T.StructType | str) -> DataFrame:
        """The rows of the latest manifest."""
        numbers = self.manifests()
        folders = self._folders(self.versions(numbers[-1])) if numbers else []
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, number: int, updated: str, created: str) -> None:
        """Batch ``number`` into the table, as ``upsert_by_key`` does."""
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).persist()
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        now = self.versions(number - 1)
        if touched:
            known = self._folders({b: now[b] for b in touched if b in now})
            old = self.spark.read.schema(batch.schema).parquet(*known) if known else batch.limit(0)
            merged = upsert_by_key(old, rows.drop("bucket"), self.key, updated, created)
            merged = merged.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={number}")
        rows.unpersist()
        now |= {b: number for b in touched}
        text = "".join(f'{{"bucket":{b},"version":{v}}}\n' for b, v in sorted(now.items()))
        draft = self._at(f"manifests/.{uuid.uuid4().hex}")
        out = self._store.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        final = self._at(f"manifests/batch-{number}")
        self._store.delete(final, False)
        self._store.rename(draft, final)
        self._clean()

    def _clean(self) -> None:
        numbers = self.manifests()
        used = {(v, b) for n in numbers[-self.keep :] for b, v in self.versions(n).items()}
        for n in numbers[: -self.keep]:
            self._store.delete(self._at(f"manifests/batch-{n}"), False)
        if not numbers:
            return
        for version in self._names("data"):
            v = int(version.split("=")[1])
            if v > numbers[-1]:
                continue
            for bucket in [x for x in self._names(f"data/{version}") if x.startswith("bucket=")]:
                if (v, int(bucket.split("=")[1])) not in used:
                    self._store.delete(self._at(f"data/{version}/{bucket}"), True)
            if not any(x.startswith("bucket=") for x in self._names(f"data/{version}")):
                self._store.delete(self._at(f"data/{version}"), True)


def row_sink(path: str, key: str, updated: str, created: str, buckets: int = 64, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """ST3. A ``foreachBatch`` writer that keeps the table of places (``PlaceTable``)."""

    def write(batch: DataFrame, number: int) -> None:
        PlaceTable(batch.sparkSession, path, key, buckets, keep).upsert(batch, number, updated, created)

    return write


def run_rows(rows: DataFrame, path: str, checkpoint: str, key: str, updated: str, created: str, every: str | None = None, buckets: int = 64):
    """ST2, ST3. Starts the table of places beside the feed of changes, on the same trigger."""
    writer = rows.writeStream.foreachBatch(row_sink(path, key, updated, created, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
