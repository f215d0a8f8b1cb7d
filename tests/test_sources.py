"""Reading, writing and following places."""

from __future__ import annotations

import json
import os
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from pantryline.operators import metrics, serve
from pantryline.sources import places, store
from pantryline.streaming import changes


def test_envelopes(spark, tmp_path):
    row = {"id": "1", "name": "Luna", "latitude": 41.5}
    for i, body in enumerate(([row], {"restaurants": [row]}, {"all_restaurants": [row]}, {"summary": {"restaurants": [row]}}, {"merged_restaurants": [row, row]})):
        (tmp_path / f"{i}.json").write_text(json.dumps(body))
        got = places.read_places_json(spark, str(tmp_path / f"{i}.json")).collect()
        assert len(got) == (2 if i == 4 else 1) and got[0]["name"] == "Luna" and got[-1]["source_pos"] == len(got) - 1


def test_latest_and_inventory(spark, tmp_path):
    for i, name in enumerate(["a_restaurants_1.json", "b_merged_2.json", "c_merged_3.json", "notes.txt"]):
        (tmp_path / name).write_text("x" * (i + 1))
        os.utime(tmp_path / name, (1e9 + i, 1e9 + i))
    assert places.latest_snapshot(spark, str(tmp_path)).endswith("c_merged_3.json")
    assert places.latest_snapshot(spark, str(tmp_path), ("nothing",)) is None
    got = {r["class"]: (r["n_files"], r["bytes"]) for r in places.dataset_inventory(spark, str(tmp_path), {"merged": "merged", "osm": "osm"}).collect()}
    assert got == {"merged": (2, 5), "other": (2, 5)}


def test_normalise(spark, tmp_path):
    osm = [{"type": "node", "id": 1, "lat": 41.0, "lon": -87.0, "tags": {"name": "Luna", "addr:street": "Main", "addr:housenumber": "5", "payment:cash": "yes", "diet:vegan": "yes", "diet:halal": "no"}}, {"type": "way", "id": 2, "center": {"lat": 42.0, "lon": -88.0}, "tags": {"name": "Sol"}}, {"type": "node", "id": 3, "lat": 1.0, "lon": 1.0, "tags": {}}, {"type": "way", "id": 4, "tags": {"name": "nowhere"}}]
    (tmp_path / "o.json").write_text(json.dumps({"elements": osm}))
    df = spark.read.schema(places.OSM).json(str(tmp_path / "o.json"), multiLine=True)
    assert places.normalise_osm(df).filter("lat is null").select("name").count() == places.normalise_osm(df).count() - 2
    got = places.normalise_osm(df, keep_unplaced=False).orderBy("place_id").collect()
    assert [r["place_id"] for r in got] == ["osm_node_1", "osm_way_2"]
    assert (got[0]["address"], got[0]["payment_methods"], got[0]["dietary_options"], got[1]["lat"], got[1]["cuisine"]) == ("5 Main", ["cash"], ["vegan"], 42.0, "unknown")
    assert places.normalise_osm(df, keep_nameless=True).filter("name = 'Unknown'").count() == 1
    yelp = {"id": "y", "name": "Luna", "categories": [{"alias": "a", "title": "Pizza"}], "location": {"display_address": ["1 A", "B"], "city": "C"}, "coordinates": {"latitude": 1.0, "longitude": 2.0}, "price": "$$"}
    (tmp_path / "y.json").write_text(json.dumps(yelp))
    y = places.normalise_yelp(spark.read.schema(places.YELP).json(str(tmp_path / "y.json"))).first()
    assert (y["place_id"], y["address"], y["categories"], y["price_tier"], y["lat"]) == ("yelp_y", "1 A, B", ["Pizza"], "$$", 1.0)
    fsq = {"id": "f", "name": "Sol", "categories": [{"name": "Bar"}], "location": {"formattedAddress": ["1 A"], "lat": 1.0, "lng": 2.0}, "contact": {"phone": "123", "formattedPhone": ""}, "price": {"tier": 3}}
    (tmp_path / "f.json").write_text(json.dumps(fsq))
    f = places.normalise_foursquare(spark.read.schema(places.FOURSQUARE).json(str(tmp_path / "f.json"))).first()
    assert (f["phone"], f["price_tier"], f["categories"]) == ("123", "$$$", ["Bar"])


def test_change_kinds():
    import pandas as pd

    class State:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    def run(processor, *rows):
        frame = pd.DataFrame(rows, columns=["seq", "phone", "removed"])
        return [tuple(r)[1:5] for r in next(processor.handleInputRows(("a",), iter([frame]), None)).itertuples(index=False)]

    loud, quiet = changes.ChangeProcessor(["phone"], announce=True), changes.ChangeProcessor(["phone"])
    loud.last, quiet.last = State(), State()
    rows = [(1, "1", False), (2, "2", False), (3, "2", True), (4, "3", False)]
    assert run(loud, *rows) == [("new", None, None, None), ("updated", "phone", "1", "2"), ("removed", None, None, None), ("new", None, None, None)]
    assert run(quiet, *rows) == [("updated", "phone", "1", "2")] and quiet.last.value == (4, "3")
    assert run(quiet, (5, "3", True)) == [] and not quiet.last.exists()


def test_counts_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([1, {}]))
    (tmp_path / "b.json").write_text(json.dumps({"merged_restaurants": [{}]}))
    (tmp_path / "c.json").write_text(json.dumps({"total_restaurants": 7}))
    (tmp_path / "d.json").write_text("no json")
    got = {r["path"][-6:]: r["n_rows"] for r in places.dataset_rows(spark, str(tmp_path)).collect()}
    assert got == {"a.json": 2, "b.json": 1, "c.json": 7, "d.json": None}
    os.utime(tmp_path / "c.json", (2e9, 2e9))
    assert [r["path"][-6:] for r in places.newest_files(spark, str(tmp_path), 1).collect()] == ["c.json"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "luna", "chi", ["milk"]), ("2", "sol", "nyc", [])], "id string, name string, city string, labels array<string>")
    store.write_report(df, metrics.coverage(df, named=F.col("name") != ""), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/statistics").first()["named"] == 100.0 and spark.read.json(f"{tmp_path}/report/rows").count() == 2
    store.write_by_city(df, "city", f"{tmp_path}/cities")
    assert {x for x in os.listdir(f"{tmp_path}/cities") if "=" in x} == {"city=chi", "city=nyc"}
    for _ in range(2):
        store.append_log(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    tables = store.normalise_items(df.withColumns({"place": F.lit("p"), "category": F.lit("c")}), "id", "place", "category", {"allergens": "labels"})
    assert tables["items"].count() == 2 and tables["categories"].count() == 1 and [tuple(r) for r in tables["allergens"].collect()] == [("1", "milk")]
    one = store.export_place(df.select("id", "name"), df.select("id", "city"), "id").orderBy("id").first()
    assert one["menu_items"][0]["city"] == "chi"
    assert serve.enrich(df.select("id", "name"), spark.createDataFrame([("1", "LUNA", 4.5)], "id string, name string, rating double"), "id").orderBy("id").collect()[0]["name"] == "LUNA"


def test_change_feed(spark, tmp_path):
    schema = "place_id string, seq long, phone string, n_items long, last_checked string"

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        feed = changes.change_feed(stream, ["phone", "n_items"], count="n_items")
        q = changes.run_cycles(feed, f"{tmp_path}/out", f"{tmp_path}/checkpoint", metrics=lambda b: b.agg(F.count("*").alias("n")))
        q.awaitTermination()
        return sorted(tuple(r)[:6] for r in spark.read.parquet(f"{tmp_path}/out/changes").collect())

    assert put(("a", 1, "1", 5, "x"), ("b", 1, None, 1, "x")) == []  # first sight is silent
    # re-sent alike but for a volatile column; a changed field; an old row
    got = put(("a", 2, "1", 5, "y"), ("b", 2, "9", 1, "y"), ("b", 1, "0", 7, "y"))
    assert got == [("b", "updated", "phone", None, "9", 2)]
    got = put(("a", 3, "1", 6, "z"), ("c", 1, "1", 1, "z"))
    assert ("a", "menu_changed", "n_items", "5", "6", 3) in got and len(got) == 2
    counters = spark.read.parquet(f"{tmp_path}/out/counters")
    assert counters.agg(F.sum("n_changes"), F.sum("n_menu_changes")).first()[:] == (2, 1)
    assert spark.read.parquet(f"{tmp_path}/out/quality").agg(F.sum("n")).first()[0] == 2


def test_a_cluster_needs_a_shared_folder(spark, tmp_path):
    from types import SimpleNamespace as Fake

    import pytest

    from pantryline.sources import shared

    seen = []
    context = lambda master, given: Fake(master=master, applicationId="app-1", getConf=lambda: Fake(get=lambda _: given), getCheckpointDir=lambda: None, setCheckpointDir=seen.append)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.new_path(Fake(sparkContext=context("spark://h:7077", None)), "x")
    assert shared.new_path(Fake(sparkContext=context("spark://h:7077", "hdfs://n/dir/")), "x").startswith("hdfs://n/dir/pantryline-app-1/x-")
    assert shared.new_path(Fake(sparkContext=context("local[2]", None)), "x").startswith("file://") and len(seen) == 2
    table = shared.written(spark.range(3), "three")
    assert table.count() == 3 and table.inputFiles()[0].startswith(shared.session_dir(spark).replace("file://", "file:///").replace("////", "///"))


def test_place_table_writes_what_it_touches(spark, tmp_path):
    """Versions of buckets: few are written, a batch run again changes nothing, old files go."""
    schema, path = "id long, updated long, created long, v string", str(tmp_path / "places")
    batch = lambda rows: spark.createDataFrame(rows, schema)
    sink = changes.row_sink(path, "id", "updated", "created", buckets=16)
    read = lambda: sorted(tuple(r) for r in changes.PlaceTable(spark, path, "id", 16).read(schema).collect())
    assert read() == []
    every = [(i, 0, 0, "a") for i in range(200)]
    sink(batch(every), 0)
    assert read() == every
    for _ in range(2):  # the second time as after a restart
        sink(batch([(7, 1, 1, "b"), (7, 2, 2, "c"), (500, 1, 1, "new")]), 1)
        assert read() == sorted([r for r in every if r[0] != 7] + [(7, 2, 0, "c"), (500, 1, 1, "new")])
        assert len([x for x in os.listdir(f"{path}/data/version=1") if "=" in x]) <= 2
    sink(batch([]), 2)
    sink(batch([(7, 3, 3, "d")]), 3)
    assert dict((r[0], r[3]) for r in read())[7] == "d" and len(read()) == 201
    kept = {x for x in os.listdir(f"{path}/manifests") if x.startswith("batch-")}
    assert kept == {"batch-2", "batch-3"}
    assert not [x for x in os.listdir(f"{path}/data/version=0") if x == f"bucket={[b for b in os.listdir(f'{path}/data/version=3') if '=' in b][0].split('=')[1]}"]


def test_feed_begins_on_what_is_landed(spark, tmp_path):
    landed = spark.createDataFrame([("a", 5, "1"), ("a", 4, "0"), ("b", 5, None), (None, 1, "x")], "place_id string, seq long, phone string")

    def run(*rows):
        spark.createDataFrame(list(rows), landed.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(landed.schema).parquet(f"{tmp_path}/in")
        changes.run_cycles(changes.change_feed(stream, ["phone"], announce=True, landed=landed), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return sorted((r["place_id"], r["change_type"], r["old_value"], r["new_value"], r["seq"]) for r in spark.read.schema(changes.CHANGE).parquet(f"{tmp_path}/out/changes/*").collect())

    first = run(("a", 5, "late"), ("a", 6, "2"), ("b", None, "lost"), ("b", 9, "3"), ("c", 1, "1"))
    assert first == [("a", "updated", "1", "2", 6), ("b", "updated", None, "3", 9), ("c", "new", None, None, 1)]
    assert run(("a", 7, "1")) == sorted([*first, ("a", "updated", "2", "1", 7)])  # the landed rows are not read again


def test_feed_merges_chunks():
    """A hot place's rows come in several chunks, out of order."""

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    rng = random.Random(4)
    rows = [(i, str(rng.randrange(3)), rng.random() < 0.1) for i in range(200)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    outs = []
    for given in (rows, shuffled):
        p = changes.ChangeProcessor(["phone"], announce=True)
        p.last = State()
        frames = [pd.DataFrame(given[i : i + 30], columns=["seq", "phone", "removed"]) for i in range(0, 200, 30)] + [pd.DataFrame([(None, "9", False)], columns=["seq", "phone", "removed"])]
        outs.append([tuple(r) for f in p.handleInputRows(("a",), iter(frames), None) for r in f.itertuples(index=False)])
    assert outs[0] == outs[1] and len(outs[0]) > 100


def test_large_envelopes_in_ranges(spark, tmp_path):
    """Ranges of any size give what the file as one document gives."""
    from pantryline.sources import envelopes

    rng = random.Random(3)
    odd = ['a "quoted" {name}', "back\\slash", "\\", '"', "]}", "ünïcode 日本", "[{", "x" * 300, ""]
    record = lambda i: {"id": str(i), "name": rng.choice(odd) + str(i), "address": rng.choice(odd), "more": {"restaurants": [{"id": "no"}], "k": [[], {}]}, "rating": i / 2}
    many = lambda n: [record(i) for i in range(n)]
    docs = {
        "a.json": many(40),
        "b.json": {"info": {"x": [{"id": "no"}]}, "restaurants": many(30), "after": {"a": {"id": "no"}}},
        "c.json": {"summary": {"restaurants": many(9), "z": {"y": {}}}, "x": [1, {"id": "no"}]},
        "d.json": {"merged_restaurants": many(5), "all_restaurants": many(7)},
        "e.json": {"restaurants": []},
        "f.json": [],
    }
    for i, (name, doc) in enumerate(docs.items()):
        (tmp_path / name).write_text(json.dumps(doc, indent=i % 3 or None, ensure_ascii=bool(i % 2)))
    want = sorted(map(str, places.read_places_json(spark, str(tmp_path)).select("source_pos", "id", "name", "address", "rating").collect()))
    assert len(want) == 86
    for size in (7, 61, 1000, 1 << 20):
        got = envelopes.read_large_places_json(spark, str(tmp_path), range_bytes=size).select(F.col("source_pos").cast("int"), "id", "name", "address", "rating")
        assert sorted(map(str, got.collect())) == want, size
