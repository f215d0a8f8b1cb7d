"""Queries of sources, sinks, streams and page blocks. Files and pages are made from the given tables by Spark, in the shared folder,
so what must come back follows from the tables alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantryline.operators import extract, metrics
from pantryline.plans.base import Tables, query
from pantryline.sources import envelopes, places, store
from pantryline.sources.shared import new_path
from pantryline.streaming import changes


def _text(c: str) -> Column:
    return F.col(c).cast("string")

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _files(t: Tables, rows: DataFrame, value: Column, by: list[str], name: str) -> str:
    """A file for each value of ``by`` with one text in it; the pattern of their folders."""
    path = new_path(t.spark, name)
    rows.select(*by, value.alias("value")).repartition(*by).write.partitionBy(*by).text(path)
    return path + "/*" * len(by)


def _envelopes(t: Tables) -> str:
    """Suppliers as JSON files, one a nation and thousand keys, in three kinds of envelope."""
    record = F.struct(_text("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("rating"))
    each = t.supplier.groupBy("s_nationkey", F.expr("s_suppkey div 1000").alias("part")).agg(F.sort_array(F.collect_list(record)).alias("r"))
    n = F.col("s_nationkey") % 3
    value = F.when(n == 0, F.to_json("r")).when(n == 1, F.to_json(F.struct(F.col("r").alias("restaurants")))).otherwise(F.to_json(F.struct(F.struct(F.col("r").alias("restaurants")).alias("summary"))))
    return _files(t, each, value, ["s_nationkey", "part"], "envelopes")


@query("SELECT row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 1000 ORDER BY s_suppkey::VARCHAR) - 1 AS source_pos, s_suppkey::VARCHAR AS id, s_name AS name, round(s_acctbal, 4) AS rating FROM supplier")
def src1_read_places_json(t: Tables) -> DataFrame:
    """Places of envelopes and bare lists."""
    return places.read_places_json(t.spark, _envelopes(t)).select("source_pos", "id", "name", F.round("rating", 4).alias("rating"))


@query("SELECT row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 1000 ORDER BY s_suppkey::VARCHAR) - 1 AS source_pos, s_suppkey::VARCHAR AS id, s_name AS name, round(s_acctbal, 4) AS rating FROM supplier")
def src1_large_envelopes(t: Tables) -> DataFrame:
    """The same by byte ranges of 512 bytes, so that every file is cut within records and texts."""
    found = envelopes.read_large_places_json(t.spark, _envelopes(t), range_bytes=512)
    return found.select("source_pos", "id", "name", F.round("rating", 4).alias("rating"))


SNAPSHOTS = ["chicago_comprehensive_menus_1.parquet", "chicago_comprehensive_menus_2.parquet", "merged_a.parquet", "restaurants_old.parquet", "other.parquet"]
#: When each was written, in hours.
WRITTEN = [3, 7, 9, 5, 11]


def _snapshots(t: Tables) -> str:
    """A file of each of five groups of customers, under its own name and with its own time; the folder."""
    spark, path = t.spark, new_path(t.spark, "snapshots")
    jvm = spark._jvm.org.apache.hadoop.fs
    store = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    t.customer.withColumn("kind", F.col("c_custkey") % len(SNAPSHOTS)).repartition("kind").write.partitionBy("kind").parquet(f"{path}/by-kind")
    for i, (name, hours) in enumerate(zip(SNAPSHOTS, WRITTEN, strict=True)):
        part = next(x.getPath() for x in store.listStatus(jvm.Path(f"{path}/by-kind/kind={i}")) if x.getPath().getName().startswith("part-"))
        store.mkdirs(jvm.Path(f"{path}/files"))
        store.rename(part, jvm.Path(f"{path}/files/{name}"))
        store.setTimes(jvm.Path(f"{path}/files/{name}"), hours * 3_600_000, -1)
    return f"{path}/files"


@query("""
WITH f AS (SELECT c_custkey % 5 AS kind, count(*) AS n FROM customer GROUP BY 1)
SELECT wanted, found, n FROM (VALUES ('first pattern', 'chicago_comprehensive_menus_2.parquet', 1), ('second pattern', 'merged_a.parquet', 2), ('third pattern', 'restaurants_old.parquet', 3), ('any', 'other.parquet', 4)) AS v(wanted, found, kind) JOIN f USING (kind)
UNION ALL SELECT 'none', NULL, 0
""")
def src2_latest_snapshot(t: Tables) -> DataFrame:
    """Among five files with names and times of their own: the newest of the first pattern that any name has."""
    path = _snapshots(t)
    patterns = {"first pattern": ("comprehensive.*menus", "merged", "restaurants"), "second pattern": ("nothing", "merged", "restaurants"), "third pattern": ("nothing", "restaurants"), "any": ("",), "none": ("nothing",)}
    rows = []
    for wanted, some in patterns.items():
        latest = places.latest_snapshot(t.spark, path, some)
        one = t.spark.read.parquet(latest).agg(F.count("*").alias("n")) if latest else t.spark.range(1).select(F.lit(0).cast("long").alias("n"))
        rows.append(one.select(F.lit(wanted).alias("wanted"), F.lit(latest and latest.rsplit("/", 1)[1]).cast("string").alias("found"), "n"))
    return reduce(DataFrame.unionByName, rows)


@query("""
SELECT 'osm_' || CASE WHEN c_custkey % 3 = 0 THEN 'way' ELSE 'node' END || '_' || c_custkey AS place_id, CASE WHEN c_custkey % 6 <> 0 THEN round(c_custkey / 1000.0, 6)::DOUBLE END AS lat,
  CASE WHEN c_custkey % 4 = 0 THEN '5 Main' END AS address, CASE WHEN c_custkey % 2 = 0 THEN 'thai' ELSE 'unknown' END AS cuisine, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey::INT) AS last_modified FROM customer WHERE c_custkey % 5 > 0
""")
def src3_normalise_osm(t: Tables) -> DataFrame:
    """Elements to places: ways with and without a centre, nameless ones."""
    k = F.col("c_custkey")
    point = F.struct((k / 1000.0).alias("lat"), (k / 2000.0).alias("lon"))
    way = k % 3 == 0
    tag = lambda c, name, value: F.when(c, F.struct(F.lit(name).alias("k"), value.alias("v")))
    given = F.array(tag(k % 5 > 0, "name", F.col("c_name")), tag(k % 4 == 0, "addr:street", F.lit("Main")), tag(k > 0, "addr:housenumber", F.lit("5")), tag(k % 2 == 0, "cuisine", F.lit("thai")))
    tags = F.map_from_entries(F.filter(given, lambda x: x.isNotNull()))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + k), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    element = F.struct(F.when(way, "way").otherwise("node").alias("type"), k.alias("id"), stamp.alias("timestamp"), F.when(~way, point["lat"]).alias("lat"), F.when(~way, point["lon"]).alias("lon"), F.when(way & (k % 6 != 0), point).alias("center"), tags.alias("tags"))
    path = new_path(t.spark, "osm")
    t.customer.groupBy("c_nationkey", F.expr("c_custkey div 1000").alias("part")).agg(F.collect_list(element).alias("elements")).select("elements").write.json(path)
    return places.normalise_osm(t.spark.read.schema(places.OSM).json(path)).select("place_id", F.round("lat", 6).alias("lat"), "address", "cuisine", "last_modified")


@query("SELECT 'yelp_' || c_custkey AS place_id, round(c_acctbal, 4) AS rating, '1 A, B' || c_nationkey AS address, c_mktsegment || ',x' AS categories, CASE WHEN c_custkey % 2 = 0 THEN '$$' END AS price_tier FROM customer")
def src4_normalise_yelp(t: Tables) -> DataFrame:
    """Business records to places."""
    path = new_path(t.spark, "yelp")
    rows = t.customer.select(_text("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("rating"), F.when(F.col("c_custkey") % 2 == 0, "$$").alias("price"), F.struct(F.array(F.lit("1 A"), F.concat(F.lit("B"), _text("c_nationkey"))).alias("display_address")).alias("location"), F.array(F.struct(F.col("c_mktsegment").alias("title")), F.struct(F.lit("x").alias("title"))).alias("categories"))
    rows.write.json(path)
    out = places.normalise_yelp(t.spark.read.schema(places.YELP).json(path))
    return out.select("place_id", F.round("rating", 4).alias("rating"), "address", F.array_join("categories", ",").alias("categories"), "price_tier")


@query("SELECT 'fsq_' || s_suppkey AS place_id, CASE WHEN s_suppkey % 2 = 0 THEN '(312) ' || s_suppkey ELSE '312' || s_suppkey END AS phone, repeat('$', (s_suppkey % 4)::INT) AS price_tier, s_suppkey % 50 AS review_count FROM supplier")
def src5_normalise_foursquare(t: Tables) -> DataFrame:
    """Venue records to places."""
    k, path = F.col("s_suppkey"), new_path(t.spark, "venues")
    contact = F.struct(F.concat(F.lit("312"), _text("s_suppkey")).alias("phone"), F.when(k % 2 == 0, F.concat(F.lit("(312) "), _text("s_suppkey"))).otherwise("").alias("formattedPhone"))
    t.supplier.select(_text("s_suppkey").alias("id"), F.col("s_name").alias("name"), contact.alias("contact"), F.struct((k % 4).alias("tier")).alias("price"), F.struct((k % 50).alias("tipCount")).alias("stats")).write.json(path)
    return places.normalise_foursquare(t.spark.read.schema(places.FOURSQUARE).json(path)).select("place_id", "phone", "price_tier", F.col("review_count").cast("long").alias("review_count"))


@query("SELECT page_id, length(url) AS n_url, md5(html) AS digest FROM pages")
def src6_read_pages(t: Tables) -> DataFrame:
    """Landed pages."""
    return places.read_pages(t.spark, f"{t.sf_dir}/pages.parquet").select("page_id", F.length("url").cast("long").alias("n_url"), F.md5("html").alias("digest"))


@query("SELECT s_suppkey::VARCHAR AS id, round(avg((s_acctbal > 0)::INT) OVER () * 100, 6) AS in_credit FROM supplier")
def snk1_write_report(t: Tables) -> DataFrame:
    """A report of rows and their statistics, read again."""
    path = new_path(t.spark, "report")
    rows = t.supplier.select(_text("s_suppkey").alias("id"), "s_acctbal")
    store.write_report(rows, metrics.coverage(rows, in_credit=F.col("s_acctbal") > 0), path)
    one = t.spark.read.schema("in_credit double").json(f"{path}/statistics").select(F.round("in_credit", 6).alias("in_credit"), F.lit(1).alias("k"))
    return t.spark.read.schema("id string").json(f"{path}/rows").withColumn("k", F.lit(1)).join(one, "k").drop("k")


@query("SELECT c_custkey, c_nationkey AS city FROM customer")
def snk2_write_by_city(t: Tables) -> DataFrame:
    """A folder for each city, read again."""
    path = new_path(t.spark, "cities")
    store.write_by_city(t.customer.select("c_custkey", F.col("c_nationkey").alias("city")), "city", path)
    return t.spark.read.schema("c_custkey long, city int").parquet(path)


@query("SELECT event_type, (2 * count(*))::BIGINT AS n FROM events GROUP BY 1")
def snk6_append_log(t: Tables) -> DataFrame:
    """A log that two runs appended to."""
    path = new_path(t.spark, "log")
    for _ in range(2):
        store.append_log(t.events.select("event_id", "event_type"), path)
    return t.spark.read.schema("event_type string").parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk6_stream_log(t: Tables) -> DataFrame:
    """A log by a stream that stopped and started again; the second half of its calls came twice, and so did some of the first."""
    path = new_path(t.spark, "log-stream")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = t.events.select("event_id", "ts", "event_type")
    half = F.col("ts") < "2024-01-15"
    for some in (rows.filter(half), rows.filter(~half).unionByName(rows.filter(~half)).unionByName(rows.filter(F.col("ts").between("2024-01-14", "2024-01-16")))):
        some.write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        store.stream_log(stream, f"{path}/out", f"{path}/checkpoint", "event_id", "ts", "60 days").awaitTermination()
    return t.spark.read.schema("event_type string").parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_partkey::VARCHAR AS item_p_partkey, p_name || ', \"' || p_type || '\"' AS item_name, 'a;b' AS item_labels FROM part UNION ALL SELECT 'none', NULL, NULL, NULL")
def snk8_export_csv(t: Tables) -> DataFrame:
    """Places with their items as lines of CSV, quotes and commas in them, read again; one place has none."""
    path = new_path(t.spark, "export-csv")
    brands = t.part.select("p_brand").distinct().unionByName(t.part.agg(F.lit("none").alias("p_brand")))
    items = t.part.select("p_brand", "p_partkey", F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("name"), F.array(F.lit("a"), F.lit("b")).alias("labels"))
    store.export_csv(brands, items, "p_brand", path)
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


@query("SELECT p_brand, count(*)::INT AS n_items, sum(p_partkey)::BIGINT AS keys, 0 AS n_none FROM part GROUP BY 1 UNION ALL SELECT 'none', 0, NULL, 1")
def snk8_export_place(t: Tables) -> DataFrame:
    """Places with their items as documents, written as JSON and read again; one place has none."""
    path = new_path(t.spark, "export")
    brands = t.part.select("p_brand").distinct().unionByName(t.part.agg(F.lit("none").alias("p_brand")))
    store.export_place(brands, t.part.select("p_brand", "p_partkey", "p_name"), "p_brand").write.json(path)
    back = t.spark.read.schema("p_brand string, menu_items array<struct<p_partkey:long,p_name:string>>").json(path)
    n = F.size("menu_items")
    keys = F.when(n > 0, F.aggregate("menu_items", F.lit(0).cast("long"), lambda a, x: a + x["p_partkey"]))
    return back.select("p_brand", n.alias("n_items"), keys.alias("keys"), (n == 0).cast("int").alias("n_none"))


@query("""
WITH f AS (SELECT s_nationkey % 3 AS kind, count(*) AS n FROM supplier GROUP BY s_nationkey, s_suppkey // 1000, 1)
SELECT CASE kind WHEN 0 THEN 'list' WHEN 1 THEN 'restaurants' ELSE 'none' END AS kind, count(*) AS n_files, CASE WHEN kind < 2 THEN sum(n)::BIGINT END AS n_rows FROM f GROUP BY kind
""")
def a23_dataset_inventory(t: Tables) -> DataFrame:
    """Files by kind with the records that they hold."""
    found = places.dataset_rows(t.spark, _envelopes(t)).withColumn("n", F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("int") % 3)
    kind = F.when(F.col("n") == 0, "list").when(F.col("n") == 1, "restaurants").otherwise("none")
    return found.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"))


@query("SELECT 'json' AS class, count(DISTINCT (s_nationkey, s_suppkey // 1000)) AS n_files, 5 AS newest FROM supplier")
def a23_files(t: Tables) -> DataFrame:
    """Files by class of name, and the newest five."""
    path = _envelopes(t)
    newest = places.newest_files(t.spark, path).agg(F.count("*").cast("int").alias("newest"), F.lit("json").alias("class"))
    return places.dataset_inventory(t.spark, path, {"json": r"\.txt$"}).select("class", "n_files").join(newest, "class")


def _blocks(t: Tables, html: Column) -> DataFrame:
    """Parts as pages of their own."""
    return t.part.select("p_partkey", html.alias("html"))


def _around(*parts: str) -> Column:
    """Texts with the part's name for ``{n}`` and its price for ``{p}``."""
    price = F.concat((F.col("p_partkey") % 40 + 1).cast("string"), F.lit(".50"))
    out = F.lit("".join(parts))
    return F.replace(F.replace(out, F.lit("{n}"), F.concat(F.col("p_name"), F.lit(" "), _text("p_partkey"))), F.lit("{p}"), price)


NAMED = "SELECT p_partkey, p_name || ' ' || p_partkey AS name, (p_partkey % 40 + 1) || '.50' AS price FROM part"


@query(f"SELECT p_partkey, row_no, CASE row_no WHEN 0 THEN 'Dish' ELSE name END AS name, CASE row_no WHEN 1 THEN '$' || price END AS price FROM ({NAMED}) CROSS JOIN (VALUES (0), (1)) AS r(row_no)")
def p3_table_rows(t: Tables) -> DataFrame:
    """Rows of price tables."""
    html = _around("<table class='m'><tr><th>Dish</th><th>Price</th></tr><tr><td><b>{n}</b></td><td>hot</td><td>now ${p}!</td></tr><tr><td>alone</td></tr></table>")
    return extract.table_rows(_blocks(t, html), "p_partkey", "html")


@query(f"SELECT p_partkey, line_no, CASE line_no WHEN 1 THEN name ELSE 'Bread' END AS name, CASE line_no WHEN 1 THEN '$' || price END AS price FROM ({NAMED}) CROSS JOIN (VALUES (1), (2)) AS r(line_no)")
def p7_menu_text_items(t: Tables) -> DataFrame:
    """Items of plain menu lines below a header."""
    rows = t.part.select("p_partkey", F.posexplode(F.split(_around("STARTERS\n{n} .... ${p}\nBread"), "\n")).alias("line_no", "line"))
    return extract.menu_text_items(rows, "p_partkey")


@query(f"SELECT p_partkey, 0 AS pos, name, 'hot & fresh' AS description, '$' || price AS price FROM ({NAMED})")
def p9_class_blocks(t: Tables) -> DataFrame:
    """Items of elements by their class."""
    html = _around('<div class="x">no</div><div class="menu-item big"><h3>{n}</h3><p class="desc">hot &amp; <i>fresh</i></p><span>${p}</span></div>')
    return extract.class_blocks(_blocks(t, html), "p_partkey", "html")


NESTED = '<div class="menu-item"><div class="hd"><div><h3>{n}</h3></div></div><div class="desc">hot <div>&amp; <i>fresh</i></div> soup</div><div><div>${p}</div></div></div>'


@query(f"SELECT p_partkey, pos, CASE pos WHEN 0 THEN name WHEN 1 THEN name ELSE 'Tea' END AS name, CASE pos WHEN 2 THEN NULL ELSE 'hot & fresh soup' END AS description, CASE pos WHEN 2 THEN '$2' ELSE '$' || price END AS price FROM ({NAMED}) CROSS JOIN (VALUES (0), (1), (2)) AS r(pos)")
def p9_nested_blocks(t: Tables) -> DataFrame:
    """Items whose parts lie in elements of the same tag, within a section that has such a class as well."""
    html = _around('<!-- <div class="item"> --><section class="items">', NESTED, "<p>unclosed<li class='dish'><strong>Tea</strong> $2</section></div>")
    return extract.class_blocks(_blocks(t, html), "p_partkey", "html")


@query(f"SELECT p_partkey, list_no, item_no, CASE list_no WHEN 0 THEN CASE item_no WHEN 0 THEN name || ' $' || price ELSE 'Menu of the day: Tea $2Cake $3' END ELSE CASE item_no WHEN 0 THEN 'Tea $2' ELSE 'Cake $3' END END AS item FROM ({NAMED}) CROSS JOIN (VALUES (0), (1)) AS l(list_no) CROSS JOIN (VALUES (0), (1)) AS r(item_no)")
def p2_nested_lists(t: Tables) -> DataFrame:
    """Items of lists, and those of a list within an item."""
    html = _around("<ul><li>{n} <b>${p}</b></li><li>Menu of the day: <ul><li>Tea $2</li><li>Cake $3</li></ul></li></ul>")
    return extract.list_items(_blocks(t, html), "p_partkey", "html")


@query(f"SELECT p_partkey, row_no, CASE row_no WHEN 0 THEN name ELSE 'Tea' END AS name, CASE row_no WHEN 0 THEN '$' || price ELSE '$2' END AS price FROM ({NAMED}) CROSS JOIN (VALUES (0), (1)) AS r(row_no)")
def p3_nested_tables(t: Tables) -> DataFrame:
    """Rows of a table, and of one in a cell of it."""
    html = _around("<table><tr><td>{n}</td><td><table><tr><td>Tea</td><td>$2</td></tr></table></td><td>${p}</td></tr></table>")
    return extract.table_rows(_blocks(t, html), "p_partkey", "html")


@query(f"SELECT p_partkey, 0 AS pos, name, 'a d e' AS description, price FROM ({NAMED})")
def p11_nested_microdata(t: Tables) -> DataFrame:
    """Items whose properties lie deeper, with a price that is in an attribute."""
    html = _around('<div itemscope itemtype="http://schema.org/MenuItem"><div><div><span itemprop="name">{n}</span></div><div itemprop="description">a <div>d</div> e</div></div><div itemprop="offers"><meta itemprop="price" content="{p}"></div></div>')
    return extract.microdata_items(_blocks(t, html), "p_partkey", "html")


DEPTH = 30


@query(f"SELECT p_partkey, name, price FROM ({NAMED}) UNION ALL SELECT p_partkey, 'Tea', '2' FROM part")
def p10_thirty_steps(t: Tables) -> DataFrame:
    """Items of a schema.org menu thirty steps down, through lists and objects, and one within an item."""
    opens = "".join('{"a":[' if i % 2 else '{"b]":' for i in range(DEPTH))
    ends = "".join("]}" if i % 2 else ',"z":"\\"}{"}' for i in reversed(range(DEPTH)))
    item = '{"hasMenuItem":[[{"name":"{n}","offers":{"price":"{p}"},"x":{"hasMenuItem":{"name":"Tea","offers":[{"price":2}]}}}],"hasMenuItem",{"price":1}]}'
    html = _around('<script type="application/ld+json">', opens, item, ends, "</script>")
    return extract.jsonld_items_anywhere(_blocks(t, html), "p_partkey", "html").select("p_partkey", "name", "price")


JSONLD = ('<script type="application/ld+json">', '{"@type":"Restaurant","hasMenu":{"hasMenuSection":[{"name":"A","hasMenuItem":[{"name":"{n}","offers":{"price":"{p}"}},{"name":"Tea","offers":[{"price":"2"}]}]}]}}', "</script>")
DEEP = ('<script type="application/ld+json">', '{"@graph":[{"x":{"hasMenu":[{"hasMenuSection":{"hasMenuItem":{"name":"{n}","offers":{"price":"{p}"}}}}]}},{"hasMenuItem":[{"name":"Tea","description":"d"}]}]}', "</script>")


@query(f"SELECT p_partkey, CASE i WHEN 0 THEN name ELSE 'Tea' END AS name, CASE i WHEN 0 THEN price ELSE '2' END AS price FROM ({NAMED}) CROSS JOIN (VALUES (0), (1)) AS r(i)")
def p10_jsonld_items(t: Tables) -> DataFrame:
    """Items of schema.org menus on their known paths."""
    return extract.jsonld_items(_blocks(t, _around(*JSONLD)), "p_partkey", "html").select("p_partkey", "name", "price")


@query(f"SELECT p_partkey, CASE i WHEN 0 THEN name ELSE 'Tea' END AS name, CASE i WHEN 1 THEN 'd' END AS description, CASE i WHEN 0 THEN price END AS price FROM ({NAMED}) CROSS JOIN (VALUES (0), (1)) AS r(i)")
def p10_jsonld_anywhere(t: Tables) -> DataFrame:
    """Items of schema.org menus at any depth."""
    return extract.jsonld_items_anywhere(_blocks(t, _around(*DEEP)), "p_partkey", "html").select("p_partkey", "name", "description", "price")


@query(f"SELECT p_partkey, 0 AS pos, name, 'd' AS description, price FROM ({NAMED})")
def p11_microdata_items(t: Tables) -> DataFrame:
    """Items of elements by their itemtype."""
    html = _around('<div itemscope itemtype="http://schema.org/MenuItem"><span itemprop="name">{n}</span><p itemprop="description">d</p><b itemprop="price">{p}</b></div>')
    return extract.microdata_items(_blocks(t, html), "p_partkey", "html")


@query(f"SELECT p_partkey, 1 AS script_no, name, price FROM ({NAMED})")
def p12_embedded_items(t: Tables) -> DataFrame:
    """Items of lists in scripts of JSON."""
    html = _around('<script>var a = 1</script><script>', '{"products":[{"name":"{n}","price":"{p}"},{"price":1}]}', "</script>")
    return extract.embedded_items(_blocks(t, html), "p_partkey", "html").select("p_partkey", "script_no", "name", "price")


def _feed(t: Tables) -> tuple[DataFrame, str]:
    """Events as a stream of places, and a folder for its results."""
    path = new_path(t.spark, "feed")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = t.events.select(_text("user_id").alias("place_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("phone"), (F.col("event_id") % 4).alias("n_items"), "ts")
    rows.write.parquet(f"{path}/in")
    return t.spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path


def _ran(t: Tables, announce: bool = False) -> str:
    """The folder of a feed that has run over all events."""
    stream, path = _feed(t)
    feed = changes.change_feed(stream, ["phone", "n_items"], "n_items", announce)
    quality = lambda b: metrics.value_counts(b, F.col("field"), "field")
    changes.run_cycles(feed, f"{path}/out", f"{path}/checkpoint", metrics=quality).awaitTermination()
    return path


FEED = """
WITH e AS (SELECT user_id::VARCHAR AS place_id, event_id AS seq, event_type AS phone, (event_id % 4)::VARCHAR AS n_items, row_number() OVER w AS r, lag(event_type) OVER w AS p, lag((event_id % 4)::VARCHAR) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT place_id, 'updated' AS change_type, 'phone' AS field, p AS old_value, phone AS new_value, seq FROM e WHERE r > 1 AND p <> phone UNION ALL SELECT place_id, 'menu_changed', 'n_items', n, n_items, seq FROM e WHERE r > 1 AND n <> n_items)
"""


@query(f"{FEED} SELECT * FROM c")
def st1_change_feed(t: Tables) -> DataFrame:
    """Changes of places, event by event."""
    return t.spark.read.schema(changes.CHANGE).parquet(f"{_ran(t)}/out/changes/*")


@query(f"{FEED} SELECT change_type, count(*) AS n FROM (SELECT change_type FROM c UNION ALL SELECT 'new' FROM e WHERE r = 1) GROUP BY 1")
def st1_announced(t: Tables) -> DataFrame:
    """Changes by kind, where first sight is announced."""
    return t.spark.read.schema(changes.CHANGE).parquet(f"{_ran(t, True)}/out/changes/*").groupBy("change_type").agg(F.count("*").alias("n"))


@query(f"{FEED} SELECT field, count(*) AS n FROM c GROUP BY 1")
def st2_st4_quality_history(t: Tables) -> DataFrame:
    """Figures of each cycle, summed: all that was there, in one run."""
    found = t.spark.read.schema("field string, n long").parquet(f"{_ran(t)}/out/quality/*")
    return found.groupBy("field").agg(F.sum("n").alias("n"))


@query(f"{FEED} SELECT count(*) AS n_changes, count(*) FILTER (change_type = 'menu_changed') AS n_menu_changes FROM c")
def st5_update_counters(t: Tables) -> DataFrame:
    """Counters of all cycles."""
    found = t.spark.read.schema("n_changes long, n_menu_changes long").parquet(f"{_ran(t)}/out/counters/*")
    return found.agg(F.sum("n_changes").alias("n_changes"), F.sum("n_menu_changes").alias("n_menu_changes"))


@query("SELECT place_id, seq, phone, first_seen FROM (SELECT user_id::VARCHAR AS place_id, event_id AS seq, event_type AS phone, min(event_id) OVER (PARTITION BY user_id) AS first_seen, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def st3_cycle_rows(t: Tables) -> DataFrame:
    """The table of places after two cycles: each one's last row, and when it first came."""
    stream, path = _feed(t)
    rows = lambda df: df.select("place_id", "seq", "phone", F.col("seq").alias("first_seen"))
    half = t.spark.read.schema(stream.schema).parquet(f"{path}/in")
    late = f"{path}/halves"
    stream = t.spark.readStream.schema(half.schema).parquet(f"{late}/*")
    for i in range(2):
        half.filter(F.col("seq") % 2 == i).write.parquet(f"{late}/{i}")
        changes.run_rows(rows(stream), f"{path}/places", f"{path}/rows-checkpoint", "place_id", "seq", "first_seen").awaitTermination()
    return changes.PlaceTable(t.spark, f"{path}/places", "place_id").read("place_id string, seq long, phone string, first_seen long")


REMOVED = """
WITH e AS (SELECT user_id::VARCHAR AS place_id, event_id AS seq, event_type AS phone, event_type = 'error' AS gone, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT place_id, CASE WHEN gone THEN 'removed' WHEN p IS NULL OR p = 'error' THEN 'new' ELSE 'updated' END AS change_type, CASE WHEN NOT gone AND p <> 'error' THEN 'phone' END AS field,
  CASE WHEN NOT gone AND p <> 'error' THEN p END AS old_value, CASE WHEN NOT gone AND p <> 'error' THEN phone END AS new_value, seq
FROM e WHERE (gone AND p <> 'error') OR (NOT gone AND (p IS NULL OR p = 'error' OR p <> phone))
"""


@query(REMOVED)
def st1_removed(t: Tables) -> DataFrame:
    """A feed in which places go and come back: an error event removes its place."""
    path = new_path(t.spark, "removed")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = t.events.select(_text("user_id").alias("place_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("phone"), (F.col("event_type") == "error").alias("removed"))
    rows.write.parquet(f"{path}/in")
    feed = changes.change_feed(t.spark.readStream.schema(rows.schema).parquet(f"{path}/in"), ["phone"], announce=True)
    changes.run_cycles(feed, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.schema(changes.CHANGE).parquet(f"{path}/out/changes/*")


LATEST = "(SELECT user_id::VARCHAR AS place_id, arg_max(event_type, event_id) AS phone, arg_max((event_id % 4)::VARCHAR, event_id) AS n_items FROM events WHERE {} GROUP BY 1)"


@query(f"""
WITH o AS {LATEST.format("event_id % 3 = 0 AND user_id % 5 > 0")}, n AS {LATEST.format("TRUE")}, b AS (SELECT n.place_id, o.place_id IS NULL AS fresh, o.phone AS p, n.phone AS q, o.n_items AS i, n.n_items AS j FROM n LEFT JOIN o USING (place_id))
SELECT place_id, 'new' AS change_type, NULL AS field, NULL AS old_value, NULL AS new_value FROM b WHERE fresh
UNION ALL SELECT place_id, 'updated', 'phone', p, q FROM b WHERE p <> q UNION ALL SELECT place_id, 'menu_changed', 'n_items', i, j FROM b WHERE i <> j
""")
def st1_from_snapshot(t: Tables) -> DataFrame:
    """The feed of today's snapshot, begun on yesterday's: what the comparison of both tables gives. Some places are new."""
    path = new_path(t.spark, "from-snapshot")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    latest = lambda df: df.groupBy(_text("user_id").alias("place_id")).agg(F.max("event_id").alias("seq"), F.max_by("event_type", "event_id").alias("phone"), F.max_by(F.col("event_id") % 4, "event_id").alias("n_items"))
    old, new = latest(t.events.filter("event_id % 3 = 0 and user_id % 5 > 0")), latest(t.events)
    new.write.parquet(f"{path}/in")
    feed = changes.change_feed(t.spark.readStream.schema(new.schema).parquet(f"{path}/in"), ["phone", "n_items"], "n_items", announce=True, landed=old)
    changes.run_cycles(feed, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.schema(changes.CHANGE).parquet(f"{path}/out/changes/*").drop("seq")
