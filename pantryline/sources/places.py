"""Place records of several sources to one schema; page tables; snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryline.functions import text

PAYMENT = {"payment:cash": "cash", "payment:credit_cards": "credit_cards", "payment:debit_cards": "debit_cards", "payment:contactless": "contactless", "payment:apple_pay": "apple_pay", "payment:google_pay": "google_pay"}
DIET = {"diet:vegetarian": "vegetarian", "diet:vegan": "vegan", "diet:gluten_free": "gluten_free", "diet:halal": "halal", "diet:kosher": "kosher"}


def _struct(**fields: str) -> str:
    return "struct<" + ",".join(f"`{k}`:{v}" for k, v in fields.items()) + ">"


PLACE_JSON = _struct(id="string", name="string", latitude="double", longitude="double", address="string", phone="string", website="string", url="string", cuisine="string", rating="double", review_count="int", opening_hours="string")


def read_places_json(spark: SparkSession, path: str, record: str = PLACE_JSON) -> DataFrame:
    """SRC1. Records of an envelope (restaurants, all_restaurants, merged_restaurants, summary.restaurants) or a bare list.

    ``source_pos``: the place in the list. A file is one document, as the source writes it.
    """
    many = f"array<{record}>"
    schema = _struct(restaurants=many, all_restaurants=many, merged_restaurants=many, summary=_struct(restaurants=many))
    docs = spark.read.text(path, wholetext=True)
    one = F.from_json("value", schema)
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", many))
    rows = docs.select(F.coalesce(listed, one["restaurants"], one["all_restaurants"], one["merged_restaurants"], one["summary"]["restaurants"]).alias("r"))
    return rows.select(F.posexplode("r").alias("source_pos", "p")).select("source_pos", "p.*")


def latest_snapshot(spark: SparkSession, path: str, patterns: tuple[str, ...] = ("comprehensive.*menus", "merged", "restaurants")) -> str | None:
    """SRC2. The newest file by the first name pattern that any has. Only names and times are read."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.coalesce(*(F.when(name.rlike(p), i) for i, p in enumerate(patterns)))
    row = files.withColumn("_r", rank).filter("_r is not null").orderBy("_r", F.desc("modificationTime"), "path").select("path").first()
    return row["path"] if row else None


OSM = "elements array<struct<type:string,id:bigint,timestamp:string,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"


def normalise_osm(df: DataFrame, keep_nameless: bool = False, keep_unplaced: bool = True) -> DataFrame:
    """SRC3. Elements (``elements`` column) to places. A way takes its centre. Nameless ones go, or are called Unknown.

    ``keep_unplaced``: whether named ones without coordinates stay, with null ones.
    """
    e = df.select(F.posexplode("elements").alias("source_pos", "e")).select("source_pos", "e.*")
    t = lambda k: F.nullif(F.try_element_at("tags", F.lit(k)), F.lit(""))
    lat, lon = F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon")
    out = e.select(
        F.concat_ws("_", F.lit("osm"), "type", "id").alias("place_id"),
        F.lit("OpenStreetMap").alias("source"),
        F.col("source_pos").cast("long").alias("source_pos"),
        (F.coalesce(t("name"), F.lit("Unknown")) if keep_nameless else t("name")).alias("name"),
        lat.alias("lat"),
        lon.alias("lon"),
        text.build_address(t("addr:housenumber"), t("addr:street"), t("addr:city"), t("addr:state"), t("addr:postcode")).alias("address"),
        t("phone").alias("phone"),
        t("website").alias("website"),
        t("email").alias("email"),
        F.coalesce(t("cuisine"), F.lit("unknown")).alias("cuisine"),
        F.coalesce(t("amenity"), F.lit("restaurant")).alias("amenity"),
        *(t(x).alias(x) for x in ("opening_hours", "wheelchair", "outdoor_seating", "takeaway", "delivery")),
        text.tag_flags(F.col("tags"), PAYMENT).alias("payment_methods"),
        text.tag_flags(F.col("tags"), DIET).alias("dietary_options"),
        F.col("timestamp").try_cast("timestamp").alias("last_modified"),
    )
    named = out.filter("name is not null")
    return named if keep_unplaced else named.filter("lat is not null and lon is not null")


YELP = "id string, name string, rating double, review_count int, price string, phone string, url string, is_closed boolean, categories array<struct<alias:string,title:string>>, location struct<display_address:array<string>,city:string,state:string,zip_code:string>, coordinates struct<latitude:double,longitude:double>"


def normalise_yelp(df: DataFrame) -> DataFrame:
    """SRC4. Business records to places."""
    return df.select(
        F.concat(F.lit("yelp_"), "id").alias("place_id"),
        F.lit("Yelp").alias("source"),
        "name",
        F.col("coordinates.latitude").alias("lat"),
        F.col("coordinates.longitude").alias("lon"),
        F.array_join("location.display_address", ", ").alias("address"),
        F.col("location.city").alias("city"),
        F.col("location.state").alias("state"),
        F.col("location.zip_code").alias("postcode"),
        "phone",
        F.col("url").alias("website"),
        F.transform("categories", lambda c: c["title"]).alias("categories"),
        "rating",
        "review_count",
        F.col("price").alias("price_tier"),
        "is_closed",
    )


FOURSQUARE = "id string, name string, categories array<struct<name:string>>, location struct<formattedAddress:array<string>,lat:double,lng:double,city:string,state:string,postalCode:string>, contact struct<phone:string,formattedPhone:string>, url string, stats struct<checkinsCount:int,usersCount:int,tipCount:int>, rating double, price struct<tier:int>"


def normalise_foursquare(df: DataFrame) -> DataFrame:
    """SRC5. Venue records to places; ratings of ten stay as they are."""
    return df.select(
        F.concat(F.lit("fsq_"), "id").alias("place_id"),
        F.lit("Foursquare").alias("source"),
        "name",
        F.col("location.lat").alias("lat"),
        F.col("location.lng").alias("lon"),
        F.array_join("location.formattedAddress", ", ").alias("address"),
        F.col("location.city").alias("city"),
        F.col("location.state").alias("state"),
        F.col("location.postalCode").alias("postcode"),
        text.first_present(F.col("contact.formattedPhone"), F.col("contact.phone")).alias("phone"),
        F.col("url").alias("website"),
        F.transform("categories", lambda c: c["name"]).alias("categories"),
        "rating",
        F.col("stats.tipCount").alias("review_count"),
        F.repeat(F.lit("$"), F.col("price.tier")).alias("price_tier"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC6. Landed pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def dataset_inventory(spark: SparkSession, path: str, classes: dict[str, str]) -> DataFrame:
    """A23. Files by class of name (label: pattern): number, bytes, and the newest file's time."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    label: Column = F.coalesce(*(F.when(name.rlike(p), F.lit(x)) for x, p in classes.items()), F.lit("other"))
    return files.groupBy(label.alias("class")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))


def newest_files(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """A23. The ``n`` newest files: path, bytes, time; of one time the first by path."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return files.orderBy(F.desc("modified"), "path").limit(n)


def dataset_rows(spark: SparkSession, path: str) -> DataFrame:
    """A23. (path, n_rows) of each file of JSON: the records of its envelope or list; an envelope that only counts them counts. Null for
    what is neither."""
    schema = _struct(restaurants="array<variant>", merged_restaurants="array<variant>", total_restaurants="bigint")
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("value"))
    one = F.from_json("value", schema)
    size = lambda c: F.when(c.isNotNull(), F.size(c))
    listed = F.when(F.startswith("value", F.lit("[")), size(F.from_json("value", "array<variant>")))
    return docs.select("path", F.coalesce(listed, size(one["restaurants"]), size(one["merged_restaurants"]), one["total_restaurants"]).cast("long").alias("n_rows"))
