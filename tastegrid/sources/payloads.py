"""Landed payloads of the sources as tables: map elements, posts, comment threads, lattices of search cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.numeric import haversine_m
from tastegrid.functions.text import clean_text

ELEMENT = "type string, id string, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
THREAD = "id string, snippet struct<topLevelComment:struct<snippet:struct<textDisplay:string,authorDisplayName:string,publishedAt:string,updatedAt:string,likeCount:int>>>"


def map_elements(payloads: DataFrame, json: str = "json") -> DataFrame:
    """Places from map elements, one JSON document a row. Elements without name or position, and broken documents, give none."""
    e = payloads.select(F.from_json(json, ELEMENT).alias("e")).select("e.*")
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    cuisines = F.filter(F.transform(F.split(F.coalesce(tag("cuisine"), F.lit("")), ";"), lambda x: F.replace(F.btrim(x), F.lit("_"), F.lit(" "))), lambda x: x != "")
    return e.select(
        F.concat_ws("/", "type", "id").alias("external_id"), F.btrim(tag("name")).alias("name"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lng"),
        F.when(tag("amenity") == "cafe", F.array_union(cuisines, F.array(F.lit("cafe")))).otherwise(cuisines).alias("cuisines"),
        F.nullif(F.concat_ws(", ", F.nullif(F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street")), F.lit("")), tag("addr:suburb")), F.lit("")).alias("address"),
        F.substring(F.btrim(F.element_at(F.split(tag("phone"), ";"), 1)), 1, 40).alias("phone"),
    ).where("length(name) > 0 and lat is not null and lng is not null")


# fixed values: price words of the places API, cheapest first
PRICE_WORDS = ["PRICE_LEVEL_INEXPENSIVE", "PRICE_LEVEL_MODERATE", "PRICE_LEVEL_EXPENSIVE", "PRICE_LEVEL_VERY_EXPENSIVE"]
API_PLACE = "id string, displayName struct<text:string>, formattedAddress string, location struct<latitude:double,longitude:double>, rating double, userRatingCount int, priceLevel string, websiteUri string, businessStatus string"


def api_places(payloads: DataFrame, keep: list[str], json: str = "json") -> DataFrame:
    """(kept columns, external_id, name, address, lat, lng, rating, rating_count, price_level, website). Items without id, name
    or position, those closed for good, and broken documents give none; unknown price words give a null level."""
    p = payloads.select(*keep, F.from_json(json, API_PLACE).alias("p")).select(*keep, "p.*")
    level = F.array_position(F.array(*map(F.lit, PRICE_WORDS)), F.col("priceLevel")).cast("int")
    p = p.where("id is not null and trim(displayName.text) <> '' and location.latitude is not null and location.longitude is not null and coalesce(businessStatus, '') <> 'CLOSED_PERMANENTLY'")
    return p.select(
        *keep, F.col("id").alias("external_id"), F.col("displayName.text").alias("name"), F.col("formattedAddress").alias("address"), F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lng"),
        "rating", F.col("userRatingCount").alias("rating_count"), F.nullif(level, F.lit(0)).alias("price_level"), F.col("websiteUri").alias("website"),
    )


def posts_to_reviews(posts: DataFrame, least: int = 40) -> DataFrame:
    """posts: id, title, body, created (epoch seconds), author, score. Removed and short ones are left out."""
    body = F.when(F.lower(F.btrim("body")).isin("[deleted]", "[removed]"), F.lit(None)).otherwise(clean_text("body"))
    rows = posts.select(F.concat(F.lit("t3_"), F.col("id").cast("string")).alias("external_id"), body.alias("text"), F.timestamp_seconds("created").alias("published_at"), "author", F.col("score").alias("engagement"))
    return rows.where(F.length("text") >= least)


def threads_to_reviews(payloads: DataFrame, json: str = "json") -> DataFrame:
    t = payloads.select(F.from_json(json, THREAD).alias("t")).select("t.id", "t.snippet.topLevelComment.snippet.*")
    return t.select(F.concat(F.lit("yt:"), "id").alias("external_id"), F.col("textDisplay").alias("text"), F.col("authorDisplayName").alias("author"), first_time("publishedAt", "updatedAt").alias("published_at"), F.coalesce("likeCount", F.lit(0)).alias("engagement")).where("length(text) > 0")


def first_time(*columns: str) -> Column:
    """The first that reads as a time."""
    return F.coalesce(*[F.try_to_timestamp(F.col(c)) for c in columns])


def cells(centres: DataFrame, radius: str, cell_m: float, offset: float = 0.0, inner_m: float = 0.0) -> DataFrame:
    """A square lattice of cell_m over each centre's circle: (id, row, col, lat, lng); cells nearer than inner_m are left out.

    offset moves the lattice by a share of a cell."""
    lat_step = F.degrees(F.lit(cell_m / 6_371_000.0))
    lng_step = lat_step / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    n = F.ceil(F.col(radius) / cell_m).cast("int")
    g = centres.select("id", F.col("lat").alias("lat0"), F.col("lng").alias("lng0"), F.col(radius).alias("r"), lat_step.alias("dy"), lng_step.alias("dx"), F.explode(F.sequence(-n, n)).alias("row"), n.alias("n"))
    g = g.withColumn("col", F.explode(F.sequence(-F.col("n"), F.col("n"))))
    g = g.withColumns({"lat": F.col("lat0") + (F.col("row") + offset) * F.col("dy"), "lng": F.col("lng0") + (F.col("col") + offset) * F.col("dx")})
    d = haversine_m("lat0", "lng0", "lat", "lng")
    return g.where((d <= F.col("r")) & (d >= inner_m)).select("id", "row", "col", "lat", "lng")
