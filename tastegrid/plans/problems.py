"""Queries of the general problems: points near points or regions, late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.operators.geo_near import near_pairs, points_in_regions
from tastegrid.operators.late_events import window_counts
from tastegrid.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "raw_places").select("place_id", "lat", "lng")
    near = near_pairs(places, "place_id", 40.0)
    inside = points_in_regions(places, "place_id", table(spark, d, "cities"), "id")
    return near.select(F.lit("near").alias("kind"), "id_a", "id_b").unionByName(inside.select(F.lit("inside").alias("kind"), F.col("region_id").alias("id_a"), F.col("id").alias("id_b")))


def trend_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every trend row with the count its window should have."""
    reviews = table(spark, d, "raw_reviews").select("raw_id", "source", "external_id", "published_at", "ingested_at")
    solved = table(spark, d, "review_analysis").where("restaurant_id is not null").select("raw_id", "restaurant_id").distinct()
    trends = table(spark, d, "trend_results").select("trend_id", "restaurant_id", "window_end", "recent_count")
    counts = window_counts(reviews.join(solved, "raw_id"), trends, "restaurant_id", ["source", "external_id"], "published_at", "ingested_at", "trend_id", "window_end")
    return trends.join(counts, "trend_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return trend_counts(spark, d).where("recent_count is null or recent_count <> n").select("trend_id")


def p5_corrected_counts(spark: SparkSession, d: str) -> DataFrame:
    return trend_counts(spark, d).groupBy("window_end").agg(F.count("*").alias("windows"), F.sum("n").alias("events"), F.sum(F.when(F.col("recent_count").eqNullSafe(F.col("n")), 0).otherwise(1)).alias("wrong"))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_corrected_counts": p5_corrected_counts}

_HAV = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
_OK = "lat between -90 and 90 and lng between -180 and 180 and not (lat = 0 and lng = 0) and not isnan(lat) and not isnan(lng)"

_COUNTS = """
counts as (
  select t.trend_id, any_value(t.window_end) as window_end, any_value(t.recent_count) as recent_count, count(distinct (r.source, r.external_id)) filter (where r.raw_id is not null) as n
  from trend_results t left join (
    select distinct a.restaurant_id, v.raw_id, v.source, v.external_id, v.published_at, v.ingested_at
    from review_analysis a join raw_reviews v using (raw_id) where v.published_at <= v.ingested_at) r
  on r.restaurant_id = t.restaurant_id and r.published_at >= t.window_end - interval 60 day and r.published_at < t.window_end
   and r.ingested_at < t.window_end + interval 14 day
  group by t.trend_id)"""

SQL = {
    "p2_found": f"""
with p as (select place_id, lat, lng from raw_places where {_OK})
select 'near' as kind, least(a.place_id, b.place_id) as id_a, greatest(a.place_id, b.place_id) as id_b
from p a join p b on b.lat between a.lat - 0.0004 and a.lat + 0.0004 and a.place_id < b.place_id where {_HAV} <= 40
union all
select 'inside', a.id, b.place_id from (select id, lat, lng, radius_m from cities where {_OK}) a join p b on {_HAV} <= a.radius_m""",
    "p5_found": f"with {_COUNTS} select trend_id from counts where recent_count is null or recent_count <> n",
    "p5_corrected_counts": f"with {_COUNTS} select window_end, count(*) as windows, cast(sum(n) as bigint) as events, cast(sum(case when recent_count is not distinct from n then 0 else 1 end) as bigint) as wrong from counts group by window_end",
}
