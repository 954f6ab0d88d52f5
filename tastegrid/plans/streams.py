"""Queries that replay a table as a stream, beside the SQL of their result in one go."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.plans.bindings import SCORES, now, observations
from tastegrid.session import settle
from tastegrid.streaming import streams as X





def str2_tumbling_counts(spark, d):
    e = X.stream(spark, d, "events")
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return X.replay(g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total"), "complete")


def str2_sliding_counts(spark, d):
    e = X.stream(spark, d, "events")
    g = e.groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return X.replay(g.select(F.col("w.start").alias("window_start"), "n"), "complete")


def str2_sessions(spark, d):
    e = X.stream(spark, d, "events")
    g = e.groupBy(F.session_window("ts", "8 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return X.replay(g.select("user_id", F.col("w.start").alias("session_start"), "n"), "complete")


def str3_first_deliveries(spark, d):
    r = X.stream(spark, d, "raw_reviews").select("source", "external_id", "ingested_at")
    out = X.replay(X.first_deliveries(r, "ingested_at", ["source", "external_id"], "400 days"))
    return out.groupBy("source").agg(F.count("*").alias("items"))


def str6_incremental_scores(spark, d):
    o = observations(spark, d)
    batches = [o.where("year(published_at) <= 1999"), o.where("year(published_at) = 2000"), o.where("year(published_at) >= 2001")]
    return X.incremental_scores(batches, now(), settle).select("dish_id", "restaurant_id", "city_id", "mention_count", "status", "score")


def str10_budgets(spark, d):
    e = X.stream(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("cost", F.ceil("value").cast("long"))
    return X.replay_updates(X.spent_budgets(e, "day", ["ts", "event_id"], "cost", 5000), "key")


_FNS = [str2_tumbling_counts, str2_sliding_counts, str2_sessions, str3_first_deliveries, str6_incremental_scores, str10_budgets]
QUERIES = {f.__name__: f for f in _FNS}

SQL = {
    "str2_tumbling_counts": "select time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all",
    "str2_sliding_counts": "select s as window_start, count(*) as n from (select unnest([time_bucket(interval 12 hours, ts, timestamp '1970-01-01'), time_bucket(interval 12 hours, ts, timestamp '1970-01-01') - interval 12 hours]) as s from events) group by all",
    "str2_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over w <= interval 8 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
      s as (select *, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g) select user_id, min(ts) as session_start, count(*) as n from s group by user_id, k""",
    "str3_first_deliveries": "select source, count(distinct external_id) as items from raw_reviews group by all",
    "str6_incremental_scores": f"with {SCORES} select dish_id, restaurant_id, city_id, mention_count, status, score from scores",
}
