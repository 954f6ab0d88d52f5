"""Further queries: filters, keyed states, orders, dates, arrays, JSON, alias indexes, event histories."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegrid.functions import numeric as N
from tastegrid.functions import text as T
from tastegrid.operators import scoring as S
from tastegrid.operators.profiles import profile_chips
from tastegrid.plans.bindings import OBS, SCORES, now, observations
from tastegrid.plans.texts import normal_sql, tokens_sql
from tastegrid.sources.tables import table as t
from tastegrid.streaming import streams as X

# fixed values: words that name no particular place
GENERIC = ["cafe", "bar", "grill", "bakery", "house", "stall", "kitchen", "canteen", "restaurant", "sweets", "snacks", "point", "centre", "corner", "hotel", "the", "new", "old", "royal", "and"]
HAV = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


def flt1_evidence(spark, d):
    return t(spark, d, "review_analysis").where(~F.col("is_spam") & F.col("restaurant_id").isNotNull()).select("raw_id", "restaurant_id")


def flt6_trend(spark, d):
    return t(spark, d, "dish_scores").where("trend = 'rising'").select("score_id", "dish_id")


def flt9_semi(spark, d):
    named = t(spark, d, "dishes").where("category = 'dessert'").select(F.col("id").alias("dish_id"))
    return t(spark, d, "dish_scores").join(named, "dish_id", "left_semi").groupBy("dish_id").agg(F.count("*").alias("n"))


def flt11_distances(spark, d):
    c = t(spark, d, "cities").select(F.col("id").alias("city_id"), F.col("lat").alias("a"), F.col("lng").alias("b"))
    r = t(spark, d, "restaurants").where("lat is not null and lng is not null").select("id", "city_id", "lat", "lng")
    return r.join(c, "city_id").select("id", F.round(N.haversine_m("a", "b", "lat", "lng"), 1).alias("distance_m"))


def prj1_badges(spark, d):
    b = S.badges(S.score_pairs(observations(spark, d), now()), 0.5, 0.3)
    names = F.array_compact(F.array(F.when(F.col("best_value"), "best_value"), F.when(F.col("most_consistent"), "most_consistent"), F.when(F.col("hidden_gem"), "hidden_gem")))
    return b.select(*S.PAIR, F.array_join(names, "|").alias("badges"))


def jn3_scores_dishes(spark, d):
    x = t(spark, d, "dishes").select(F.col("id").alias("dish_id"), "category")
    return t(spark, d, "dish_scores").join(x, "dish_id").groupBy("category", "status").agg(F.count("*").alias("n"), F.sum("mention_count").alias("mentions"))


def jn5_left_sort_key(spark, d):
    n = t(spark, d, "review_analysis").where("restaurant_id is not null").groupBy(F.col("restaurant_id").alias("id")).agg(F.count("*").alias("reviews"))
    return t(spark, d, "restaurants").join(n, "id", "left").orderBy(F.col("reviews").desc_nulls_last(), "id").limit(30).select("id", "reviews")


def jn9_three_way(spark, d):
    r, a = t(spark, d, "raw_reviews").select("raw_id", "author"), t(spark, d, "review_analysis").select("raw_id", "restaurant_id")
    p = t(spark, d, "restaurants").select(F.col("id").alias("restaurant_id"), "city_id")
    return r.join(a, "raw_id").join(p, "restaurant_id").groupBy("author").agg(F.countDistinct("restaurant_id").alias("places"), F.countDistinct("city_id").alias("cities"))


def agg25_dish_ids(spark, d):
    return t(spark, d, "dish_scores").where("city_id = 'ct-03'").select("dish_id").distinct().orderBy("dish_id").limit(200)


def snk6_upserted_trends(spark, d):
    x = t(spark, d, "trend_results").select("restaurant_id", "window_end", "recent_count", "trend_id")
    old, new = x.where("window_end < '2026-06-01' or window_end is null"), x.where("window_end >= '2026-05-01'")
    return S.upsert(old, new, ["restaurant_id", "window_end"]).select("trend_id", "recent_count")


def snk13_toggles(spark, d):
    """A toggle is on after an odd number of clicks."""
    e = t(spark, d, "events").where("event_type = 'click'").groupBy("user_id", (F.get_json_object("props", "$.k").cast("int")).alias("item")).agg((F.count("*") % 2).alias("on"))
    return e.groupBy("item").agg(F.sum("on").alias("likes"))


def snk14_first_of_nullable_keys(spark, d):
    return t(spark, d, "review_analysis").groupBy("restaurant_id", "language", "provider").agg(F.min("raw_id").alias("raw_id"))


def snk15_retained(spark, d):
    return t(spark, d, "events").where(~((F.col("event_type") == "view") & (F.col("ts") < "2024-01-16"))).groupBy("event_type").agg(F.count("*").alias("n"))


def srt4_by_similarity(spark, d):
    s = F.round(T.trigram_similarity(F.lit("royal noodle bar"), F.col("name")), 4)
    return t(spark, d, "restaurants").where("name is not null").select("id", s.alias("similarity")).orderBy(F.col("similarity").desc(), "id").limit(25)


def srt5_queue_order(spark, d):
    o = t(spark, d, "orders")
    w = W.partitionBy("o_orderstatus").orderBy(F.col("o_orderpriority").asc(), F.col("o_orderdate").asc(), "o_orderkey")
    return o.withColumn("place", F.row_number().over(w)).where("place <= 10").select("o_orderkey", "place")


def lim2_top_k(spark, d):
    return t(spark, d, "dish_scores").orderBy(F.col("mention_count").desc(), "score_id").limit(300).select("score_id", "mention_count")


def dat3_cutoffs(spark, d):
    end = F.lit("2026-08-15").cast("timestamp")
    at = F.col("published_at")
    age = F.when(at >= end - F.expr("interval 7 days"), "week").when(at >= end - F.expr("interval 60 days"), "two months").when(at.isNull(), "undated").otherwise("older")
    return t(spark, d, "raw_reviews").groupBy(age.alias("age")).agg(F.count("*").alias("n"))


def dat6_lastmod(spark, d):
    return t(spark, d, "documents").groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def arr2_clean_labels(spark, d):
    c = F.array_distinct(F.filter(F.transform("cuisines", lambda x: F.substring(F.replace(F.lower(F.btrim(x)), F.lit(" "), F.lit("_")), 1, 48)), lambda x: x != ""))
    return t(spark, d, "raw_places").where(F.size("cuisines") > 0).select("place_id", F.array_join(F.slice(c, 1, 12), "|").alias("labels"))


def jsn1_recovered_json(spark, d):
    """JSON inside other text: from the first brace to the last."""
    raw = F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n``` thanks"))
    j = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "k int")
    return t(spark, d, "events").select("event_id", j["k"].alias("k"))


def jsn4_cache_keys(spark, d):
    key = F.to_json(F.struct(F.col("name"), F.col("slug")))
    return t(spark, d, "cities").select("id", F.when(F.length(key) > 36, F.substring(F.sha2(key, 256), 1, 24)).otherwise(key).alias("key"))


def ext1_alias_index(spark, d):
    r = t(spark, d, "restaurants")
    names = r.where("name is not null").select(T.normalize_name("name").alias("alias"), "id", F.lit(1).alias("pri"))
    more = r.select("id", F.explode("aliases").alias("a")).select(T.normalize_name("a").alias("alias"), "id", F.lit(0).alias("pri"))
    return S.latest_per_key(names.unionByName(more).where("alias <> ''"), ["alias"], F.col("pri").asc(), F.col("id").asc()).select("alias", "id")


def res5_mentionable(spark, d):
    return t(spark, d, "restaurants").where(F.size(F.array_except(T.tokens("name"), F.array(*map(F.lit, GENERIC)))) > 0).select("id")


def str9_windowed_limits(spark, d):
    """Requests over the limit in windows that open at a user's first request after the last one closed, two hours long."""
    return X.refused_requests(t(spark, d, "events"), "user_id", "ts", "event_id", hours=2, limit=1)


def str14_reports(spark, d):
    """Users whose third error makes them flagged, with its time."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").where("event_type = 'error'").withColumn("rn", F.row_number().over(w)).where("rn = 3").select("user_id", F.col("ts").alias("flagged_at"))


def str16_last_actions(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_action"), F.count("*").alias("n"))


def fe2_sentiment_labels(spark, d):
    s = F.col("overall_sentiment")
    return t(spark, d, "review_analysis").where("overall_sentiment is not null and not isnan(overall_sentiment)").groupBy(F.when(s > 0.15, "positive").when(s < -0.15, "negative").otherwise("mixed").alias("label")).agg(F.count("*").alias("n"))


def fe6_marker_clusters(spark, d):
    cell = lambda c: F.floor(F.col(c) / 0.05)
    return t(spark, d, "restaurants").where("lat is not null and lng is not null").groupBy(cell("lat").alias("y"), cell("lng").alias("x")).agg(F.count("*").alias("n"))


def krn6_profiles(spark, d):
    o = observations(spark, d)
    dishes = o.groupBy("restaurant_id", "dish_id").agg(F.avg("sentiment").alias("s"), F.count("*").cast("int").alias("m"))
    dishes = dishes.groupBy("restaurant_id").agg(F.collect_list(F.struct(F.col("dish_id").alias("name"), F.col("s").alias("sentiment"), F.col("m").alias("mentions"))).alias("dishes"))
    labels = o.select("restaurant_id", F.explode("attributes").alias("a")).groupBy("restaurant_id", "a").agg(F.count("*").alias("c")).groupBy("restaurant_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "c"))).alias("attributes"))
    base = o.groupBy("restaurant_id", "city_id").agg(F.count("*").cast("int").alias("mentions"), F.avg("price").alias("price"), (1 - F.least(F.lit(1.0), F.stddev_pop("sentiment"))).alias("consistency"))
    base = base.join(S.medians(o, ["city_id"]), "city_id", "left").withColumn("price_ratio", F.col("price") / F.col("median_price"))
    x = base.join(dishes, "restaurant_id").join(labels, "restaurant_id", "left").join(S.trends(o, ["restaurant_id"], now()).select("restaurant_id", F.col("direction").alias("trend")), "restaurant_id", "left")
    x = x.withColumns({"aspects": F.create_map().cast("map<string,double>"), "cuisines": F.array().cast("array<string>")})
    return profile_chips(x, "restaurant_id").select("restaurant_id", F.array_join("chips", "|").alias("chips"))


def krn16_recommendations(spark, d):
    s = F.col("sentiment")
    return observations(spark, d).groupBy("dish_id", F.when(s >= 0.5, "yes").when(s <= -0.4, "no").alias("recommended")).agg(F.count("*").alias("n"))


_FNS = [
    flt1_evidence, flt6_trend, flt9_semi, flt11_distances, prj1_badges, jn3_scores_dishes, jn5_left_sort_key, jn9_three_way, agg25_dish_ids, snk6_upserted_trends, snk13_toggles, snk14_first_of_nullable_keys,
    snk15_retained, srt4_by_similarity, srt5_queue_order, lim2_top_k, dat3_cutoffs, dat6_lastmod, arr2_clean_labels, jsn1_recovered_json, jsn4_cache_keys, ext1_alias_index, res5_mentionable,
    str9_windowed_limits, str14_reports, str16_last_actions, fe2_sentiment_labels, fe6_marker_clusters, krn6_profiles, krn16_recommendations,
]
QUERIES = {f.__name__: f for f in _FNS}

_TRI = lambda c: f"list_distinct(flatten(list_transform({tokens_sql(c)}, lambda w: list_transform(range(1, cast(len(w) + 2 as bigint)), lambda i: substr('  ' || w || ' ', i, 3)))))"

SQL = {
    "flt1_evidence": "select raw_id, restaurant_id from review_analysis where not is_spam and restaurant_id is not null",
    "flt6_trend": "select score_id, dish_id from dish_scores where trend = 'rising'",
    "flt9_semi": "select dish_id, count(*) as n from dish_scores where dish_id in (select id from dishes where category = 'dessert') group by all",
    "flt11_distances": f"select b.id, round({HAV}, 1) as distance_m from restaurants b join cities a on a.id = b.city_id where b.lat is not null and b.lng is not null",
    "prj1_badges": f"""with {SCORES}, r as (select * from scores where status = 'ranked'), c as (select dish_id, count(*) as peers, list_sort(list(mention_count))[greatest(1, count(*) // 3)] as cutoff from r group by all),
      b as (select r.*, value_score is not null and row_number() over (partition by dish_id order by value_score is not null desc, value_score desc nulls last, restaurant_id, city_id) = 1 as bv,
        mention_count >= 5 and row_number() over (partition by dish_id order by mention_count >= 5 desc, consistency desc nulls last, restaurant_id, city_id) = 1 as mc,
        peers >= 3 and observed_positivity >= 0.5 and consistency >= 0.3 and mention_count <= cutoff as hg from r join c using (dish_id))
      select dish_id, restaurant_id, city_id, array_to_string(list_filter([case when bv then 'best_value' end, case when mc then 'most_consistent' end, case when hg then 'hidden_gem' end], lambda x: x is not null), '|') as badges from b""",
    "jn3_scores_dishes": "select category, status, count(*) as n, cast(sum(mention_count) as bigint) as mentions from dish_scores join dishes on id = dish_id group by all",
    "jn5_left_sort_key": "select id, reviews from restaurants left join (select restaurant_id as id, count(*) as reviews from review_analysis where restaurant_id is not null group by all) using (id) order by reviews desc nulls last, id limit 30",
    "jn9_three_way": "select author, count(distinct restaurant_id) as places, count(distinct p.city_id) as cities from raw_reviews join review_analysis using (raw_id) join restaurants p on p.id = restaurant_id group by all",
    "agg25_dish_ids": "select distinct dish_id from dish_scores where city_id = 'ct-03' order by dish_id limit 200",
    "snk6_upserted_trends": """with x as (select * from trend_results), n as (select * from x where window_end >= timestamptz '2026-05-01 00:00:00+00'), o as (select * from x where window_end < timestamptz '2026-06-01 00:00:00+00' or window_end is null)
      select trend_id, recent_count from o where not exists (select 1 from n where n.restaurant_id is not distinct from o.restaurant_id and n.window_end is not distinct from o.window_end) union all select trend_id, recent_count from n""",
    "snk13_toggles": "select item, cast(sum(n % 2) as bigint) as likes from (select user_id, cast(json_extract(props, '$.k') as int) as item, count(*) as n from events where event_type = 'click' group by all) group by item",
    "snk14_first_of_nullable_keys": "select restaurant_id, language, provider, min(raw_id) as raw_id from review_analysis group by all",
    "snk15_retained": "select event_type, count(*) as n from events where not (event_type = 'view' and ts < timestamp '2024-01-16') group by all",
    "srt4_by_similarity": f"select id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) as similarity from (select id, {_TRI(chr(39) + 'royal noodle bar' + chr(39))} as a, {_TRI('name')} as b from restaurants where name is not null) order by similarity desc, id limit 25",
    "srt5_queue_order": "select o_orderkey, cast(row_number() over (partition by o_orderstatus order by o_orderpriority, o_orderdate, o_orderkey) as int) as place from orders qualify place <= 10",
    "lim2_top_k": "select score_id, mention_count from dish_scores order by mention_count desc, score_id limit 300",
    "dat3_cutoffs": "select case when published_at >= timestamptz '2026-08-15 00:00:00+00' - interval 7 day then 'week' when published_at >= timestamptz '2026-08-15 00:00:00+00' - interval 60 day then 'two months' when published_at is null then 'undated' else 'older' end as age, count(*) as n from raw_reviews group by all",
    "dat6_lastmod": "select strftime(published_at, '%Y-%m-%d') as day, count(*) as n from documents group by all",
    "arr2_clean_labels": "select place_id, (select array_to_string(list(y order by i), '|') from (select y, min(i) as i from (select substr(replace(lower(trim(x)), ' ', '_'), 1, 48) as y, i from (select unnest(cuisines) as x, unnest(range(len(cuisines))) as i)) where y <> '' group by y)) as labels from raw_places where len(cuisines) > 0",
    "jsn1_recovered_json": "select event_id, cast(json_extract(props, '$.k') as int) as k from events",
    "jsn4_cache_keys": "select id, case when length(k) > 36 then substr(sha256(k), 1, 24) else k end as key from (select id, '{\"name\":\"' || name || '\",\"slug\":\"' || slug || '\"}' as k from cities)",
    "ext1_alias_index": f"with a as (select {normal_sql('name')} as alias, id, 1 as pri from restaurants where name is not null union all select {normal_sql('x')}, id, 0 from (select id, unnest(aliases) as x from restaurants)) select alias, id from a where alias <> '' qualify row_number() over (partition by alias order by pri, id) = 1",
    "res5_mentionable": f"select id from restaurants where len(list_filter({tokens_sql('name')}, lambda w: not list_contains({GENERIC}, w))) > 0",
    "str14_reports": "select user_id, ts as flagged_at from events where event_type = 'error' qualify row_number() over (partition by user_id order by ts, event_id) = 3",
    "str16_last_actions": "select user_id, arg_max(event_type, (ts, event_id)) as last_action, count(*) as n from events group by all",
    "fe2_sentiment_labels": "select case when overall_sentiment > 0.15 then 'positive' when overall_sentiment < -0.15 then 'negative' else 'mixed' end as label, count(*) as n from review_analysis where overall_sentiment is not null and not isnan(overall_sentiment) group by all",
    "fe6_marker_clusters": "select cast(floor(lat / 0.05::double) as bigint) as y, cast(floor(lng / 0.05::double) as bigint) as x, count(*) as n from restaurants where lat is not null and lng is not null group by all",
    "krn16_recommendations": f"with {OBS} select dish_id, case when sentiment >= 0.5 then 'yes' when sentiment <= -0.4 then 'no' end as recommended, count(*) as n from obs group by all",
}
