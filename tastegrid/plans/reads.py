"""Queries of scans, source mappers, filters, joins, sorts, pages and set operations over the domain's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegrid.functions import numeric as N
from tastegrid.functions import text as T
from tastegrid.plans.texts import clean_sql
from tastegrid.sources import payloads as P
from tastegrid.sources.tables import table

# fixed values: words that show that a post is about food
FOOD_CUES = ["biryani", "momo", "kebab", "dosa", "curry", "thali", "menu", "plate"]


def t(spark, d, name):
    return table(spark, d, name)


def src1_scan(spark, d):
    return t(spark, d, "dishes").select("id", "slug", "name", "category", "is_veg")


def src3_map_elements(spark, d):
    p = t(spark, d, "raw_places").where("source = 'osm'")
    tags = F.map_filter(F.create_map(*[x for k, v in (("name", "name"), ("addr:street", "address"), ("addr:suburb", "area"), ("phone", "phone")) for x in (F.lit(k), F.col(v))], F.lit("cuisine"), F.array_join("cuisines", ";")), lambda k, v: v.isNotNull())
    parts = F.split("external_id", "/")
    json = F.to_json(F.struct(parts[0].alias("type"), parts[1].alias("id"), "lat", F.col("lng").alias("lon"), tags.alias("tags")))
    out = P.map_elements(p.select(json.alias("json")))
    return out.groupBy("external_id").agg(F.max("name").alias("name"), F.max("address").alias("address"), F.max("phone").alias("phone"), F.max(F.array_join("cuisines", "|")).alias("cuisines"), F.count("*").alias("n"))


def src6_relevant_posts(spark, d):
    docs = t(spark, d, "documents").join(F.broadcast(t(spark, d, "cities").select(F.col("id").alias("city_id"), F.lower("name").alias("city"))), "city_id")  # cities: a fixed list
    low = F.lower("text")
    cue = F.exists(F.array(*map(F.lit, FOOD_CUES)), lambda c: F.contains(low, c))
    return docs.where(cue & (F.contains(low, F.col("city")) | (F.col("source") == "reddit"))).select("doc_id")


def src7_posts_to_reviews(spark, d):
    docs = t(spark, d, "documents").where("source = 'reddit'").select(F.col("doc_id").alias("id"), "title", F.col("text").alias("body"), F.unix_seconds("published_at").alias("created"), F.lit("x").alias("author"), F.lit(0).alias("score"))
    return P.posts_to_reviews(docs).select("external_id", F.length("text").alias("chars"), "published_at")


def src10_threads(spark, d):
    r = t(spark, d, "raw_reviews").where("source = 'youtube'")
    s = F.struct(F.col("text").alias("textDisplay"), F.col("author").alias("authorDisplayName"), F.lit("not a time").alias("publishedAt"), F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updatedAt"), F.col("engagement").alias("likeCount"))
    json = F.to_json(F.struct(F.col("raw_id").alias("id"), F.struct(F.struct(s.alias("snippet")).alias("topLevelComment")).alias("snippet")))
    return P.threads_to_reviews(r.select(json.alias("json"))).select("external_id", "author", "published_at", "engagement")


def src11_swept_places(spark, d):
    p = t(spark, d, "raw_places").where("source = 'google'")
    return p.groupBy("external_id").agg(F.count("*").alias("fetches"), F.max("fetched_at").alias("last_fetch"), F.max("rating_count").alias("rating_count"))


def src12_lattice(spark, d):
    return P.cells(t(spark, d, "cities"), "radius_m", 1000.0).groupBy("id").agg(F.count("*").alias("cells"))


def src13_two_zones(spark, d):
    c = t(spark, d, "cities").withColumn("fine", F.least(F.col("radius_m"), F.lit(4000)))
    fine = P.cells(c, "fine", 300.0).withColumn("zone", F.lit("fine"))
    coarse = P.cells(c.where("radius_m > 4000"), "radius_m", 1000.0, 0.5, 4000.001).withColumn("zone", F.lit("coarse"))
    return fine.unionByName(coarse).groupBy("id", "zone").agg(F.count("*").alias("cells"))


def src15_alias_groups(spark, d):
    r = t(spark, d, "restaurants").select("id", "name", F.explode("aliases").alias("alias")).where("alias <> name")
    return r.groupBy("id", "name").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"))


def src16_new_aliases(spark, d):
    known = t(spark, d, "restaurants").select(F.col("id").alias("restaurant_id"), F.col("normalized_name").alias("alias"))
    more = t(spark, d, "restaurants").select(F.col("id").alias("restaurant_id"), F.explode("aliases").alias("a")).select("restaurant_id", T.normalize_name("a").alias("alias"))
    return more.where("alias <> ''").distinct().join(known, ["restaurant_id", "alias"], "left_anti")


def src20_first_claims(spark, d):
    w = W.partitionBy("alias").orderBy("id")
    return t(spark, d, "dishes").where("name is not null").withColumn("alias", T.normalize_name("name")).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("alias", "id")


def flt3_price_range(spark, d):
    return t(spark, d, "dish_scores").where(F.col("price_avg").between(100, 250) & ~F.isnan("price_avg")).select("score_id", "price_avg")


def flt4_ilike(spark, d):
    return t(spark, d, "raw_places").where(F.ilike("name", F.lit("%noodle%bar%"))).select("place_id", "name")


def flt5_prefix(spark, d):
    return t(spark, d, "restaurants").where(F.startswith("normalized_name", F.lit("royal"))).select("id")


def flt7_membership(spark, d):
    return t(spark, d, "raw_places").where(F.array_contains("cuisines", "bakery")).select("place_id")


def flt8_three_valued(spark, d):
    return t(spark, d, "dishes").where(F.col("is_veg").isNull() | F.col("is_veg")).select("id", "is_veg")


def flt10_radius(spark, d):
    box = F.col("lat").between(22.571 - 0.05, 22.571 + 0.05) & F.col("lng").between(88.362 - 0.055, 88.362 + 0.055)  # reaches the scan
    dist = N.haversine_m(F.lit(22.571), F.lit(88.362), "lat", "lng")
    return t(spark, d, "restaurants").where(box).where(dist <= 5000).select("id", F.round(dist, 1).alias("distance_m"))


def flt12_like(spark, d):
    return t(spark, d, "raw_reviews").where(F.col("external_id").like("yt:%") & F.col("external_id").like("%#c:%")).groupBy("source").agg(F.count("*").alias("n"))


def prj2_markers(spark, d):
    return t(spark, d, "restaurants").where("lat is not null and lng is not null").select("id", "city_id", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"))


def prj3_labels(spark, d):
    return t(spark, d, "dish_scores").select(F.explode("top_attributes").alias("a")).groupBy(F.initcap(F.replace("a", F.lit("_"), F.lit(" "))).alias("label")).agg(F.count("*").alias("n"))


def jn1_reviews_analysis(spark, d):
    r, a = t(spark, d, "raw_reviews"), t(spark, d, "review_analysis")
    return r.join(a, "raw_id").groupBy("source", "language").agg(F.count("*").alias("n"), F.round(F.sum("overall_sentiment"), 3).alias("sentiment"))


def jn2_scores_restaurants(spark, d):
    s, r = t(spark, d, "dish_scores"), t(spark, d, "restaurants").select(F.col("id").alias("restaurant_id"), "name")
    return s.where("status = 'ranked'").join(r, "restaurant_id").groupBy("restaurant_id", "name").agg(F.count("*").alias("n"), F.max("mention_count").alias("most"))


def jn4_left_composite(spark, d):
    s = t(spark, d, "dish_scores").groupBy("dish_id", "restaurant_id").agg(F.max("mention_count").alias("mentions"))
    a = t(spark, d, "review_analysis").where("restaurant_id is not null").groupBy("restaurant_id").agg(F.count("*").alias("reviews"))
    return s.join(a, "restaurant_id", "left").select("dish_id", "restaurant_id", "mentions", F.coalesce("reviews", F.lit(0)).alias("reviews"))


def jn6_left_counts(spark, d):
    c, p = t(spark, d, "cities").select(F.col("id").alias("city_id"), "name"), t(spark, d, "restaurants").select("city_id", "id")
    return c.join(p, "city_id", "left").groupBy("city_id", "name").agg(F.count("id").alias("restaurants"))


def jn7_unscored(spark, d):
    return t(spark, d, "restaurants").select(F.col("id").alias("restaurant_id")).join(t(spark, d, "dish_scores"), "restaurant_id", "left_anti")


def jn8_sources_of_restaurants(spark, d):
    r = t(spark, d, "restaurants").select("id", F.explode("source_keys").alias("k"))
    p = t(spark, d, "raw_places").select("source", "external_id").distinct()
    j = r.join(p, (F.col("k.source") == p.source) & (F.col("k.external_id") == p.external_id))
    return j.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "k.source", "k.external_id"))), "|").alias("keys"))


def jn14_without_analysis(spark, d):
    return t(spark, d, "raw_reviews").select("raw_id").join(t(spark, d, "review_analysis"), "raw_id", "left_anti")


def agg14_totals(spark, d):
    s = t(spark, d, "dish_scores").where("status = 'ranked'").select("city_id", "dish_id").distinct()
    return s.agg(F.count("*").alias("total"))


def agg16_event_points(spark, d):
    e = t(spark, d, "events")
    points = F.when(F.col("event_type") == "purchase", 10).when(F.col("event_type") == "signup", 5)
    return e.groupBy("user_id").agg(F.coalesce(F.sum(points), F.lit(0)).alias("points"))


def agg17_counters(spark, d):
    return t(spark, d, "raw_reviews").groupBy("author").agg(F.count("*").alias("reviews"), F.count("published_at").alias("dated"), F.countDistinct("source").alias("sources"))


def agg21_kind_sums(spark, d):
    e = t(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.round(F.sum("value"), 2))
    return e


def agg22_dish_means(spark, d):
    return t(spark, d, "dish_scores").where("status = 'ranked' and score between 0 and 100").groupBy("dish_id").agg(F.round(F.avg("score"), 4).alias("score"))


def agg24_bounds(spark, d):
    return t(spark, d, "restaurants").groupBy("city_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))


def agg26_actions(spark, d):
    p = t(spark, d, "raw_places")
    first = F.row_number().over(W.partitionBy("source", "external_id").orderBy("place_id")) == 1
    rows = p.select("source", F.when(F.col("name").isNull(), "skipped").when(first, "created").otherwise("updated").alias("action"))
    return rows.groupBy("source").agg(F.count("*").alias("seen"), F.count_if(F.col("action") == "created").alias("created"), F.count_if(F.col("action") == "updated").alias("updated"), F.count_if(F.col("action") == "skipped").alias("skipped"))


def srt2_nearest(spark, d):
    dist = N.haversine_m(F.lit(22.571), F.lit(88.362), "lat", "lng")
    return t(spark, d, "restaurants").where("lat is not null and lng is not null").select("id", F.round(dist, 1).alias("distance_m")).orderBy("distance_m", "id").limit(50)


def srt3_largest_moves(spark, d):
    m = t(spark, d, "trend_results").where("delta is not null and not isnan(delta)")
    return m.orderBy(F.col("significant").desc(), F.abs("delta").desc_nulls_last(), "trend_id").limit(20).select("trend_id", "delta")


def lim1_page(spark, d):
    return t(spark, d, "restaurants").orderBy("normalized_name", "id").offset(40).limit(20).select("id", "normalized_name")


def lim3_buckets(spark, d):
    s = t(spark, d, "dish_scores").where("dish_id = 'ds-000000002'")
    bucket = F.when(F.col("status") == "ranked", "ranked").otherwise("rest")
    order = W.partitionBy("bucket").orderBy(F.nanvl("score", F.lit(None).cast("double")).desc_nulls_last(), "score_id")
    return s.withColumn("bucket", bucket).withColumn("place", F.row_number().over(order)).select("score_id", "bucket", "place")


def set2_suggestions(spark, d):
    a = t(spark, d, "dishes").where(F.startswith(F.lower("name"), F.lit("c"))).select(F.lit("dish").alias("kind"), "id", "name")
    b = t(spark, d, "restaurants").where(F.startswith("normalized_name", F.lit("c"))).select(F.lit("place").alias("kind"), "id", "name")
    return a.unionByName(b)


def set3_shared_words(spark, d):
    words = lambda n, c: t(spark, d, n).select(F.explode(T.token_set(c)).alias("w")).distinct()
    return words("restaurants", "name").intersect(words("dishes", "name"))


def set4_new_words(spark, d):
    words = lambda n, c: t(spark, d, n).select(F.explode(T.token_set(c)).alias("w")).distinct()
    return words("dishes", "name").subtract(words("restaurants", "name"))


def dat1_ages(spark, d):
    return t(spark, d, "raw_reviews").select("raw_id", F.floor(N.age_days("published_at", F.lit("2026-08-15").cast("timestamp"))).alias("age"))


def dat2_months(spark, d):
    return t(spark, d, "raw_reviews").groupBy(F.date_format("published_at", "yyyy-MM").alias("month"), "source").agg(F.count("*").alias("n"))


def dat4_bucket_keys(spark, d):
    hour = F.floor(F.hour("ts") / 6) * 6
    key = F.concat(F.col("event_type"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.lpad(hour.cast("string"), 2, "0"))
    return t(spark, d, "events").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def mth2_decay(spark, d):
    return t(spark, d, "dish_scores").where("recency_days is not null and not isnan(recency_days)").select("score_id", F.round(N.half_life_decay("recency_days"), 6).alias("decay"), F.round(N.log_saturation("mention_count", 50), 6).alias("volume"), F.round(N.shrink("observed_positivity", "evidence_weight", F.lit(0.62)), 6).alias("shrunk"))


def mth5_spread(spark, d):
    return t(spark, d, "dish_scores").where("score between 0 and 100").groupBy("city_id").agg(F.round(F.stddev_pop("score"), 6).alias("sd"), F.round(F.median("score"), 6).alias("median"))


def arr1_attribute_arrays(spark, d):
    a = F.array_sort(F.array_distinct("top_attributes"))
    return t(spark, d, "dish_scores").where(F.size("top_attributes") > 0).select("score_id", F.array_join(F.slice(a, 1, 2), "|").alias("first_two"), F.size("top_attributes").alias("n"))


def jsn2_nested_reads(spark, d):
    v = F.get_json_object("props", "$.k").cast("int")
    return t(spark, d, "events").groupBy((v % 10).alias("k")).agg(F.count("*").alias("n"), F.sum(v).alias("total"))


def jsn3_histories(spark, d):
    e = t(spark, d, "events").where("event_type in ('signup', 'purchase')")
    h = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return e.groupBy("user_id").agg(h.alias("h")).select("user_id", F.array_join(F.transform(F.slice("h", 1, 5), lambda x: x["event_type"]), ">").alias("history"), F.size("h").alias("n"))


def nul1_coalesced(spark, d):
    w = W.partitionBy("source", "external_id").orderBy("fetched_at", "place_id").rowsBetween(W.unboundedPreceding, 0)
    keep = lambda c: F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(w)
    return t(spark, d, "raw_places").select("place_id", keep("phone").alias("phone"), keep("address").alias("address"))


def api1_ranked_places(spark, d):
    last = W.partitionBy("dish_id", "restaurant_id", "city_id").orderBy(F.col("computed_at").desc_nulls_last(), F.col("score_id").desc())
    s = t(spark, d, "dish_scores").where("dish_id = 'ds-000000001' and city_id = 'ct-01'").withColumn("rn", F.row_number().over(last)).where("rn = 1 and status = 'ranked' and score between 0 and 100")
    r = t(spark, d, "restaurants").select(F.col("id").alias("restaurant_id"), "name", "lat", "lng")
    return s.join(r, "restaurant_id").orderBy(F.col("score").desc(), "restaurant_id").limit(20).select("restaurant_id", "name", "score", "mention_count")


def api6_restaurants_of_city(spark, d):
    s = t(spark, d, "dish_scores").where("status = 'ranked' and score between 0 and 100").groupBy("restaurant_id").agg(F.max("score").alias("best"))
    r = t(spark, d, "restaurants").where("city_id = 'ct-01'").withColumnRenamed("id", "restaurant_id")
    return r.join(s, "restaurant_id", "left").orderBy(F.col("best").desc_nulls_last(), "normalized_name", "restaurant_id").limit(40).select("restaurant_id", "name", "best")


def api7_locations(spark, d):
    return t(spark, d, "restaurants").where("city_id = 'ct-02' and lat is not null and lng is not null").select("id", "name", "lat", "lng")


def api10_latest_reviews(spark, d):
    a = t(spark, d, "review_analysis").where("restaurant_id is not null").select("raw_id", "restaurant_id").distinct()
    w = W.partitionBy("restaurant_id").orderBy(F.col("published_at").desc_nulls_last(), "raw_id")
    return t(spark, d, "raw_reviews").join(a, "raw_id").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("restaurant_id", "raw_id", "rn")


def api11_trending(spark, d):
    last = W.partitionBy("restaurant_id").orderBy(F.col("window_end").desc(), "trend_id")
    m = t(spark, d, "trend_results").where("window_end is not null and restaurant_id is not null").withColumn("rn", F.row_number().over(last)).where("rn = 1 and delta is not null and not isnan(delta)")
    r = t(spark, d, "restaurants").select(F.col("id").alias("restaurant_id"), "name")
    return m.join(r, "restaurant_id").orderBy(F.abs("delta").desc(), "restaurant_id").limit(20).select("restaurant_id", "name", "delta", "direction")


def fe1_score_bands(spark, d):
    s = F.col("score")
    return t(spark, d, "dish_scores").where("score between 0 and 100").groupBy(F.when(s >= 80, "excellent").when(s >= 65, "good").when(s >= 45, "fair").otherwise("low").alias("band")).agg(F.count("*").alias("n"))


_FNS = [
    src1_scan, src3_map_elements, src6_relevant_posts, src7_posts_to_reviews, src10_threads, src11_swept_places, src12_lattice, src13_two_zones, src15_alias_groups, src16_new_aliases, src20_first_claims,
    flt3_price_range, flt4_ilike, flt5_prefix, flt7_membership, flt8_three_valued, flt10_radius, flt12_like, prj2_markers, prj3_labels, jn1_reviews_analysis, jn2_scores_restaurants, jn4_left_composite,
    jn6_left_counts, jn7_unscored, jn8_sources_of_restaurants, jn14_without_analysis, agg14_totals, agg16_event_points, agg17_counters, agg21_kind_sums, agg22_dish_means, agg24_bounds, agg26_actions,
    srt2_nearest, srt3_largest_moves, lim1_page, lim3_buckets, set2_suggestions, set3_shared_words, set4_new_words, dat1_ages, dat2_months, dat4_bucket_keys, mth2_decay, mth5_spread,
    arr1_attribute_arrays, jsn2_nested_reads, jsn3_histories, nul1_coalesced, api1_ranked_places, api6_restaurants_of_city, api7_locations, api10_latest_reviews, api11_trending, fe1_score_bands,
]
QUERIES = {f.__name__: f for f in _FNS}


def _hav(a: str, b: str, c: str, e: str) -> str:
    return f"2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))))"


def _cells(centres: str, radius: str, cell: float, offset: float = 0.0, inner: float = 0.0) -> str:
    return f"""(select id from (select id, lat as y0, lng as x0, r, y0 + (row_ + {offset}) * dy as y, x0 + (col_ + {offset}) * dx as x from (
      select *, unnest(generate_series(-n, n)) as col_ from (select id, lat, lng, r, n, dy, dy / greatest(cos(radians(lat)), 0.01) as dx, unnest(generate_series(-n, n)) as row_
      from (select id, lat, lng, {radius} as r, cast(ceil({radius} / {cell}) as int) as n, degrees({cell} / 6371000.0::double) as dy from {centres})))) where {_hav('y0', 'x0', 'y', 'x')} between {inner} and r)"""


from tastegrid.plans.texts import normal_sql, tokens_sql  # noqa: E402

_WORDS = lambda n: f"(select distinct unnest(list_distinct({tokens_sql('name')})) as w from {n})"

SQL = {
    "src1_scan": "select id, slug, name, category, is_veg from dishes",
    "src3_map_elements": """select external_id, max(trim(name)) as name, max(nullif(concat_ws(', ', nullif(coalesce(address, ''), ''), area), '')) as address, max(substr(trim(split_part(phone, ';', 1)), 1, 40)) as phone,
      max(array_to_string(list_filter(list_transform(string_split(array_to_string(cuisines, ';'), ';'), lambda x: replace(trim(x), '_', ' ')), lambda x: x <> ''), '|')) as cuisines, count(*) as n
      from raw_places where source = 'osm' and length(trim(name)) > 0 and lat is not null and lng is not null group by external_id""",
    "src6_relevant_posts": "select doc_id from documents d join cities c on d.city_id = c.id where (" + " or ".join(f"contains(lower(text), '{c}')" for c in FOOD_CUES) + ") and (contains(lower(text), lower(c.name)) or source = 'reddit')",
    "src7_posts_to_reviews": f"select 't3_' || doc_id as external_id, cast(length({clean_sql('text')}) as int) as chars, date_trunc('second', published_at) as published_at from documents where source = 'reddit' and lower(trim(text)) not in ('[deleted]', '[removed]') and length({clean_sql('text')}) >= 40",
    "src10_threads": "select 'yt:' || raw_id as external_id, author, date_trunc('second', ingested_at) as published_at, coalesce(engagement, 0) as engagement from raw_reviews where source = 'youtube' and length(text) > 0",
    "src11_swept_places": "select external_id, count(*) as fetches, max(fetched_at) as last_fetch, max(rating_count) as rating_count from raw_places where source = 'google' group by all",
    "src12_lattice": f"select id, count(*) as cells from {_cells('cities', 'radius_m', 1000.0)} group by id",
    "src13_two_zones": f"select id, 'fine' as zone, count(*) as cells from {_cells('cities', 'least(radius_m, 4000)', 300.0)} group by id union all select id, 'coarse', count(*) from {_cells('(select * from cities where radius_m > 4000)', 'radius_m', 1000.0, 0.5, 4000.001)} group by id",
    "src15_alias_groups": "select id, name, string_agg(distinct alias, '|' order by alias) as aliases from (select id, name, unnest(aliases) as alias from restaurants) where alias <> name group by all",
    "src16_new_aliases": f"select distinct restaurant_id, alias from (select id as restaurant_id, {normal_sql('a')} as alias, normalized_name from (select id, normalized_name, unnest(aliases) as a from restaurants)) where alias <> '' and alias is distinct from normalized_name",
    "src20_first_claims": f"select alias, min(id) as id from (select {normal_sql('name')} as alias, id from dishes where name is not null) group by alias",
    "flt3_price_range": "select score_id, price_avg from dish_scores where price_avg between 100 and 250 and not isnan(price_avg)",
    "flt4_ilike": "select place_id, name from raw_places where name ilike '%noodle%bar%'",
    "flt5_prefix": "select id from restaurants where starts_with(normalized_name, 'royal')",
    "flt7_membership": "select place_id from raw_places where list_contains(cuisines, 'bakery')",
    "flt8_three_valued": "select id, is_veg from dishes where is_veg is null or is_veg",
    "flt10_radius": f"select id, round({_hav('22.571', '88.362', 'lat', 'lng')}, 1) as distance_m from restaurants where not isnan(lat) and {_hav('22.571', '88.362', 'lat', 'lng')} <= 5000",
    "flt12_like": "select source, count(*) as n from raw_reviews where external_id like 'yt:%' and external_id like '%#c:%' group by all",
    "prj2_markers": "select id, city_id, round(lat, 4) as lat, round(lng, 4) as lng from restaurants where lat is not null and lng is not null",
    "prj3_labels": "select array_to_string(list_transform(string_split(replace(a, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as label, count(*) as n from (select unnest(top_attributes) as a from dish_scores) group by all",
    "jn1_reviews_analysis": "select source, language, count(*) as n, round(sum(overall_sentiment), 3) as sentiment from raw_reviews join review_analysis using (raw_id) group by all",
    "jn2_scores_restaurants": "select restaurant_id, r.name, count(*) as n, max(mention_count) as most from dish_scores s join restaurants r on r.id = s.restaurant_id where status = 'ranked' group by all",
    "jn4_left_composite": "select dish_id, restaurant_id, mentions, coalesce(reviews, 0) as reviews from (select dish_id, restaurant_id, max(mention_count) as mentions from dish_scores group by all) left join (select restaurant_id, count(*) as reviews from review_analysis where restaurant_id is not null group by all) using (restaurant_id)",
    "jn6_left_counts": "select c.id as city_id, c.name, count(r.id) as restaurants from cities c left join restaurants r on r.city_id = c.id group by all",
    "jn7_unscored": "select id as restaurant_id from restaurants where id not in (select restaurant_id from dish_scores where restaurant_id is not null)",
    "jn8_sources_of_restaurants": "select id, string_agg(k.source || ':' || k.external_id, '|' order by k.source || ':' || k.external_id) as keys from (select id, unnest(source_keys) as k from restaurants) where (k.source, k.external_id) in (select (source, external_id) from raw_places) group by id",
    "jn14_without_analysis": "select raw_id from raw_reviews where raw_id not in (select raw_id from review_analysis)",
    "agg14_totals": "select count(*) as total from (select distinct city_id, dish_id from dish_scores where status = 'ranked')",
    "agg16_event_points": "select user_id, cast(coalesce(sum(case event_type when 'purchase' then 10 when 'signup' then 5 end), 0) as bigint) as points from events group by all",
    "agg17_counters": "select author, count(*) as reviews, count(published_at) as dated, count(distinct source) as sources from raw_reviews group by all",
    "agg21_kind_sums": "select user_id, " + ", ".join(f"round(sum(value) filter (where event_type = '{k}'), 2) as {k}" for k in ("click", "error", "purchase", "signup", "view")) + " from events group by all",
    "agg22_dish_means": "select dish_id, round(avg(score), 4) as score from dish_scores where status = 'ranked' and not isnan(score) and score between 0 and 100 group by all",
    "agg24_bounds": "select city_id, min(lat) as south, max(lat) as north, min(lng) as west, max(lng) as east from restaurants group by all",
    "agg26_actions": """select source, count(*) as seen, count(*) filter (where a = 'created') as created, count(*) filter (where a = 'updated') as updated, count(*) filter (where a = 'skipped') as skipped from (
      select source, case when name is null then 'skipped' when row_number() over (partition by source, external_id order by place_id) = 1 then 'created' else 'updated' end as a from raw_places) group by all""",
    "srt2_nearest": f"select id, round({_hav('22.571', '88.362', 'lat', 'lng')}, 1) as distance_m from restaurants where lat is not null and lng is not null order by distance_m, id limit 50",
    "srt3_largest_moves": "select trend_id, delta from trend_results where delta is not null and not isnan(delta) order by significant desc nulls last, abs(delta) desc, trend_id limit 20",
    "lim1_page": "select id, normalized_name from restaurants order by normalized_name nulls first, id limit 20 offset 40",
    "lim3_buckets": "select score_id, bucket, cast(row_number() over (partition by bucket order by s desc nulls last, score_id) as int) as place from (select score_id, case when status = 'ranked' then 'ranked' else 'rest' end as bucket, case when not isnan(score) then score end as s from dish_scores where dish_id = 'ds-000000002')",
    "set2_suggestions": "select 'dish' as kind, id, name from dishes where starts_with(lower(name), 'c') union all select 'place', id, name from restaurants where starts_with(normalized_name, 'c')",
    "set3_shared_words": f"select w from {_WORDS('restaurants')} intersect select w from {_WORDS('dishes')}",
    "set4_new_words": f"select w from {_WORDS('dishes')} except select w from {_WORDS('restaurants')}",
    "dat1_ages": "select raw_id, case when published_at is null then 365 else cast(floor(greatest(0.0, (epoch_us(timestamptz '2026-08-15 00:00:00+00') - epoch_us(published_at)) / 86400e6)) as bigint) end as age from raw_reviews",
    "dat2_months": "select strftime(published_at, '%Y-%m') as month, source, count(*) as n from raw_reviews group by all",
    "dat4_bucket_keys": "select event_type || ':' || strftime(ts, '%Y-%m-%d') || 'T' || lpad(cast(hour(ts) // 6 * 6 as varchar), 2, '0') as key, count(*) as n from events group by all",
    "mth2_decay": "select score_id, round(case when recency_days <= 0 then 1.0 else pow(0.5::double, recency_days / 180) end, 6) as decay, round(least(1.0, ln(1 + mention_count) / ln(51)), 6) as volume, round(case when evidence_weight > 0 then (observed_positivity * evidence_weight + 0.62::double * 6) / (evidence_weight + 6) else 0.62::double end, 6) as shrunk from dish_scores where recency_days is not null and not isnan(recency_days)",
    "mth5_spread": "select city_id, round(stddev_pop(score), 6) as sd, round(median(score), 6) as median from dish_scores where not isnan(score) and score between 0 and 100 group by all",
    "arr1_attribute_arrays": "select score_id, array_to_string(list_sort(list_distinct(top_attributes))[1:2], '|') as first_two, cast(len(top_attributes) as int) as n from dish_scores where len(top_attributes) > 0",
    "jsn2_nested_reads": "select cast(json_extract(props, '$.k') as int) % 10 as k, count(*) as n, cast(sum(cast(json_extract(props, '$.k') as int)) as bigint) as total from events group by all",
    "jsn3_histories": "select user_id, array_to_string(list(event_type order by ts, event_id)[1:5], '>') as history, cast(count(*) as int) as n from events where event_type in ('signup', 'purchase') group by all",
    "nul1_coalesced": "select place_id, last_value(nullif(phone, '') ignore nulls) over w as phone, last_value(nullif(address, '') ignore nulls) over w as address from raw_places window w as (partition by source, external_id order by fetched_at nulls first, place_id rows between unbounded preceding and current row)",
    "api1_ranked_places": "select restaurant_id, r.name, score, mention_count from (select * from dish_scores where dish_id = 'ds-000000001' and city_id = 'ct-01' qualify row_number() over (partition by dish_id, restaurant_id, city_id order by computed_at desc nulls last, score_id desc) = 1) s join restaurants r on r.id = s.restaurant_id where status = 'ranked' and not isnan(score) and score between 0 and 100 order by score desc, restaurant_id limit 20",
    "api6_restaurants_of_city": "select r.id as restaurant_id, r.name, best from restaurants r left join (select restaurant_id, max(score) as best from dish_scores where status = 'ranked' and not isnan(score) and score between 0 and 100 group by all) s on s.restaurant_id = r.id where city_id = 'ct-01' order by best desc nulls last, normalized_name nulls first, r.id limit 40",
    "api7_locations": "select id, name, lat, lng from restaurants where city_id = 'ct-02' and lat is not null and lng is not null",
    "api10_latest_reviews": "select restaurant_id, raw_id, cast(row_number() over (partition by restaurant_id order by published_at desc nulls last, raw_id) as int) as rn from raw_reviews join (select distinct raw_id, restaurant_id from review_analysis where restaurant_id is not null) using (raw_id) qualify rn <= 5",
    "api11_trending": "select m.restaurant_id, r.name, delta, direction from (select * from trend_results where window_end is not null and restaurant_id is not null qualify row_number() over (partition by restaurant_id order by window_end desc, trend_id) = 1) m join restaurants r on r.id = m.restaurant_id where delta is not null and not isnan(delta) order by abs(delta) desc, m.restaurant_id limit 20",
    "fe1_score_bands": "select case when score >= 80 then 'excellent' when score >= 65 then 'good' when score >= 45 then 'fair' else 'low' end as band, count(*) as n from dish_scores where not isnan(score) and score between 0 and 100 group by all",
}
