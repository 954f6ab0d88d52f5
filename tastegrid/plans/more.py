"""Further queries: payloads, stores, sweeps, small expressions, searches and details, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegrid.functions import numeric as N
from tastegrid.functions import text as T
from tastegrid.operators import scoring as S
from tastegrid.plans.bindings import OBS, SCORES, now, observations
from tastegrid.plans.texts import slug_sql, trigrams_sql
from tastegrid.sources import payloads as P
from tastegrid.sources.tables import table as t


def src2_place_elements(spark, d):
    """Landed answers of a map service: one document of many elements, exploded."""
    p = t(spark, d, "raw_places").where("source = 'osm'")
    tags = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("phone"), F.col("phone")), lambda k, v: v.isNotNull())
    one = F.struct(F.lit("node").alias("type"), "place_id", "lat", F.col("lng").alias("lon"), tags.alias("tags"))
    answers = p.groupBy(F.pmod(F.xxhash64("place_id"), F.lit(50)).alias("k")).agg(F.collect_list(one).alias("elements")).select(F.to_json(F.struct("elements")).alias("json"))
    e = answers.select(F.explode(F.from_json("json", "elements array<struct<type:string,place_id:string,lat:double,lon:double,tags:map<string,string>>>")["elements"]).alias("e")).select("e.*")
    return e.where("tags['name'] is not null and lat is not null and lon is not null").select("place_id", F.col("tags")["name"].alias("name"), F.col("tags")["phone"].alias("phone"))


def src8_distinct_videos(spark, d):
    """Several searches return the same video: the first answer of each counts."""
    r = t(spark, d, "raw_reviews").where("source = 'youtube'").withColumn("video", F.split("external_id", "#")[0])
    return S.latest_per_key(r, ["video"], F.col("ingested_at").asc_nulls_last(), F.col("raw_id").asc()).select("video", "raw_id")


def src9_videos_to_reviews(spark, d):
    """Title and description that name the city, of 40 characters or more, cut to 4000."""
    docs = t(spark, d, "documents").where("source = 'youtube'").join(t(spark, d, "cities").select(F.col("id").alias("city_id"), F.col("name").alias("city")), "city_id")
    body = F.concat_ws(". ", "title", "text")
    return docs.where((F.length(body) >= 40) & F.contains(F.lower(body), F.lower("city"))).select("doc_id", F.length(F.substring(body, 1, 4000)).alias("chars"), F.sha2(F.substring(body, 1, 4000), 256).alias("hash"))


def src14_places_api(spark, d):
    """Items of a places API: price words to levels; without id, name or position, or closed for good, they are left out."""
    p = t(spark, d, "raw_places").where("source = 'google'")
    word = F.when(F.col("price_level") > 0, F.element_at(F.array(*map(F.lit, P.PRICE_WORDS)), F.col("price_level")))
    json = F.to_json(F.struct(F.col("external_id").alias("id"), F.struct(F.col("name").alias("text")).alias("displayName"), F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("location"), F.col("rating_count").alias("userRatingCount"), word.alias("priceLevel"), F.lit("OPERATIONAL").alias("businessStatus")))
    return P.api_places(p.select("place_id", json.alias("json")), ["place_id"]).select("place_id", "external_id", "name", "rating_count", "price_level")


def src17_checked_submissions(spark, d):
    """Submitted reviews that keep the contract: 20 to 5000 characters, a rating within its scale, no control characters."""
    body = F.btrim("text")
    ok = F.length(body).between(20, 5000) & (F.col("rating").isNull() | F.col("rating").between(0, 5)) & ~F.rlike(body, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return t(spark, d, "raw_reviews").where("source = 'user'").where(ok).select("raw_id")


def snk2_upserted_rollups(spark, d):
    o = observations(spark, d)
    old, new = S.pair_rollup(o.where("published_at < '2001-06-01'")), S.pair_rollup(o)
    touched = o.where("published_at >= '2001-06-01'").select("restaurant_id", "dish_id").distinct()
    return S.upsert(old, new.join(touched, ["restaurant_id", "dish_id"], "left_semi"), ["restaurant_id", "dish_id"]).select("restaurant_id", "dish_id", "mentions", "positive", "price_min", "price_max")


def _restaurant_scores(scores):
    return scores.where("status = 'ranked'").groupBy("restaurant_id").agg(S.mean_score().alias("score"), F.sum("mention_count").alias("mentions"))


def snk4_upserted_restaurant_scores(spark, d):
    o = observations(spark, d)
    old, new = (_restaurant_scores(S.score_pairs(x, now())) for x in (o.where("method = 'ai'"), o.where("published_at >= '2000-01-01'")))
    return S.upsert(old, new, ["restaurant_id"])


def snk5_signatures(spark, d):
    s = S.score_pairs(observations(spark, d), now()).select("restaurant_id", "dish_id", "mention_count")
    share = F.col("mention_count") / F.sum("mention_count").over(W.partitionBy("restaurant_id"))
    return s.withColumn("share", share).select("restaurant_id", "dish_id", ((F.col("share") >= 0.25) & (F.col("mention_count") >= 3)).alias("signature"))


def snk9_review_store(spark, d):
    """What a store does with deliveries: known source key, known content, or created; the first of each by arrival."""
    r = t(spark, d, "raw_reviews").withColumn("h", F.sha2(F.concat_ws("|", F.coalesce("text", F.lit("")), F.coalesce("author", F.lit("")), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")), 256))
    r = r.withColumn("k", F.row_number().over(W.partitionBy("source", "external_id").orderBy("raw_id")))
    first = r.where("k = 1").withColumn("c", F.row_number().over(W.partitionBy("h").orderBy("raw_id"))).select("raw_id", "c")
    return r.join(first, "raw_id", "left").select("raw_id", F.when(F.col("k") > 1, "known key").when(F.col("c") > 1, "known content").otherwise("created").alias("action"))


def snk12_remapped_mentions(spark, d):
    """Mentions of one dish moved to another; both dishes of each moved pair are dirty."""
    o = observations(spark, d).select("dish_id", "restaurant_id")
    moved = o.where("dish_id = 'Brand#11'")
    return moved.select(F.explode(F.array("dish_id", F.lit("Brand#12"))).alias("dish_id"), "restaurant_id").distinct()


def flt2_active_lookup(spark, d):
    """The asked slug's city, or the default one where none is asked."""
    asked = spark.createDataFrame([(1, None), (2, "no-such-city")], "ask int, slug string")
    c = t(spark, d, "cities").select("id", "slug", F.min("slug").over(W.partitionBy()).alias("default"))  # cities: a fixed list of 24
    return asked.alias("a").join(c.alias("c"), F.expr("c.slug = coalesce(a.slug, c.default)")).select("ask", F.col("c.id").alias("city_id"))


def flt13_visible(spark, d):
    """Hidden reviews show to their author only."""
    a = t(spark, d, "review_analysis").groupBy("raw_id").agg(F.bool_or("is_spam").alias("hidden"))
    return t(spark, d, "raw_reviews").join(a, "raw_id", "left").where("not coalesce(hidden, false) or author = 'Night Notes'").select("raw_id")


def krn13_levels(spark, d):
    """Level of each user by points, and the next threshold."""
    p = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("points"))
    steps = F.array(*map(F.lit, [5, 10, 20, 40, 80]))
    return p.select("user_id", F.size(F.filter(steps, lambda x: x <= F.col("points"))).alias("level"), F.array_min(F.filter(steps, lambda x: x > F.col("points"))).alias("next"))


def krn19_value_signals(spark, d):
    return t(spark, d, "raw_reviews").select("raw_id", T.value_signal("text").alias("signal"))


def srt6_claims(spark, d):
    return t(spark, d, "raw_reviews").orderBy(F.col("ingested_at").asc_nulls_last(), "raw_id").limit(8).select("raw_id")


def txt17_alias_similarity(spark, d):
    r = t(spark, d, "restaurants").where("name is not null").select("id", "name", F.explode("aliases").alias("alias"))
    return r.groupBy("id").agg(F.max(F.round(T.trigram_similarity("name", "alias"), 4)).alias("similarity"))


def txt19_usernames(spark, d):
    """A slug of the author, numbered where taken; and the author escaped for XML."""
    a = t(spark, d, "raw_reviews").where("author is not null").select("author").distinct().withColumn("base", F.substring(T.slugify("author"), 1, 30))
    n = F.row_number().over(W.partitionBy("base").orderBy("author"))
    xml = F.col("author")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        xml = F.replace(xml, F.lit(sign), F.lit(name))
    return a.select("author", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("username"), xml.alias("escaped"))


def dat5_first_times(spark, d):
    r = t(spark, d, "raw_reviews").select("raw_id", F.when(F.col("engagement") % 2 == 0, "soon").otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("a"), F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("b"))
    return r.select("raw_id", P.first_time("a", "b").alias("at"))


def _finite(spark, d):
    return t(spark, d, "dish_scores").where("score is not null and not isnan(score)")


def mth1_clamped(spark, d):
    return _finite(spark, d).select("score_id", N.clamp("score", 0.0, 100.0).alias("score"))


def mth3_shrunk(spark, d):
    return t(spark, d, "dish_scores").where("observed_positivity is not null and evidence_weight is not null and not isnan(observed_positivity) and not isnan(evidence_weight)").select("score_id", F.round(N.shrink("observed_positivity", "evidence_weight", 0.5), 6).alias("shrunk"))


def mth4_saturated(spark, d):
    return t(spark, d, "dish_scores").select("score_id", F.round(N.log_saturation("mention_count", 50), 6).alias("volume"))


def mth6_medians(spark, d):
    return t(spark, d, "dish_scores").where("price_avg is not null and not isnan(price_avg)").groupBy("dish_id", "city_id").agg(F.round(F.median("price_avg"), 6).alias("price"))


def mth7_spread(spark, d):
    r = t(spark, d, "restaurants").where("lat is not null and lng is not null")
    c = r.groupBy("city_id").agg(F.avg("lat").alias("y"), F.avg("lng").alias("x"))
    return r.join(c, "city_id").groupBy("city_id").agg(F.round(F.max(N.haversine_m("y", "x", "lat", "lng")), 0).alias("reach_m"))


def mth8_bands(spark, d):
    s = t(spark, d, "dish_scores").where("price_avg is not null and not isnan(price_avg)")
    lo, hi = F.when(F.col("band") == "mid", 150.0).when(F.col("band") == "premium", 700.0), F.when(F.col("band") == "cheap", 300.0).when(F.col("band") == "mid", 700.0)
    b = s.select("price_avg", F.explode(F.array(*map(F.lit, ["cheap", "mid", "premium"]))).alias("band")).withColumns({"lo": lo, "hi": hi})
    return b.where("(lo is null or price_avg >= lo) and (hi is null or price_avg <= hi)").groupBy("band").agg(F.count("*").alias("n"))


def fe3_formats(spark, d):
    m, n = F.col("distance"), F.col("rating_count")
    p = t(spark, d, "raw_places").select("place_id", "rating_count", (F.coalesce("rating_count", F.lit(0)) * 7).alias("distance"))
    dist = F.when(m < 1000, F.concat(m.cast("string"), F.lit(" m"))).otherwise(F.concat(F.floor(m / 1000).cast("string"), F.lit("."), F.floor(m % 1000 / 100).cast("string"), F.lit(" km")))
    return p.select("place_id", dist.alias("distance"), F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).otherwise(n.cast("string")).alias("ratings"))


def fe4_relative_times(spark, d):
    s = F.unix_seconds(F.lit("2026-08-15").cast("timestamp")) - F.unix_seconds("published_at")
    label = F.when(s < 60, "now").when(s < 3600, "minutes").when(s < 86400, "hours").when(s < 7 * 86400, "days").when(s < 30 * 86400, "weeks").when(s < 365 * 86400, "months").otherwise("years")
    return t(spark, d, "raw_reviews").where("published_at is not null").groupBy(label.alias("age")).agg(F.count("*").alias("n"))


def fe5_structured_list(spark, d):
    """Of each dish the ten best ranked places with three mentions or more, rated out of five."""
    s = S.score_pairs(observations(spark, d), now()).where("status = 'ranked' and mention_count >= 3")
    w = W.partitionBy("dish_id").orderBy(F.col("score").desc(), "restaurant_id", "city_id")
    return s.withColumn("position", F.row_number().over(w)).where("position <= 10").select("dish_id", "restaurant_id", "city_id", "position", F.round(F.col("score") / 20, 1).alias("rating"))


def fe7_hues(spark, d):
    """A hue from 0 to 359 of each name: 31 h + c in 32 bits with sign."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    h = F.aggregate(F.filter(F.split("name", ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: wrap(a * 31 + F.ascii(c)))
    return t(spark, d, "dishes").where("name is not null and not name rlike '[^\\\\x00-\\\\x7f]'").select("id", F.pmod(F.abs(h), F.lit(360)).cast("int").alias("hue"))


def str4_claims(spark, d):
    """One claim: of the rows without an analysis those that arrived first, at most a batch of 50."""
    r = t(spark, d, "raw_reviews").join(t(spark, d, "review_analysis").select("raw_id"), "raw_id", "left_anti")
    return r.orderBy(F.col("ingested_at").asc_nulls_last(), "raw_id").limit(50).select("raw_id")


def str7_stale_pairs(spark, d):
    """Pairs whose newest score is older than a day, and pairs with observations but no score."""
    last = t(spark, d, "dish_scores").groupBy("dish_id", "restaurant_id").agg(F.max("computed_at").alias("at"))
    stale = last.where("at < timestamp '2026-08-14' or at is null")
    return stale.select("dish_id", "restaurant_id")


def str8_recomputed(spark, d):
    """All pairs anew under the next version; what the old version had and the new hasn't is gone."""
    return S.score_pairs(observations(spark, d), now()).groupBy("status").agg(F.count("*").alias("pairs"), F.first(F.lit("v2")).alias("weights_version"))


def str13_unstuck(spark, d):
    """Rows taken up but unfinished for an hour are pending again."""
    o = t(spark, d, "orders")
    stuck = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp"))
    return o.groupBy(F.when(stuck, "O").otherwise(F.col("o_orderstatus")).alias("status")).agg(F.count("*").alias("n"))


def api4_dish_summary(spark, d):
    """Every dish has a row: its mentions and share of positive ones, or insufficient_data."""
    o = observations(spark, d).groupBy("dish_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("sentiment") > 0.15).cast("double")), 4).alias("positive"))
    return o.select("dish_id", F.when(F.col("n") >= 10, "ready").otherwise("insufficient_data").alias("status"), F.when(F.col("n") >= 10, F.col("positive")).alias("positive"))


def api8_restaurant_details(spark, d):
    """Each restaurant with its reviews and the eight best of its dishes."""
    s = S.latest_per_key(t(spark, d, "dish_scores"), ["dish_id", "restaurant_id", "city_id"], F.col("computed_at").desc_nulls_last(), F.col("score_id").desc()).where("status = 'ranked' and score between 0 and 100")
    s = s.withColumn("rn", F.row_number().over(W.partitionBy("restaurant_id").orderBy(F.col("score").desc(), "dish_id", "city_id"))).where("rn <= 8")
    best = s.groupBy(F.col("restaurant_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "dish_id"))), lambda x: x["dish_id"]), "|").alias("best"))
    n = t(spark, d, "review_analysis").where("restaurant_id is not null").groupBy(F.col("restaurant_id").alias("id")).agg(F.countDistinct("raw_id").alias("reviews"))
    return t(spark, d, "restaurants").select("id", "name").join(best, "id", "left").join(n, "id", "left").select("id", "name", "best", F.coalesce("reviews", F.lit(0)).alias("reviews"))


def api12_cities(spark, d):
    return t(spark, d, "cities").where("name is not null and slug is not null").select("id", "name", F.row_number().over(W.orderBy("name", "id")).alias("place"))  # a fixed list


def api16_review(spark, d):
    return t(spark, d, "raw_reviews").where("raw_id = 'rv-000000007'").select("raw_id", "source", "text")


def qry3_search(spark, d):
    """Asked dish in a city: resolved by name, then its places by the newest score; what resolves to nothing browses all dishes."""
    asked = spark.createDataFrame([("ds-000000001",), ("ds-000000002",)], "dish_id string")
    s = S.latest_per_key(t(spark, d, "dish_scores").join(asked, "dish_id", "left_semi"), ["dish_id", "restaurant_id", "city_id"], F.col("computed_at").desc_nulls_last(), F.col("score_id").desc())
    s = s.where("status = 'ranked' and score between 0 and 100").join(t(spark, d, "restaurants").select(F.col("id").alias("restaurant_id"), "name"), "restaurant_id")
    w = W.partitionBy("dish_id").orderBy(F.col("score").desc(), F.col("mention_count").desc(), "restaurant_id", "city_id")
    return s.withColumn("place", F.row_number().over(w)).where("place <= 20").select("dish_id", "place", "restaurant_id", "city_id", "name", "score")


def ext6_resolved_mentions(spark, d):
    """The dish of a hint: by alias index first, then by a dish's own name."""
    from tastegrid.plans.rest import ext1_alias_index

    names = t(spark, d, "dishes").where("name is not null").groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("by_name"))
    hints = t(spark, d, "raw_reviews").where("restaurant_hint is not null").select("restaurant_hint").distinct()
    alias = ext1_alias_index(spark, d).withColumnRenamed("id", "by_alias")
    return hints.join(alias, T.normalize_name("restaurant_hint") == F.col("alias"), "left").join(names, F.lower("restaurant_hint") == F.col("name"), "left").select("restaurant_hint", F.coalesce("by_alias", "by_name").alias("key"))


_FNS = [
    src2_place_elements, src8_distinct_videos, src9_videos_to_reviews, src14_places_api, src17_checked_submissions, snk2_upserted_rollups, snk4_upserted_restaurant_scores, snk5_signatures, snk9_review_store, snk12_remapped_mentions,
    flt2_active_lookup, flt13_visible, krn13_levels, krn19_value_signals, srt6_claims, txt17_alias_similarity, txt19_usernames, dat5_first_times, mth1_clamped, mth3_shrunk, mth4_saturated, mth6_medians, mth7_spread, mth8_bands,
    fe3_formats, fe4_relative_times, fe5_structured_list, fe7_hues, str4_claims, str7_stale_pairs, str8_recomputed, str13_unstuck, api4_dish_summary, api8_restaurant_details, api12_cities, api16_review, qry3_search, ext6_resolved_mentions,
]
QUERIES = {f.__name__: f for f in _FNS}

_LAST = "last as (select * from dish_scores qualify row_number() over (partition by dish_id, restaurant_id, city_id order by computed_at desc nulls last, score_id desc) = 1), good as (select * from last where status = 'ranked' and not isnan(score) and score between 0 and 100)"
_FIN = "dish_scores where score is not null and not isnan(score)"
_HAV = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(r.lat - y) / 2), 2) + cos(radians(y)) * cos(radians(r.lat)) * pow(sin(radians(r.lng - x) / 2), 2))))"
_LIKE = lambda ps: " or ".join(f"contains(lower(text), '{p}')" for p in ps)


def _rest(where: str) -> str:
    return SCORES.replace("join nation on s_nationkey = n_nationkey)", f"join nation on s_nationkey = n_nationkey where {where})") + " select restaurant_id, round(avg(score), 3) as score, cast(sum(mention_count) as bigint) as mentions from scores where status = 'ranked' group by all"


SQL = {
    "src2_place_elements": "select place_id, name, phone from raw_places where source = 'osm' and name is not null and lat is not null and lng is not null",
    "src8_distinct_videos": "select split_part(external_id, '#', 1) as video, raw_id from raw_reviews where source = 'youtube' qualify row_number() over (partition by split_part(external_id, '#', 1) order by ingested_at nulls last, raw_id) = 1",
    "src9_videos_to_reviews": "with b as (select doc_id, concat_ws('. ', title, text) as body, c.name as city from documents join cities c on c.id = city_id where source = 'youtube') select doc_id, cast(length(substr(body, 1, 4000)) as int) as chars, sha256(substr(body, 1, 4000)) as hash from b where length(body) >= 40 and contains(lower(body), lower(city))",
    "src14_places_api": "select place_id, external_id, name, rating_count, case when price_level between 1 and 4 then price_level end as price_level from raw_places where source = 'google' and external_id is not null and name is not null and trim(name) <> '' and lat is not null and lng is not null",
    "src17_checked_submissions": "select raw_id from raw_reviews where source = 'user' and length(trim(text)) between 20 and 5000 and (rating is null or rating between 0 and 5) and not regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')",
    "snk2_upserted_rollups": f"with {OBS} select restaurant_id, dish_id, count(*) as mentions, count(*) filter (where sentiment > 0.15) as positive, min(price) as price_min, max(price) as price_max from obs group by all",
    "snk4_upserted_restaurant_scores": f"""with o as (with {_rest("l_linestatus = 'O'")}), n as (with {_rest("l_shipdate >= timestamp '2000-01-01'")}) select * from o where restaurant_id not in (select restaurant_id from n) union all select * from n""",
    "snk5_signatures": f"with {SCORES} select restaurant_id, dish_id, mention_count / sum(mention_count) over (partition by restaurant_id) >= 0.25 and mention_count >= 3 as signature from scores",
    "snk9_review_store": """with r as (select raw_id, sha256(concat_ws('|', coalesce(text, ''), coalesce(author, ''), strftime(published_at, '%Y-%m-%d %H:%M:%S'))) as h, row_number() over (partition by source, external_id order by raw_id) as k from raw_reviews),
      f as (select raw_id, row_number() over (partition by h order by raw_id) as c from r where k = 1) select raw_id, case when k > 1 then 'known key' when c > 1 then 'known content' else 'created' end as action from r left join f using (raw_id)""",
    "snk12_remapped_mentions": f"with {OBS} select distinct unnest(['Brand#11', 'Brand#12']) as dish_id, restaurant_id from obs where dish_id = 'Brand#11'",
    "flt2_active_lookup": "select cast(1 as int) as ask, id as city_id from cities where slug = (select min(slug) from cities)",
    "flt13_visible": "select raw_id from raw_reviews left join (select raw_id, bool_or(is_spam) as hidden from review_analysis group by all) using (raw_id) where not coalesce(hidden, false) or author = 'Night Notes'",
    "krn13_levels": "select user_id, cast(len(list_filter([5, 10, 20, 40, 80], lambda x: x <= points)) as int) as level, list_min(list_filter([5, 10, 20, 40, 80], lambda x: x > points)) as next from (select user_id, count(*) as points from events group by all)",
    "krn19_value_signals": f"select raw_id, case when {_LIKE(T.DEAR)} then 'expensive' when {_LIKE(T.CHEAP)} then 'cheap' when regexp_matches(text, '(?i)(₹|rs\\.?|inr)\\s*\\d{{1,5}}(\\.\\d{{1,2}})?(\\D|$)') or regexp_matches(text, '(?i)(^|\\D)\\d{{1,5}}(\\.\\d{{1,2}})?\\s*(₹|rs\\.?|inr|/-)') or regexp_matches(text, '(?i)(^|\\D)\\d{{1,5}}\\s*(bucks|rupees)') then 'fair' else 'unknown' end as signal from raw_reviews",
    "srt6_claims": "select raw_id from raw_reviews order by ingested_at nulls last, raw_id limit 8",
    "txt17_alias_similarity": f"with a as (select id, {trigrams_sql('name')} as x, {trigrams_sql('alias')} as y from (select id, name, unnest(aliases) as alias from restaurants where name is not null)) select id, max(round(case when len(x) = 0 or len(y) = 0 then 0.0 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end, 4)) as similarity from a group by id",
    "txt19_usernames": f"with a as (select author, substr({slug_sql('author')}, 1, 30) as base from (select distinct author from raw_reviews where author is not null)), n as (select *, row_number() over (partition by base order by author) as n from a) select author, case when n = 1 then base else base || '-' || n end as username, replace(replace(replace(author, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from n",
    "dat5_first_times": "select raw_id, date_trunc('second', coalesce(case when engagement % 2 = 0 then null else published_at end, ingested_at)) as at from raw_reviews",
    "mth1_clamped": f"select score_id, greatest(0.0, least(100.0, score)) as score from {_FIN}",
    "mth3_shrunk": "select score_id, round(case when evidence_weight > 0 then (observed_positivity * evidence_weight + 0.5 * 6) / (evidence_weight + 6) else 0.5 end, 6) as shrunk from dish_scores where observed_positivity is not null and evidence_weight is not null and not isnan(observed_positivity) and not isnan(evidence_weight)",
    "mth4_saturated": "select score_id, round(least(1.0, greatest(0.0, ln(1 + mention_count) / ln(51))), 6) as volume from dish_scores",
    "mth6_medians": "select dish_id, city_id, round(median(price_avg), 6) as price from dish_scores where price_avg is not null and not isnan(price_avg) group by all",
    "mth7_spread": f"with c as (select city_id, avg(lat) as y, avg(lng) as x from restaurants where lat is not null and lng is not null group by all) select r.city_id, round(max({_HAV}), 0) as reach_m from restaurants r join c on c.city_id = r.city_id where r.lat is not null and r.lng is not null group by all",
    "mth8_bands": "select band, count(*) as n from dish_scores, (values ('cheap', null, 300.0), ('mid', 150.0, 700.0), ('premium', 700.0, null)) b(band, lo, hi) where not isnan(price_avg) and (lo is null or price_avg >= lo) and (hi is null or price_avg <= hi) group by all",
    "fe3_formats": "with p as (select place_id, rating_count as n, coalesce(rating_count, 0) * 7 as m from raw_places) select place_id, case when m < 1000 then m || ' m' else (m // 1000) || '.' || (m % 1000 // 100) || ' km' end as distance, case when n >= 1000 then (n // 1000) || 'k' else cast(n as varchar) end as ratings from p",
    "fe4_relative_times": "with s as (select epoch(timestamptz '2026-08-15 00:00:00+00')::bigint - floor(epoch(published_at))::bigint as s from raw_reviews where published_at is not null) select case when s < 60 then 'now' when s < 3600 then 'minutes' when s < 86400 then 'hours' when s < 604800 then 'days' when s < 2592000 then 'weeks' when s < 31536000 then 'months' else 'years' end as age, count(*) as n from s group by all",
    "fe5_structured_list": f"with {SCORES} select dish_id, restaurant_id, city_id, cast(row_number() over (partition by dish_id order by score desc, restaurant_id, city_id) as int) as position, round(score / 20, 1) as rating from scores where status = 'ranked' and mention_count >= 3 qualify position <= 10",
    "str4_claims": "select raw_id from raw_reviews where raw_id not in (select raw_id from review_analysis) order by ingested_at nulls last, raw_id limit 50",
    "str7_stale_pairs": "select dish_id, restaurant_id from dish_scores group by all having max(computed_at) < timestamptz '2026-08-14 00:00:00+00' or max(computed_at) is null",
    "str8_recomputed": f"with {SCORES} select status, count(*) as pairs, 'v2' as weights_version from scores group by all",
    "str13_unstuck": "select case when o_orderstatus = 'P' and o_orderdate < timestamp '2001-01-01' then 'O' else o_orderstatus end as status, count(*) as n from orders group by 1",
    "api4_dish_summary": f"with {OBS}, g as (select dish_id, count(*) as n, round(avg(case when sentiment > 0.15 then 1.0 else 0.0 end), 4) as p from obs group by all) select dish_id, case when n >= 10 then 'ready' else 'insufficient_data' end as status, case when n >= 10 then p end as positive from g",
    "api8_restaurant_details": f"with {_LAST}, b as (select restaurant_id as id, string_agg(dish_id, '|' order by rn) as best from (select *, row_number() over (partition by restaurant_id order by score desc, dish_id, city_id) as rn from good) where rn <= 8 group by all), n as (select restaurant_id as id, count(distinct raw_id) as c from review_analysis where restaurant_id is not null group by all) select r.id, r.name, best, coalesce(c, 0) as reviews from restaurants r left join b using (id) left join n using (id)",
    "api12_cities": "select id, name, cast(row_number() over (order by name, id) as int) as place from cities where name is not null and slug is not null",
    "api16_review": "select raw_id, source, text from raw_reviews where raw_id = 'rv-000000007'",
    "qry3_search": f"with {_LAST} select dish_id, cast(row_number() over (partition by dish_id order by score desc, mention_count desc, restaurant_id, g.city_id) as int) as place, restaurant_id, g.city_id, r.name, score from good g join restaurants r on r.id = restaurant_id where dish_id in ('ds-000000001', 'ds-000000002') qualify place <= 20",
}
