"""Queries of the resolver, of upkeep, of grounding and of composed reads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegrid.functions import text as T
from tastegrid.operators import keeping as K
from tastegrid.operators import scoring as S
from tastegrid.operators.parse import parse_queries
from tastegrid.operators.resolve import name_similarity, resolve
from tastegrid.plans.bindings import OBS, SCORES, now, observations
from tastegrid.plans.texts import normal_sql, slug_sql, txt7_clauses
from tastegrid.sources.tables import table

def _incoming(spark, d):
    return table(spark, d, "raw_places").select(F.col("place_id").alias("row_id"), "name", "lat", "lng", "source", "external_id")


def qry1_parsed_queries(spark, d):
    return parse_queries(table(spark, d, "documents").where("title is not null"), "doc_id", "title")


def res1_resolved_places(spark, d):
    return resolve(_incoming(spark, d), table(spark, d, "restaurants"))


def res2_refusals(spark, d):
    return res1_resolved_places(spark, d).groupBy("method").agg(F.count("*").alias("places"), F.count("matched_id").alias("matched"))


def txt16_name_similarity(spark, d):
    p = table(spark, d, "raw_places").where("name is not null").select("source", "external_id", T.normalize_name("name").alias("n")).groupBy("source", "external_id").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    return p.select("source", "external_id", name_similarity("a", "b").alias("similarity"))


def txt10_aspects(spark, d):
    return table(spark, d, "raw_reviews").select("raw_id", T.normalize_name("text").alias("n")).select("raw_id", F.explode(T.aspects_in("n")).alias("aspect"))


def txt14_hamming(spark, d):
    r = table(spark, d, "raw_reviews")
    two = r.groupBy("source", "external_id").agg(F.min("raw_id").alias("a"), F.max("raw_id").alias("b")).where("a < b")
    h = r.select("raw_id", T.simhash("text").alias("h"))
    j = two.join(h.withColumnsRenamed({"raw_id": "a", "h": "ha"}), "a").join(h.withColumnsRenamed({"raw_id": "b", "h": "hb"}), "b")
    return j.select("a", "b", T.hamming("ha", "hb").alias("bits"))


def krn17_overall_sentiment(spark, d):
    """The rating where there is one, else the clauses' sentiment by confidence."""
    c = T.with_clause_sentiment(txt7_clauses(spark, d), "clause").groupBy("raw_id").agg((F.sum(F.col("sentiment") * F.col("confidence")) / F.nullif(F.sum("confidence"), F.lit(0.0))).alias("clauses"))
    r = table(spark, d, "raw_reviews").select("raw_id", F.when((F.col("rating_scale") > 0) & ~F.isnan("rating") & ~F.isnan("rating_scale"), F.col("rating") / F.col("rating_scale") * 2 - 1).alias("rated"))
    return r.join(c, "raw_id", "left").select("raw_id", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("rated", "clauses", F.lit(0.0)))), 3).alias("sentiment"))


def krn18_review_aspects(spark, d):
    """Of the aspects of a visit, the surest clause's sentiment; ties go to the earlier clause."""
    c = T.with_clause_sentiment(txt7_clauses(spark, d).withColumn("_normal", T.normalize_name("clause")), "clause")
    c = c.where("confidence > 0.2").select("raw_id", "at", "sentiment", "confidence", F.explode(F.array_intersect(T.aspects_in("_normal"), F.array(*map(F.lit, T.VISIT_ASPECTS)))).alias("aspect"))
    return S.latest_per_key(c, ["raw_id", "aspect"], F.col("confidence").desc(), F.col("at").asc()).select("raw_id", "aspect", "sentiment")


def krn10_supported_sentences(spark, d):
    docs = table(spark, d, "documents").where("title is not null")
    watched = ["crispy", "smoked", "sweet", "sour", "garlic", "pepper", "coconut"]
    return docs.select("doc_id", K.drop_unsupported(F.col("text"), T.token_set("title"), watched).alias("kept"))


def krn14_grounded_titles(spark, d):
    docs = table(spark, d, "documents").where("title is not null")
    return docs.select("doc_id", K.grounded(F.regexp_replace("title", " in .*", ""), "text").alias("grounded"))


def krn15_merged_scores(spark, d):
    o = observations(spark, d)
    a, b = (S.score_pairs(o.where(F.col("method") == m), now()).withColumn("pri", F.lit(i)) for i, m in ((0, "ai"), (1, "rule")))
    return S.latest_per_key(a.unionByName(b), S.PAIR, F.col("pri").asc()).select(*S.PAIR, "mention_count", F.col("pri").alias("layer"))


def snk7_replaced_rows(spark, d):
    a = table(spark, d, "review_analysis").select("raw_id", "restaurant_id", "provider")
    new = a.where("restaurant_id = 'rs-000000001'").select("raw_id", "restaurant_id", F.lit("again").alias("provider"))
    return K.replace_children(a, new, "raw_id").groupBy("provider").agg(F.count("*").alias("n"))


def snk8_upserted_places(spark, d):
    p = table(spark, d, "raw_places").withColumn("rn", F.row_number().over(W.partitionBy("source", "external_id").orderBy("fetched_at", "place_id")))
    return K.upsert_places(p.where("rn = 1"), p.where("rn = 2"), ["name", "phone", "address"])


def snk10_unique_slugs(spark, d):
    return K.unique_slugs(table(spark, d, "restaurants"), ["city_id"], "name", "id").select("id", "slug")


def snk11_merged_entities(spark, d):
    dishes = table(spark, d, "dishes").where("name is not null")
    first = dishes.groupBy("name").agg(F.min("id").alias("winner"))
    merges = dishes.join(first, "name").where(F.col("id") != F.col("winner")).select(F.col("id").alias("loser"), "winner")
    return K.merge_entities(table(spark, d, "dish_scores").select("dish_id", "mention_count"), "dish_id", merges).groupBy("dish_id").agg(F.sum("mention_count").alias("mentions"), F.count("*").alias("rows"))


def snk16_sitemap(spark, d):
    a = table(spark, d, "dishes").select(F.concat(F.lit("/dish/"), "slug").alias("path"), F.lit("2026-08-15").alias("lastmod"))
    last = table(spark, d, "dish_scores").groupBy("restaurant_id").agg(F.date_format(F.max("computed_at"), "yyyy-MM-dd").alias("lastmod"))
    b = table(spark, d, "restaurants").withColumnRenamed("id", "restaurant_id").join(last, "restaurant_id").select(F.concat(F.lit("/place/"), T.slugify("name"), F.lit("-"), F.substring("restaurant_id", 4, 9)).alias("path"), "lastmod")
    return a.unionByName(b)


def win2_latest_trend(spark, d):
    t = table(spark, d, "trend_results").where("restaurant_id is not null")
    return S.latest_per_key(t, ["restaurant_id"], F.col("window_end").desc_nulls_last(), F.col("trend_id").asc()).select("restaurant_id", "trend_id", "direction")


def win6_best_clause(spark, d):
    c = T.with_clause_sentiment(txt7_clauses(spark, d), "clause")
    return S.latest_per_key(c, ["raw_id"], F.col("confidence").desc(), F.col("at").asc()).select("raw_id", "at", F.round("confidence", 2).alias("confidence"))


def set5_dirty_pairs(spark, d):
    o = observations(spark, d)
    old, new = (o.where(c).select("dish_id", "restaurant_id") for c in ("published_at >= '2001-10-25'", "published_at < '1995-01-10'"))  # the reviews of two batches
    return old.union(new).distinct()


def api2_dish_details(spark, d):
    """One row a dish: score, prices, months, attributes."""
    o, s = observations(spark, d), S.score_pairs(observations(spark, d), now())
    top = s.where("status = 'ranked'").withColumn("rn", F.row_number().over(W.partitionBy("dish_id").orderBy(F.col("score").desc(), "restaurant_id", "city_id"))).where("rn <= 10")
    a = top.groupBy("dish_id").agg(F.round(F.avg("score"), 3).alias("score"), F.count("*").alias("places"))
    b = o.groupBy("dish_id").agg(F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.countDistinct(F.date_format("published_at", "yyyy-MM")).alias("months"))
    return a.join(b, "dish_id").join(S.top_labels(o, ["dish_id"], "attributes", 3), "dish_id")


def api3_map_markers(spark, d):
    last = W.partitionBy("dish_id", "restaurant_id", "city_id").orderBy(F.col("computed_at").desc_nulls_last(), F.col("score_id").desc())
    s = table(spark, d, "dish_scores").where("dish_id = 'ds-000000001'").withColumn("rn", F.row_number().over(last)).where("rn = 1 and status = 'ranked' and score between 0 and 100")
    r = table(spark, d, "restaurants").where("lat is not null and lng is not null").select(F.col("id").alias("restaurant_id"), "lat", "lng")
    return s.join(r, "restaurant_id").orderBy(F.col("score").desc_nulls_last(), "restaurant_id", "city_id").limit(300).select("restaurant_id", "city_id", "lat", "lng", "score")


def api9_dishes_of_place(spark, d):
    s = S.score_pairs(observations(spark, d), now()).where("restaurant_id = 7")
    order = W.orderBy(F.when(F.col("status") == "ranked", 0).otherwise(1), F.col("score").desc_nulls_last(), "dish_id", "city_id")
    return s.select("dish_id", "status", "score", F.row_number().over(order).alias("place"))


_FNS = [
    qry1_parsed_queries, res1_resolved_places, res2_refusals, txt10_aspects, txt14_hamming, txt16_name_similarity, krn10_supported_sentences, krn14_grounded_titles, krn15_merged_scores, krn17_overall_sentiment, krn18_review_aspects,
    snk7_replaced_rows, snk8_upserted_places, snk10_unique_slugs, snk11_merged_entities, snk16_sitemap, win2_latest_trend, win6_best_clause, set5_dirty_pairs, api2_dish_details, api3_map_markers, api9_dishes_of_place,
]
QUERIES = {f.__name__: f for f in _FNS}

SQL = {
    "qry1_parsed_queries": """with t as (select doc_id, lower(trim(title)) as q from documents where title is not null),
      p as (select doc_id, regexp_matches(q, '\\b(?:best|top|famous|popular|must try)\\b') as superlative, contains(q, 'near me') as near_me,
        case when contains(q, 'between') then cast(nullif(regexp_extract(q, 'between\\s*(\\d{2,5})', 1), '') as int) else cast(nullif(regexp_extract(q, '(?:over|above|more than)\\s*(\\d{2,5})', 1), '') as int) end as min_price,
        case when contains(q, 'between') then cast(nullif(regexp_extract(q, 'between\\s*\\d{2,5}\\s*(?:and|to|-)\\s*(\\d{2,5})', 1), '') as int) else cast(nullif(regexp_extract(q, '(?:under|below|less than|within|up to)\\s*(\\d{2,5})', 1), '') as int) end as max_price,
        nullif(regexp_extract(q, '\\b(?:in|near|around) ([a-z ]+)$', 1), '') as area, trim(regexp_replace(q, '\\b(?:in|near|around) [a-z ]+$', '')) as rest from t)
      select doc_id, superlative, near_me, min_price, max_price, area, trim(regexp_replace(regexp_replace(rest, '\\b(?:best|top|famous|popular|must try|near me|the|a|some|good|food|place|places)\\b', '', 'g'), '\\s+', ' ', 'g')) as dish from p""",
    "txt10_aspects": "select raw_id, aspect from (select raw_id, unnest(list_filter([" + ", ".join(f"case when regexp_matches(n, '(^|[^a-z])({'|'.join(ws)})([^a-z]|$)') then '{a}' end" for a, ws in T.ASPECTS.items()) + f"], lambda x: x is not null)) as aspect from (select raw_id, {normal_sql('text')} as n from raw_reviews))",
    "snk7_replaced_rows": """select provider, count(*) as n from (select provider from review_analysis where raw_id not in (select raw_id from review_analysis where restaurant_id = 'rs-000000001')
      union all select 'again' from review_analysis where restaurant_id = 'rs-000000001') group by all""",
    "snk8_upserted_places": """with p as (select *, row_number() over (partition by source, external_id order by fetched_at nulls first, place_id) as rn from raw_places), o as (select * from p where rn = 1), n as (select * from p where rn = 2)
      select source, external_id, coalesce(nullif(n.name, ''), o.name) as name, coalesce(nullif(n.phone, ''), o.phone) as phone, coalesce(nullif(n.address, ''), o.address) as address,
      case when n.place_id is null then 'kept' when (nullif(n.name, '') is not null and n.name is distinct from o.name) or (nullif(n.phone, '') is not null and n.phone is distinct from o.phone) or (nullif(n.address, '') is not null and n.address is distinct from o.address) then 'updated' else 'skipped' end as action
      from o left join n using (source, external_id)""",
    "snk10_unique_slugs": f"select id, case when n = 1 then b else b || '-' || n end as slug from (select id, b, row_number() over (partition by city_id, b order by id) as n from (select id, city_id, {slug_sql('name')} as b from restaurants))",
    "snk11_merged_entities": "select coalesce(w, dish_id) as dish_id, cast(sum(mention_count) as bigint) as mentions, count(*) as rows from dish_scores left join (select id, min(id) over (partition by name) as w from dishes where name is not null) on id = dish_id group by all",
    "snk16_sitemap": f"select '/dish/' || slug as path, '2026-08-15' as lastmod from dishes union all select '/place/' || {slug_sql('name')} || '-' || substr(id, 4, 9), l from restaurants join (select restaurant_id, strftime(max(computed_at), '%Y-%m-%d') as l from dish_scores group by all) on restaurant_id = id",
    "krn15_merged_scores": f"""with {OBS}, n as (select dish_id, restaurant_id, city_id, method, count(*) as c from obs group by all) select dish_id, restaurant_id, city_id, c as mention_count, cast(case method when 'ai' then 0 else 1 end as int) as layer
      from n qualify row_number() over (partition by dish_id, restaurant_id, city_id order by case method when 'ai' then 0 else 1 end) = 1""",
    "win2_latest_trend": "select restaurant_id, trend_id, direction from trend_results where restaurant_id is not null qualify row_number() over (partition by restaurant_id order by window_end desc nulls last, trend_id) = 1",
    "set5_dirty_pairs": f"with {OBS} select dish_id, restaurant_id from obs where published_at >= timestamp '2001-10-25' union select dish_id, restaurant_id from obs where published_at < timestamp '1995-01-10'",
    "api2_dish_details": f"""with {SCORES}, a as (select dish_id, round(avg(score), 3) as score, count(*) as places from (select * from scores where status = 'ranked' qualify row_number() over (partition by dish_id order by score desc, restaurant_id, city_id) <= 10) group by all),
      b as (select dish_id, min(price) as price_min, max(price) as price_max, count(distinct strftime(published_at, '%Y-%m')) as months from obs group by all),
      t as (select dish_id, string_agg(label, '|' order by c desc, label) as top from (select dish_id, label, count(*) as c, row_number() over (partition by dish_id order by count(*) desc, label) as rn from (select dish_id, unnest(attributes) as label from obs) group by dish_id, label) where rn <= 3 group by dish_id)
      select dish_id, score, places, price_min, price_max, months, top from a join b using (dish_id) join t using (dish_id)""",
    "api3_map_markers": "select restaurant_id, s.city_id, r.lat, r.lng, score from (select * from dish_scores where dish_id = 'ds-000000001' qualify row_number() over (partition by dish_id, restaurant_id, city_id order by computed_at desc nulls last, score_id desc) = 1) s join restaurants r on r.id = restaurant_id where status = 'ranked' and not isnan(score) and score between 0 and 100 and r.lat is not null and r.lng is not null order by score desc nulls last, restaurant_id, s.city_id limit 300",
    "api9_dishes_of_place": f"with {SCORES} select dish_id, status, score, cast(row_number() over (order by case when status = 'ranked' then 0 else 1 end, score desc nulls last, dish_id, city_id) as int) as place from scores where restaurant_id = 7",
}
