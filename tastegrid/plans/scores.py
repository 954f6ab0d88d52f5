"""Queries of scores, badges, trends, rollups and snapshots over observations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegrid.operators import scoring as S
from tastegrid.plans.bindings import NOW, OBS, SCORES, now, observations

GEM = {"gem_positivity": 0.5, "gem_consistency": 0.3}


def _scores(spark, d):
    return S.score_pairs(observations(spark, d), now())


def agg1_dish_scores(spark, d):
    return _scores(spark, d)


def agg2_priors(spark, d):
    return S.priors(observations(spark, d)).select("dish_id", "city_id", F.round("prior", 6).alias("prior"))


def agg3_median_prices(spark, d):
    return S.medians(observations(spark, d), ["dish_id", "city_id"])


def agg4_city_medians(spark, d):
    pairs = observations(spark, d).groupBy("city_id", "dish_id", "restaurant_id").agg(F.avg("price").alias("a"))
    return pairs.groupBy("city_id").agg(F.when(F.count("*") >= 5, F.round(F.median("a"), 4)).alias("median_price"))


def agg5_positive_ratio(spark, d):
    return observations(spark, d).groupBy("dish_id").agg(F.round(F.avg(F.when(F.col("sentiment") > 0.15, 1.0).otherwise(0.0)), 6).alias("positive_ratio"))


def agg6_price_range(spark, d):
    return observations(spark, d).where("price > 0").groupBy("dish_id", "city_id").agg(F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.round(F.avg("price"), 4).alias("price_avg"))


def agg7_pair_rollup(spark, d):
    return S.pair_rollup(observations(spark, d))


def agg8_top_attributes(spark, d):
    return S.top_labels(observations(spark, d), ["dish_id", "city_id"], "attributes", 3)


def agg9_attribute_signs(spark, d):
    rows = observations(spark, d).select("dish_id", F.when(F.col("sentiment") >= 0, "positive").otherwise("negative").alias("sign"), F.explode("attributes").alias("label"))
    return rows.groupBy("dish_id", "sign", "label").agg(F.count("*").alias("n"))


def agg10_monthly_signal(spark, d):
    rows = observations(spark, d).where(F.col("published_at") >= now() - F.expr("interval 180 days"))
    return rows.groupBy("dish_id", F.date_format("published_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("mentions"), F.round(F.avg((F.col("sentiment") > 0.15).cast("double")), 6).alias("positive_share"))


def agg11_dish_cards(spark, d):
    g = _scores(spark, d).where("status = 'ranked'").groupBy("dish_id", "city_id").agg(
        S.mean_score().alias("score"), F.count("*").alias("places"), F.sum("mention_count").alias("mentions"), F.min("price_avg").alias("price_min"), F.max("price_avg").alias("price_max")
    )
    return g.where("places >= 3")


def agg12_price_having(spark, d):
    g = _scores(spark, d).groupBy("dish_id").agg(F.min("price_avg").alias("lo"), F.max("price_avg").alias("hi"))
    return g.where("lo <= 2000 and hi >= 1500")


def agg13_trend_candidates(spark, d):
    return observations(spark, d).groupBy("dish_id", "restaurant_id").agg(F.count("*").alias("n")).where("n >= 24")


def agg15_distinct_places(spark, d):
    return observations(spark, d).groupBy("source").agg(F.countDistinct("restaurant_id").alias("places"), F.countDistinct("dish_id").alias("dishes"), F.countDistinct("restaurant_id", "dish_id").alias("pairs"))


def agg18_dish_aggregate(spark, d):
    r = _scores(spark, d).where("status = 'ranked'").withColumn("rn", F.row_number().over(W.partitionBy("dish_id").orderBy(F.col("score").desc(), "restaurant_id", "city_id")))
    return r.where("rn <= 10").groupBy("dish_id").agg(F.round(F.avg("score"), 3).alias("score"))


def agg19_dish_counters(spark, d):
    return _scores(spark, d).groupBy("dish_id").agg(F.sum("mention_count").alias("mentions"), F.count_if(F.col("status") == "ranked").alias("ranked"))


def agg20_restaurant_rollup(spark, d):
    s = _scores(spark, d)
    ranked = F.col("status") == "ranked"
    best = F.array_sort(F.collect_list(F.when(ranked, F.struct((-F.col("score")).alias("k"), F.col("dish_id").alias("v")))))
    return s.groupBy("restaurant_id").agg(
        F.round(F.avg(F.when(ranked, F.col("score"))), 3).alias("score"), F.round(F.avg("sentiment"), 4).alias("sentiment"), F.round(F.avg(F.when(F.col("mention_count") >= 3, F.col("consistency"))), 4).alias("consistency"),
        F.round(F.avg("value_score"), 4).alias("value_score"), F.round(F.sum("evidence_weight"), 3).alias("evidence"), F.array_join(F.transform(F.slice(best, 1, 5), lambda x: x["v"]), "|").alias("top_dishes"),
    )


def agg23_status_overview(spark, d):
    return _scores(spark, d).agg(F.count_if(F.col("status") == "ranked").alias("ranked"), F.count_if(F.col("status") != "ranked").alias("insufficient"), F.count("*").alias("pairs"))


def krn1_reasons(spark, d):
    s = _scores(spark, d)
    return s.select(*S.PAIR, S.why(s).alias("why"))


def krn2_best_value(spark, d):
    return S.badges(_scores(spark, d), **GEM).where("best_value").select(*S.PAIR)


def krn3_most_consistent(spark, d):
    return S.badges(_scores(spark, d), **GEM).where("most_consistent").select(*S.PAIR)


def krn4_hidden_gems(spark, d):
    return S.badges(_scores(spark, d), **GEM).where("hidden_gem").select(*S.PAIR)


def krn5_trends(spark, d):
    return S.trends(observations(spark, d), ["category", "restaurant_id"], now())


def krn8_summaries(spark, d):
    o = observations(spark, d)
    n = F.count("*")
    g = o.groupBy("dish_id").agg(n.alias("n"), F.round(F.avg((F.col("sentiment") > 0.15).cast("double")) * 100, 0).cast("int").alias("pct"), F.countDistinct("restaurant_id").alias("places"))
    g = g.join(S.top_labels(o, ["dish_id"], "attributes", 3), "dish_id", "left").where("n >= 3")
    parts = F.concat_ws(" · ", F.concat(F.col("n").cast("string"), F.lit(" mentions")), F.concat(F.col("pct").cast("string"), F.lit("% positive")), F.concat(F.col("places").cast("string"), F.lit(" places")), F.concat(F.lit("often "), F.replace("top", F.lit("|"), F.lit(", "))))
    return g.select("dish_id", parts.alias("summary"))


def krn9_recent_ratio(spark, d):
    w = W.partitionBy("dish_id").orderBy(F.col("published_at").desc(), F.col("review_id").desc())
    return observations(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 50").groupBy("dish_id").agg(F.round(F.avg((F.col("sentiment") > 0.15).cast("double")), 4).alias("ratio"))


def krn11_snippets(spark, d):
    w = W.partitionBy("dish_id", "restaurant_id").orderBy(F.col("confidence").desc(), F.col("published_at").desc(), F.col("review_id").desc())
    return observations(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("dish_id", "restaurant_id", "review_id", "rn")


def krn12_highlights(spark, d):
    w = W.partitionBy("dish_id").orderBy(F.col("score").desc_nulls_last(), "restaurant_id", "city_id")
    return _scores(spark, d).where("status = 'ranked'").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("dish_id", "restaurant_id", "score")


def win1_latest_observation(spark, d):
    return S.latest_per_key(observations(spark, d), ["dish_id", "restaurant_id"], F.col("published_at").desc(), F.col("review_id").desc()).select("dish_id", "restaurant_id", "review_id", "published_at")


def win4_mention_share(spark, d):
    s = _scores(spark, d).select("restaurant_id", "dish_id", "mention_count")
    share = F.col("mention_count") / F.sum("mention_count").over(W.partitionBy("restaurant_id"))
    return s.withColumn("share", F.round(share, 6)).withColumn("signature", (F.col("share") >= 0.05) & (F.col("mention_count") >= 3))


def win5_latest_neighbours(spark, d):
    w = W.partitionBy("restaurant_id").orderBy(F.col("published_at").desc(), F.col("review_id").desc())
    return observations(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 40").groupBy("restaurant_id").agg(F.count("*").alias("n"), F.min("published_at").alias("oldest"))


def snk1_upserted_scores(spark, d):
    o = observations(spark, d)
    old = S.score_pairs(o.where("method = 'ai'"), now())
    new = S.score_pairs(o.where(F.col("published_at") >= "2001-01-01"), now())  # what a later batch brought
    return S.upsert(old, new, S.PAIR).select(*S.PAIR, "mention_count", "score")


def snk3_snapshots(spark, d):
    o = observations(spark, d)
    last = S.score_pairs(o.where(F.col("published_at") < "2001-06-01"), now())
    return S.changed_snapshots(S.score_pairs(o, now()), last).select(*S.PAIR, "mention_count", "score")


def srt1_ranked_order(spark, d):
    s = _scores(spark, d)
    order = W.partitionBy("dish_id").orderBy(F.when(F.col("status") == "ranked", 0).otherwise(1), F.col("score").desc_nulls_last(), "restaurant_id", "city_id")
    return s.select(*S.PAIR, "score", F.row_number().over(order).alias("place")).where("place <= 20")


def set1_stale_or_missing(spark, d):
    o = observations(spark, d)
    stale = o.groupBy("dish_id", "restaurant_id").agg(F.max("published_at").alias("t")).where(F.col("t") < "2001-01-01").select("dish_id", "restaurant_id")
    missing = o.select("dish_id", "restaurant_id").distinct().join(o.where("method = 'ai'").select("dish_id", "restaurant_id").distinct(), ["dish_id", "restaurant_id"], "left_anti")
    return stale.union(missing).distinct()


_FNS = [
    agg1_dish_scores, agg2_priors, agg3_median_prices, agg4_city_medians, agg5_positive_ratio, agg6_price_range, agg7_pair_rollup, agg8_top_attributes, agg9_attribute_signs, agg10_monthly_signal,
    agg11_dish_cards, agg12_price_having, agg13_trend_candidates, agg15_distinct_places, agg18_dish_aggregate, agg19_dish_counters, agg20_restaurant_rollup, agg23_status_overview, krn1_reasons,
    krn2_best_value, krn3_most_consistent, krn4_hidden_gems, krn5_trends, krn8_summaries, krn9_recent_ratio, krn11_snippets, krn12_highlights, win1_latest_observation, win4_mention_share,
    win5_latest_neighbours, snk1_upserted_scores, snk3_snapshots, srt1_ranked_order, set1_stale_or_missing,
]
QUERIES = {f.__name__: f for f in _FNS}

_R = "ranked as (select * from scores where status = 'ranked')"
_TOP = """(select dish_id, string_agg(label, '{sep}' order by c desc, label) as top from (
  select dish_id, label, count(*) as c, row_number() over (partition by dish_id order by count(*) desc, label) as rn from (select dish_id, unnest(attributes) as label from obs) group by dish_id, label) where rn <= 3 group by dish_id)"""


def _over(where: str) -> str:
    """The score fold over some of the observations."""
    return SCORES.replace("join nation on s_nationkey = n_nationkey)", f"join nation on s_nationkey = n_nationkey where {where})")


SQL = {
    "agg1_dish_scores": f"with {SCORES} select * from scores",
    "agg2_priors": f"with {OBS} select dish_id, city_id, round(case when count(*) >= 10 then avg((sentiment + 1) / 2) end, 6) as prior from obs group by all",
    "agg3_median_prices": f"with {OBS} select dish_id, city_id, case when count(*) >= 3 then median(price) end as median_price from obs where price > 0 group by all",
    "agg4_city_medians": f"with {OBS}, p as (select city_id, dish_id, restaurant_id, avg(price) as a from obs group by all) select city_id, round(case when count(*) >= 5 then median(a) end, 4) as median_price from p group by all",
    "agg5_positive_ratio": f"with {OBS} select dish_id, round(avg(case when sentiment > 0.15 then 1.0 else 0.0 end), 6) as positive_ratio from obs group by all",
    "agg6_price_range": f"with {OBS} select dish_id, city_id, min(price) as price_min, max(price) as price_max, round(avg(price), 4) as price_avg from obs where price > 0 group by all",
    "agg7_pair_rollup": f"""with {OBS} select restaurant_id, dish_id, count(*) as mentions, count(*) filter (where sentiment > 0.15) as positive, count(*) filter (where sentiment < -0.15) as negative,
      count(*) filter (where sentiment between -0.15 and 0.15) as neutral, min(price) as price_min, max(price) as price_max, min(published_at) as first_at, max(published_at) as last_at from obs group by all""",
    "agg8_top_attributes": f"""with {OBS}, c as (select dish_id, city_id, label, count(*) as c from (select dish_id, city_id, unnest(attributes) as label from obs) group by all),
      r as (select *, row_number() over (partition by dish_id, city_id order by c desc, label) as rn from c) select dish_id, city_id, string_agg(label, '|' order by rn) as top from r where rn <= 3 group by all""",
    "agg9_attribute_signs": f"with {OBS} select dish_id, sign, label, count(*) as n from (select dish_id, case when sentiment >= 0 then 'positive' else 'negative' end as sign, unnest(attributes) as label from obs) group by all",
    "agg10_monthly_signal": f"with {OBS} select dish_id, strftime(published_at, '%Y-%m') as month, count(*) as mentions, round(avg(case when sentiment > 0.15 then 1.0 else 0.0 end), 6) as positive_share from obs where published_at >= timestamp '{NOW}' - interval 180 day group by all",
    "agg11_dish_cards": f"with {SCORES}, {_R} select dish_id, city_id, round(avg(score), 3) as score, count(*) as places, cast(sum(mention_count) as bigint) as mentions, min(price_avg) as price_min, max(price_avg) as price_max from ranked group by all having count(*) >= 3",
    "agg12_price_having": f"with {SCORES} select dish_id, min(price_avg) as lo, max(price_avg) as hi from scores group by all having min(price_avg) <= 2000 and max(price_avg) >= 1500",
    "agg13_trend_candidates": f"with {OBS} select dish_id, restaurant_id, count(*) as n from obs group by all having count(*) >= 24",
    "agg15_distinct_places": f"with {OBS} select source, count(distinct restaurant_id) as places, count(distinct dish_id) as dishes, count(distinct (restaurant_id, dish_id)) as pairs from obs group by all",
    "agg18_dish_aggregate": f"with {SCORES}, {_R} select dish_id, round(avg(score), 3) as score from (select *, row_number() over (partition by dish_id order by score desc, restaurant_id, city_id) as rn from ranked) where rn <= 10 group by all",
    "agg19_dish_counters": f"with {SCORES} select dish_id, cast(sum(mention_count) as bigint) as mentions, count(*) filter (where status = 'ranked') as ranked from scores group by all",
    "agg20_restaurant_rollup": f"""with {SCORES} select restaurant_id, round(avg(score) filter (where status = 'ranked'), 3) as score, round(avg(sentiment), 4) as sentiment, round(avg(consistency) filter (where mention_count >= 3), 4) as consistency,
      round(avg(value_score), 4) as value_score, round(sum(evidence_weight), 3) as evidence, coalesce(array_to_string(list(dish_id order by score desc, dish_id) filter (where status = 'ranked')[1:5], '|'), '') as top_dishes from scores group by all""",
    "agg23_status_overview": f"with {SCORES} select count(*) filter (where status = 'ranked') as ranked, count(*) filter (where status <> 'ranked') as insufficient, count(*) as pairs from scores",
    "krn1_reasons": f"""with {SCORES} select dish_id, restaurant_id, city_id, case when status = 'ranked' then array_to_string(list_concat(list_filter([
      case when positive_ratio >= 0.70 then cast(cast(round(positive_ratio * 100, 0) as int) as varchar) || '% positive' end,
      case when recency >= 0.60 then 'recent' when recency_days > 365 then 'stale' end, case when consistency >= 0.65 then 'consistent' when consistency < 0.35 then 'inconsistent' end,
      case when source_quality >= 0.70 then 'trusted sources' end], lambda x: x is not null)[1:3], [mention_count || ' mention' || case when mention_count = 1 then '' else 's' end]), '|') else '' end as why from scores""",
    "krn2_best_value": f"with {SCORES}, {_R} select dish_id, restaurant_id, city_id from ranked where value_score is not null qualify row_number() over (partition by dish_id order by value_score desc, restaurant_id, city_id) = 1",
    "krn3_most_consistent": f"with {SCORES}, {_R} select dish_id, restaurant_id, city_id from ranked where mention_count >= 5 qualify row_number() over (partition by dish_id order by consistency desc, restaurant_id, city_id) = 1",
    "krn4_hidden_gems": f"""with {SCORES}, {_R}, c as (select dish_id, count(*) as peers, list_sort(list(mention_count))[greatest(1, count(*) // 3)] as cutoff from ranked group by all)
      select dish_id, restaurant_id, city_id from ranked join c using (dish_id) where peers >= 3 and observed_positivity >= 0.5 and consistency >= 0.3 and mention_count <= cutoff""",
    "krn5_trends": f"""with {OBS}, g as (select category, restaurant_id, count(*) filter (where rec) as recent_count, count(*) filter (where his) as historical_count, avg(sentiment) filter (where rec) as r, avg(sentiment) filter (where his) as h from (
        select *, published_at between timestamp '{NOW}' - interval 60 day and timestamp '{NOW}' as rec, published_at >= timestamp '{NOW}' - interval 240 day and published_at < timestamp '{NOW}' - interval 60 day as his from obs) group by all),
      k as (select *, recent_count >= 3 and historical_count >= 3 as enough, round(r - h, 4) + 0.0 as dl from g)
      select category, restaurant_id, recent_count, historical_count, case when enough then dl end as delta, case when not enough then null when dl >= 0.08 then 'rising' when dl <= -0.08 then 'declining'
        when (recent_count / 60.0) / nullif(historical_count / 180.0, 0) >= 3 and recent_count >= 10 then 'rising' else 'stable' end as direction, case when not enough then false else abs(dl) >= 0.08 end as significant from k""",
    "krn8_summaries": f"""with {OBS}, g as (select dish_id, count(*) as n, cast(round(avg(case when sentiment > 0.15 then 1.0 else 0.0 end) * 100, 0) as int) as pct, count(distinct restaurant_id) as places from obs group by all)
      select dish_id, n || ' mentions · ' || pct || '% positive · ' || places || ' places · often ' || top as summary from g join {_TOP.format(sep=', ')} using (dish_id) where n >= 3""",
    "krn9_recent_ratio": f"with {OBS} select dish_id, round(avg(case when sentiment > 0.15 then 1.0 else 0.0 end), 4) as ratio from (select * from obs qualify row_number() over (partition by dish_id order by published_at desc, review_id desc) <= 50) group by all",
    "krn11_snippets": f"with {OBS} select dish_id, restaurant_id, review_id, cast(row_number() over (partition by dish_id, restaurant_id order by confidence desc, published_at desc, review_id desc) as int) as rn from obs qualify rn <= 2",
    "krn12_highlights": f"with {SCORES}, {_R} select dish_id, restaurant_id, score from ranked qualify row_number() over (partition by dish_id order by score desc nulls last, restaurant_id, city_id) = 1",
    "win1_latest_observation": f"with {OBS} select dish_id, restaurant_id, review_id, published_at from obs qualify row_number() over (partition by dish_id, restaurant_id order by published_at desc, review_id desc) = 1",
    "win4_mention_share": f"with {SCORES} select restaurant_id, dish_id, mention_count, round(mention_count / sum(mention_count) over (partition by restaurant_id), 6) as share, share >= 0.05 and mention_count >= 3 as signature from scores",
    "win5_latest_neighbours": f"with {OBS} select restaurant_id, count(*) as n, min(published_at) as oldest from (select * from obs qualify row_number() over (partition by restaurant_id order by published_at desc, review_id desc) <= 40) group by all",
    "snk1_upserted_scores": f"""with o as (with {_over("l_linestatus = 'O'")} select dish_id, restaurant_id, city_id, mention_count, score from scores), n as (with {_over("l_shipdate >= timestamp '2001-01-01'")} select dish_id, restaurant_id, city_id, mention_count, score from scores)
      select * from o where (dish_id, restaurant_id, city_id) not in (select (dish_id, restaurant_id, city_id) from n) union all select * from n""",
    "snk3_snapshots": f"""with n as (with {SCORES} select dish_id, restaurant_id, city_id, mention_count, score from scores), o as (with {_over("l_shipdate < timestamp '2001-06-01'")} select dish_id, restaurant_id, city_id, mention_count as m, score as s from scores)
      select n.* from n left join o using (dish_id, restaurant_id, city_id) where m is null or abs(score - s) >= 0.5 or (score is null) <> (s is null) or abs(mention_count - m) >= 2""",
    "srt1_ranked_order": f"with {SCORES} select dish_id, restaurant_id, city_id, score, cast(row_number() over (partition by dish_id order by case when status = 'ranked' then 0 else 1 end, score desc nulls last, restaurant_id, city_id) as int) as place from scores qualify place <= 20",
    "set1_stale_or_missing": f"""with {OBS} select dish_id, restaurant_id from obs group by all having max(published_at) < timestamp '2001-01-01'
      union select distinct dish_id, restaurant_id from obs where (dish_id, restaurant_id) not in (select (dish_id, restaurant_id) from obs where method = 'ai')""",
}
