"""Observations bound to the order tables: one for each line item, as a DataFrame and as the same SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.sources.tables import table

NOW = "2001-12-01"


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def observations(spark: SparkSession, d: str) -> DataFrame:
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    sup, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    li = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey).join(nation, sup.s_nationkey == nation.n_nationkey)
    lab = lambda i: F.element_at(F.array(*map(F.lit, ["spicy", "juicy", "crispy", "fresh", "sweet", "smoky", "tangy"])), (i % 7 + 1).cast("int"))
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("l_discount") * 20 - 1 + (F.col("l_suppkey") % 7 - 3) * 0.15))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"), F.col("p_brand").alias("dish_id"), F.col("p_type").alias("category"), F.col("l_suppkey").alias("restaurant_id"),
        F.col("n_regionkey").alias("city_id"), F.round(s, 4).alias("sentiment"), F.least(F.lit(1.0), 0.2 + 0.1 * F.col("l_linenumber")).alias("confidence"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").alias("published_at"),
        F.when(F.col("l_returnflag") == "R", "user").when(F.col("l_returnflag") == "A", "reddit").otherwise("youtube").alias("source"),
        F.col("l_quantity").cast("int").alias("engagement"), F.when(F.col("l_linestatus") == "O", "ai").otherwise("rule").alias("method"),
        F.array(lab(F.col("l_partkey")), lab(F.col("l_suppkey") + F.col("l_linenumber"))).alias("attributes"),
    )


OBS = """obs as (
  select l_orderkey * 10 + l_linenumber as review_id, p_brand as dish_id, p_type as category, l_suppkey as restaurant_id, n_regionkey as city_id,
    round(greatest(-1.0, least(1.0, l_discount * 20 - 1 + (l_suppkey % 7 - 3) * 0.15::double)), 4) as sentiment, least(1.0::double, 0.2::double + 0.1::double * l_linenumber) as confidence,
    l_extendedprice / l_quantity as price, l_shipdate as published_at,
    case l_returnflag when 'R' then 'user' when 'A' then 'reddit' else 'youtube' end as source, cast(l_quantity as int) as engagement,
    case l_linestatus when 'O' then 'ai' else 'rule' end as method,
    [['spicy', 'juicy', 'crispy', 'fresh', 'sweet', 'smoky', 'tangy'][l_partkey % 7 + 1], ['spicy', 'juicy', 'crispy', 'fresh', 'sweet', 'smoky', 'tangy'][(l_suppkey + l_linenumber) % 7 + 1]] as attributes
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""

# the score fold as SQL over `obs`; its result is `scores`
SCORES = f"""{OBS},
rows1 as (
  select *, (greatest(-1.0, least(1.0, sentiment)) + 1) / 2 as p, greatest(0.0, least(1.0, confidence)) as c,
    case source when 'user' then 0.90::double when 'manual' then 0.85::double when 'reddit' then 0.75::double when 'youtube' then 0.60::double when 'osm' then 0.40::double else 0.5::double end as q,
    case when published_at is null then 365.0 else greatest(0.0, (epoch_us(timestamp '{NOW}') - epoch_us(published_at)) / 86400e6) end as age from obs),
rows2 as (select *, case when age <= 0 then 1.0 else pow(0.5::double, age / 180) end as d from rows1),
prior as (select dish_id, city_id, case when count(*) >= 10 then avg(p) end as prior from rows2 group by all),
med as (select dish_id, city_id, case when count(*) >= 3 then median(price) end as median_price from obs where price > 0 group by all),
g as (
  select dish_id, restaurant_id, city_id, count(*) as n, sum(c * d * q) as w, sum(p * c * d * q) as pw, avg(p) as mean_p, sum(c * q) as gate, min(age) as min_age, stddev_pop(p) as sd,
    sum(q * d) as qd, sum(d) as sd_d, sum(greatest(0, coalesce(engagement, 0))) as e, avg(c) as mean_c, bool_or(method = 'ai') as ai,
    avg(case when sentiment > 0.15 then 1.0 else 0.0 end) as pr, avg(price) filter (where price > 0) as price_mean
  from rows2 group by all),
h as (
  select g.*, coalesce(prior, 0.62) as pri, median_price, case when w > 0 then pw / w else mean_p end as observed from g left join prior using (dish_id, city_id) left join med using (dish_id, city_id)),
k as (
  select *, greatest(0.0, least(1.0, case when w > 0 then (observed * w + pri * 6) / (w + 6) else pri end)) as k_sentiment, case when min_age <= 0 then 1.0 else pow(0.5::double, min_age / 180) end as k_recency,
    case when n >= 3 then 1 - least(1.0, sd / 0.5) else 0.5 end as k_consistency, least(1.0, ln(1 + n) / ln(51)) as k_volume, coalesce(qd / nullif(sd_d, 0), 0.5) as k_quality,
    least(1.0, ln(1 + e) / ln(501)) as k_engagement, mean_c * case when ai then 1.0 else 0.85 end * case when n < 3 then 0.8 else 1.0 end as k_confidence from h),
scores as (
  select dish_id, restaurant_id, city_id, n as mention_count, case when n < 3 or gate < 1.5 then 'insufficient_data' else 'ranked' end as status,
    case when not (n < 3 or gate < 1.5) then round(100 * greatest(0.0, least(1.0, k_sentiment * 0.35::double + k_recency * 0.20::double + k_consistency * 0.15::double + k_volume * 0.10::double + k_quality * 0.10::double + k_engagement * 0.05::double + k_confidence * 0.05::double)), 3) end as score,
    round(k_sentiment, 4) as sentiment, round(k_recency, 4) as recency, round(k_consistency, 4) as consistency, round(k_volume, 4) as volume, round(k_quality, 4) as source_quality,
    round(k_engagement, 4) as engagement, round(k_confidence, 4) as confidence, round(pr, 4) as positive_ratio, round(observed, 4) as observed_positivity, round(gate, 4) as evidence_weight,
    round(price_mean, 2) as price_avg, round(greatest(0.0, least(1.0, k_sentiment * greatest(0.5, least(1.6, median_price / price_mean)))), 4) as value_score, round(min_age, 4) as recency_days
  from k)"""
