"""Scores of (dish, restaurant, city) from observations, and what is derived from them.

Every operator is one or two grouped aggregates with map-side combination; `now` is always given, never read from a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegrid.functions.numeric import age_days, clamp, half_life_decay, log_saturation, shrink, truthy

PAIR = ["dish_id", "restaurant_id", "city_id"]
# fixed values: trust in sources, weights of the components
SOURCE_QUALITY = {"user": 0.90, "manual": 0.85, "reddit": 0.75, "youtube": 0.60, "osm": 0.40}
WEIGHTS = {"sentiment": 0.35, "recency": 0.20, "consistency": 0.15, "volume": 0.10, "source_quality": 0.10, "engagement": 0.05, "confidence": 0.05}


def source_quality(source: str = "source") -> Column:
    out = F.lit(0.5)
    for name, q in SOURCE_QUALITY.items():
        out = F.when(F.col(source) == name, q).otherwise(out)
    return out


def priors(obs: DataFrame, least: int = 10) -> DataFrame:
    """Mean positivity of (dish, city), null below `least` rows."""
    p = (clamp("sentiment", -1, 1) + 1) / 2
    return obs.groupBy("dish_id", "city_id").agg(F.when(F.count("*") >= least, F.avg(p)).alias("prior"))


def medians(obs: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Exact median price of a group, null below `least` prices."""
    return obs.where(truthy("price") > 0).groupBy(*keys).agg(F.when(F.count("*") >= least, F.median("price")).alias("median_price"))


def score_pairs(obs: DataFrame, now: Column, default_prior: float = 0.62, least_mentions: int = 3, least_weight: float = 1.5) -> DataFrame:
    """One row a pair: components, score (null when insufficient), status, prices."""
    q, c = source_quality(), clamp("confidence")
    rows = obs.select(
        *PAIR, ((clamp("sentiment", -1, 1) + 1) / 2).alias("p"), F.col("sentiment").alias("s"), c.alias("c"), q.alias("q"), age_days("published_at", now).alias("age"),
        truthy("price").alias("price"), F.greatest(F.lit(0), F.coalesce("engagement", F.lit(0))).alias("e"), (F.col("method") == "ai").alias("ai"),
    )
    rows = rows.withColumn("d", half_life_decay("age")).withColumn("w", F.col("c") * F.col("d") * F.col("q"))
    g = rows.groupBy(*PAIR).agg(
        F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("p") * F.col("w")).alias("pw"), F.avg("p").alias("mean_p"), F.sum(F.col("c") * F.col("q")).alias("gate"),
        F.min("age").alias("min_age"), F.stddev_pop("p").alias("sd"), F.sum(F.col("q") * F.col("d")).alias("qd"), F.sum("d").alias("d"), F.sum("e").alias("e"), F.avg("c").alias("mean_c"),
        F.coalesce(F.bool_or("ai"), F.lit(False)).alias("ai"), F.avg(F.when(F.col("s") > 0.15, 1.0).otherwise(0.0)).alias("positive_ratio"), F.avg(F.when(F.col("price") > 0, F.col("price"))).alias("price_mean"),
    )
    g = g.join(priors(obs), ["dish_id", "city_id"], "left").join(medians(obs, ["dish_id", "city_id"]), ["dish_id", "city_id"], "left")
    observed = F.when(F.col("w") > 0, F.col("pw") / F.col("w")).otherwise(F.col("mean_p"))
    g = g.withColumn("observed", observed).withColumns({
        "sentiment": clamp(shrink("observed", "w", F.coalesce("prior", F.lit(default_prior)))),
        "recency": half_life_decay("min_age"),
        "consistency": F.when(F.col("n") >= 3, 1 - F.least(F.lit(1.0), F.col("sd") / 0.5)).otherwise(0.5),
        "volume": log_saturation("n", 50),
        "source_quality": F.coalesce(F.col("qd") / F.nullif("d", F.lit(0.0)), F.lit(0.5)),
        "engagement": log_saturation("e", 500),
        "confidence": F.col("mean_c") * F.when(F.col("ai"), 1.0).otherwise(0.85) * F.when(F.col("n") < 3, 0.8).otherwise(1.0),
    })
    raw = clamp(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)))
    thin = (F.col("n") < least_mentions) | (F.col("gate") < least_weight)
    value = clamp(F.col("sentiment") * clamp(F.col("median_price") / F.col("price_mean"), 0.5, 1.6))
    return g.select(
        *PAIR, F.col("n").alias("mention_count"), F.when(thin, "insufficient_data").otherwise("ranked").alias("status"), F.when(~thin, F.round(raw * 100, 3)).alias("score"),
        *[F.round(k, 4).alias(k) for k in WEIGHTS], F.round("positive_ratio", 4).alias("positive_ratio"), F.round("observed", 4).alias("observed_positivity"),
        F.round("gate", 4).alias("evidence_weight"), F.round("price_mean", 2).alias("price_avg"), F.round(value, 4).alias("value_score"), F.round("min_age", 4).alias("recency_days"),
    )


def mean_score(score: str = "score") -> Column:
    """Mean of scores of three decimals, to three decimals. Halves go up whatever the order of the rows: sums of doubles end above or below them by chance."""
    return F.round(F.avg(F.col(score).cast("decimal(19,16)")), 3).cast("double")


def badges(scores: DataFrame, gem_positivity: float = 0.85, gem_consistency: float = 0.60, steady_mentions: int = 5) -> DataFrame:
    """Among the ranked rows of a dish: best value, most consistent, hidden gem. Ties go to the smaller restaurant_id."""
    r = scores.where("status = 'ranked'")
    dish = W.partitionBy("dish_id")
    first = lambda col, ok: (F.row_number().over(dish.orderBy(ok.desc(), F.col(col).desc_nulls_last(), F.col("restaurant_id").asc(), F.col("city_id").asc())) == 1) & ok
    priced, steady = F.col("value_score").isNotNull(), F.col("mention_count") >= steady_mentions
    # the count a third of the way up of each dish: counts of counts, added up, so no list of a dish's peers is ever held
    per = r.groupBy("dish_id", "mention_count").agg(F.count("*").alias("_c"))
    upto, peers = F.sum("_c").over(W.partitionBy("dish_id").orderBy("mention_count")), F.sum("_c").over(dish)
    per = per.withColumns({"_upto": upto, "_peers": peers}).where(F.col("_upto") >= F.greatest(F.lit(1), F.floor(F.col("_peers") / 3)))
    thirds = per.groupBy("dish_id").agg(F.min("mention_count").alias("_cutoff"), F.first("_peers").alias("_peers"))
    gem = (F.col("_peers") >= 3) & (F.col("observed_positivity") >= gem_positivity) & (F.col("consistency") >= gem_consistency) & (F.col("mention_count") <= F.col("_cutoff"))
    return r.join(thirds, "dish_id").select(*PAIR, first("value_score", priced).alias("best_value"), first("consistency", steady).alias("most_consistent"), gem.alias("hidden_gem"))


def trends(obs: DataFrame, keys: list[str], now: Column, recent_days: int = 60, total_days: int = 240, least: int = 3, step: float = 0.08) -> DataFrame:
    """Recent against historical mean sentiment of a group; rows without a date or from the future are left out."""
    at = F.col("published_at")
    recent = (at >= now - F.make_dt_interval(F.lit(recent_days))) & (at <= now)
    past = (at >= now - F.make_dt_interval(F.lit(total_days))) & (at < now - F.make_dt_interval(F.lit(recent_days)))
    g = obs.groupBy(*keys).agg(F.count_if(recent).alias("recent_count"), F.count_if(past).alias("historical_count"), F.avg(F.when(recent, F.col("sentiment"))).alias("r"), F.avg(F.when(past, F.col("sentiment"))).alias("h"))
    delta = F.round(F.col("r") - F.col("h"), 4) + 0.0
    enough = (F.col("recent_count") >= least) & (F.col("historical_count") >= least)
    rate = (F.col("recent_count") / recent_days) / F.nullif(F.col("historical_count") / F.lit(float(total_days - recent_days)), F.lit(0.0))
    surge = (rate >= 3) & (F.col("recent_count") >= 10)
    direction = F.when(~enough, None).when(delta >= step, "rising").when(delta <= -step, "declining").when(surge, "rising").otherwise("stable")
    return g.select(*keys, "recent_count", "historical_count", F.when(enough, delta).alias("delta"), direction.alias("direction"), (enough & (F.abs(delta) >= step)).alias("significant"))


def pair_rollup(obs: DataFrame, positive: float = 0.15) -> DataFrame:
    s = F.col("sentiment")
    return obs.groupBy("restaurant_id", "dish_id").agg(
        F.count("*").alias("mentions"), F.count_if(s > positive).alias("positive"), F.count_if(s < -positive).alias("negative"), F.count_if((s >= -positive) & (s <= positive)).alias("neutral"),
        F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"),
    )


def top_labels(rows: DataFrame, keys: list[str], labels: str, k: int) -> DataFrame:
    """The k commonest array elements of a group, by count and then label, joined by |."""
    per = rows.select(*keys, F.explode(labels).alias("label")).groupBy(*keys, "label").agg(F.count("*").alias("c"))
    per = per.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("c").desc(), "label"))).where(F.col("rank") <= k)
    return per.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), "|").alias("top"))


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def changed_snapshots(new: DataFrame, last: DataFrame, score_step: float = 0.5, mention_step: int = 2) -> DataFrame:
    """Rows of `new` worth appending: no earlier row, a score that moved, appeared or went, or more mentions."""
    j = new.join(last.select(*PAIR, F.col("score").alias("old_score"), F.col("mention_count").alias("old_mentions"), F.lit(True).alias("seen")), PAIR, "left")
    moved = F.coalesce(F.abs(F.col("score") - F.col("old_score")) >= score_step, F.lit(False)) | (F.col("score").isNull() != F.col("old_score").isNull())
    return j.where(F.col("seen").isNull() | moved | (F.abs(F.col("mention_count") - F.col("old_mentions")) >= mention_step)).select(*new.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new over old by null-safe keys."""
    k = new.select(*[F.col(c).alias("_k_" + c) for c in keys]).distinct()
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col("_k_" + c))
    return old.join(k, same, "left_anti").unionByName(new)


def why(scores: DataFrame) -> Column:
    """Up to three reasons and the number of mentions, joined by |."""
    n = F.col("mention_count")
    reasons = F.array_compact(F.array(
        F.when(F.col("positive_ratio") >= 0.70, F.concat(F.round(F.col("positive_ratio") * 100, 0).cast("int").cast("string"), F.lit("% positive"))),
        F.when(F.col("recency") >= 0.60, "recent").when(F.col("recency_days") > 365, "stale"),
        F.when(F.col("consistency") >= 0.65, "consistent").when(F.col("consistency") < 0.35, "inconsistent"),
        F.when(F.col("source_quality") >= 0.70, "trusted sources"),
    ))
    last = F.concat(n.cast("string"), F.lit(" mention"), F.when(n == 1, "").otherwise("s"))
    return F.when(F.col("status") == "ranked", F.array_join(F.concat(F.slice(reasons, 1, 3), F.array(last)), "|")).otherwise("")
