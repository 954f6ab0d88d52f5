"""Queries of the training-data problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm import langid, linkage, mixing, packing, pii, safety, truncation
from tastegrid.llm.tokens import token_counts
from tastegrid.llm.top_n import latest, top_n
from tastegrid.session import settle
from tastegrid.sources.tables import table

#: the domain of each source in the tree of the mixture
DOMAINS = {"reddit": "social", "youtube": "social", "google": "places", "osm": "places", "user": "own", "manual": "own"}


def _ranked(spark: SparkSession, d: str, n: int) -> DataFrame:
    scores = table(spark, d, "dish_scores")
    keys = ["dish_id", "restaurant_id", "city_id"]
    last = latest(scores, keys, [F.col("computed_at").desc_nulls_last(), F.col("score_id").desc()], ["status", "score", "mention_count"])
    valid = last.where((F.lower(F.btrim("status", F.lit(" \t\r\n"))) == "ranked") & F.col("score").between(0, 100)).drop("status")
    return top_n(valid, ["city_id", "dish_id"], "score", [F.col("mention_count").desc_nulls_last(), F.col("restaurant_id").asc_nulls_last()], n, "restaurant_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, 3).select("city_id", "dish_id", "restaurant_id")


def p1_top_ten(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, 10).select("city_id", "dish_id", "restaurant_id", "score", "rank")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "raw_reviews").select("raw_id", "text", "author")
    model = pii.fit_on(spark, reviews, "raw_id", "text", "author", table(spark, d, "person_names"), table=d)
    return pii.tag_fields(reviews, "raw_id", ["text", "author"], model)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = [F.struct(F.lit(f).alias("field_name"), F.array_distinct(F.col(f + "_spans.kind")).alias("kinds")) for f in ("text", "author")]
    rows = _tagged(spark, d).select("raw_id", F.explode(F.array(*kinds)).alias("x"))
    return rows.select("raw_id", "x.field_name", F.explode("x.kinds").alias("pii_kind"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("raw_id", pii.redacted("text").alias("text"), pii.redacted("author").alias("author"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "raw_reviews").select("raw_id", "source", "text")
    model = safety.fit_on(reviews, table(spark, d, "review_labels"), "raw_id", "text", table=d)
    return safety.score_texts(reviews, "raw_id", "text", model, keep=["source"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("score > 0.5").select("raw_id")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("raw_id", "score", "start", "stop")


def p4_source_rates(spark: SparkSession, d: str) -> DataFrame:
    unsafe = F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)
    return _scored(spark, d).groupBy("source").agg(F.count("*").alias("reviews"), F.avg(unsafe).alias("unsafe_rate"), F.avg("score").alias("mean_score"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Reviews with the language of their latest analysis row, as label_of reads it."""
    last = latest(table(spark, d, "review_analysis"), ["raw_id"], [F.col("analyzed_at").desc_nulls_last(), F.col("provider").asc_nulls_last(), F.col("language").asc_nulls_last()], ["language"])
    last = last.select("raw_id", langid.label_of(F.col("language")).alias("label"))
    return table(spark, d, "raw_reviews").select("raw_id", "text").join(last, "raw_id", "left")


def _languages(spark: SparkSession, d: str, labelled: DataFrame) -> DataFrame:
    model = langid.fit_on(labelled, "raw_id", "text", "label", table=d)
    return langid.detect(labelled, "raw_id", "text", model, keep=["label"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = _languages(spark, d, _labelled(spark, d))
    return found.where("languages > 1 or label is null or label <> language").select("raw_id", "language")


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    found = _languages(spark, d, _labelled(spark, d))
    return found.select("raw_id", "language", F.explode("segments").alias("s")).select("raw_id", "language", "s.start", "s.stop", "s.confidence")


def _ends(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source", F.length("text").alias("chars"))
    return truncation.flag(docs, "doc_id", "text", "source", "chars", truncation.fit_on(docs, "doc_id", "text", table=d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _ends(spark, d).where("truncated").select("doc_id")


def p10_at_limits(spark: SparkSession, d: str) -> DataFrame:
    """Only what the hazards of lengths tell: incomplete endings at significant lengths."""
    return _ends(spark, d).where("at_limit").select("doc_id")


def p10_source_rates(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("truncated")
    return _ends(spark, d).groupBy("source").agg(
        F.count("*").alias("texts"), F.count_if(hit).alias("truncated"), F.count_if("at_limit").alias("at_fixed_length"), F.avg(hit.cast("double")).alias("rate")
    )


def p10_lengths(spark: SparkSession, d: str) -> DataFrame:
    return truncation.significant_lengths(table(spark, d, "documents").select("source", F.length("text").alias("chars")), "source", "chars").select("source", "pooled", "length", "n")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """All matches with their confidence: two place_ids, or a place_id and a raw_id."""
    places = table(spark, d, "raw_places")
    reviews = table(spark, d, "raw_reviews").select("raw_id", "restaurant_hint", "city_id", "lat", "lng")
    matches, members, mentions = linkage.link(places, reviews, table(spark, d, "cities").select("id", "lat", "lng", "radius_m"))
    matches = matches.where("confidence > 0.5")
    b = members.select(F.col("place_id").alias("id_b"), F.col("rid").alias("b"))
    pairs = matches.where("not hint").join(members.select(F.col("place_id").alias("id_a"), F.col("rid").alias("a")), "a").join(b, "b")
    hints = matches.where("hint").join(mentions.select(F.col("raw_id").alias("id_a"), F.col("rid").alias("a")), "a").join(b, "b")
    both = pairs.select("id_a", "id_b", "confidence").unionByName(hints.select("id_a", "id_b", "confidence"))
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "confidence")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).select("id_a", "id_b")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their tokens, counted once."""
    return settle(token_counts(table(spark, d, "documents"), "doc_id", "text", ["source", "lang"]), "tokens")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_items(_sized(spark, d), "doc_id", "tokens", table(spark, d, "containers"))


def p8_fill_rates(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(p8_packed(spark, d), table(spark, d, "containers"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), "doc_id", "source", "lang", "tokens", table(spark, d, "mix_targets"), DOMAINS)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


QUERIES = {"p1_found": p1_found, "p1_top_ten": p1_top_ten, "p3_found": p3_found, "p3_redacted": p3_redacted,
    "p4_found": p4_found, "p4_scores": p4_scores, "p4_source_rates": p4_source_rates, "p6_found": p6_found, "p6_segments": p6_segments,
    "p10_found": p10_found, "p10_at_limits": p10_at_limits, "p10_source_rates": p10_source_rates, "p10_lengths": p10_lengths,
    "p7_found": p7_found, "p7_matches": p7_matches,
    "p8_packed": p8_packed, "p8_fill_rates": p8_fill_rates, "p9_mix": p9_mix, "p9_shares": p9_shares,
}

_P1 = """
with last as (
  select * from dish_scores qualify row_number() over (partition by dish_id, restaurant_id, city_id order by computed_at desc nulls last, score_id desc) = 1),
ranked as (
  select *, cast(row_number() over (partition by city_id, dish_id order by score desc, mention_count desc nulls last, restaurant_id) as int) as rank
  from last where lower(trim(status)) = 'ranked' and not isnan(score) and score between 0 and 100)
"""

SQL = {
    "p1_found": _P1 + "select city_id, dish_id, restaurant_id from ranked where rank <= 3",
    "p1_top_ten": _P1 + "select city_id, dish_id, restaurant_id, score, rank from ranked where rank <= 10",
    "p10_lengths": """
with own as (select source, false as pooled, length(text) as length, count(*) as n from documents where length(text) > 0 group by all),
per as (select * from own union all select null, true, length, sum(n) from own group by length),
a as (select *, sum(n) over (partition by source, pooled order by length rows between current row and unbounded following) as at_risk,
  sum(n) over (partition by source, pooled order by length range between 25 preceding and 25 following) - sum(n) over (partition by source, pooled order by length range between 1 preceding and 1 following) as deaths from per),
b as (select *, greatest((deaths + 1.0) / (at_risk * least(48, length + 24)), 1e-12) * at_risk as mu from a),
c as (select *, case when n > mu then exp(-(n * ln(n / mu) - n + mu)) else 1 end as p, count(*) over () as tests from b),
d as (select *, row_number() over (order by p, pooled, source nulls first, length) as rk from c where p <= 0.01)
select source, pooled, length, cast(n as bigint) as n from d where rk <= (select max(rk) from d where p <= rk / tests * 0.01)""",
}
