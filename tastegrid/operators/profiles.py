"""Short profiles of places: chips for what stands out, in a fixed order of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: order of the groups of chips; at most one chip of a group marked 1
GROUPS = ["signature_dish", "spice", "price", "portion", "consistency", "ambience", "timing", "hygiene", "trend", "cuisine"]
SINGLE = ["price", "consistency", "trend"]
# fixed values: attribute, chip, group
FROM_ATTRIBUTES = [("spicy", "spicy", "spice"), ("generous_portion", "generous", "portion"), ("small_portion", "small_portions", "portion"), ("oily", "oily", "portion"), ("late_night", "late_night", "timing"), ("authentic", "authentic", "ambience")]
CHIP = "struct<g:int,v:double,code:string>"


def _chip(group: str, code, value) -> Column:
    return F.struct(F.lit(GROUPS.index(group)).alias("g"), (-F.coalesce(value.cast("double"), F.lit(0.0))).alias("v"), (F.lit(code) if isinstance(code, str) else code).alias("code"))


def profile_chips(df: DataFrame, key: str, most: int = 6) -> DataFrame:
    """(key, chips array<string>).

    Needs: mentions, dishes array<struct<name,sentiment,mentions>>, attributes map<string,bigint>, aspects map<string,double>,
    price_ratio (own mean price to the city's median), consistency, trend, cuisines array<string>; any of them may be null.
    Below three mentions there are no chips; without any other chip the first two cuisines are shown.
    """
    n = F.col("mentions")
    count = lambda a: F.coalesce(F.try_element_at("attributes", F.lit(a)), F.lit(0))
    aspect = lambda a: F.try_element_at("aspects", F.lit(a))
    enough = F.greatest(F.lit(2), F.floor(n * 0.15))
    strong = F.filter(F.slice(F.array_sort(F.transform("dishes", lambda d: F.struct((-d["mentions"]).alias("k"), d["name"].alias("name"), d["sentiment"].alias("s"), d["mentions"].alias("m")))), 1, 3), lambda d: (d["m"] >= 3) & (d["m"] / n >= 0.25) & (d["s"] >= 0.7))
    strong = F.coalesce(F.transform(strong, lambda d: _chip("signature_dish", F.concat(F.lit("strong_"), F.replace(F.lower(d["name"]), F.lit(" "), F.lit("_"))), d["s"])), F.array().cast(f"array<{CHIP}>"))
    ratio, steady = F.col("price_ratio"), F.col("consistency")
    found = [F.when(count(a) >= (F.lit(2) if a == "late_night" else enough), _chip(g, code, count(a))) for a, code, g in FROM_ATTRIBUTES]
    found += [
        F.when(ratio <= 0.75, _chip("price", "affordable", ratio)).when(ratio >= 1.4, _chip("price", "premium", ratio)).when(ratio.isNotNull(), _chip("price", "mid_range", ratio)),
        F.when((n >= 8) & (steady >= 0.75), _chip("consistency", "consistent", steady)).when((n >= 8) & (steady <= 0.35), _chip("consistency", "inconsistent", steady)),
        F.when((n >= 5) & (aspect("service") >= 0.5), _chip("ambience", "great_service", aspect("service"))).when((n >= 5) & (aspect("service") <= -0.4), _chip("ambience", "slow_service", aspect("service"))),
        F.when(aspect("hygiene") <= -0.4, _chip("hygiene", "hygiene_concerns", aspect("hygiene"))), F.when(aspect("ambience") >= 0.5, _chip("ambience", "good_ambience", aspect("ambience"))),
        F.when(F.col("trend") == "rising", _chip("trend", "rising", F.lit(None))).when(F.col("trend") == "declining", _chip("trend", "declining", F.lit(None))),
    ]
    chips = F.slice(F.array_sort(F.concat(strong, F.array_compact(F.array(*found)))), 1, most)
    fallback = F.coalesce(F.transform(F.slice("cuisines", 1, 2), lambda c: F.lower(c)), F.array().cast("array<string>"))
    df = df.withColumn("_chips", F.transform(chips, lambda c: c["code"]))
    none = F.array().cast("array<string>")
    return df.select(key, F.when(F.coalesce(n, F.lit(0)) < 3, none).when(F.size("_chips") > 0, F.col("_chips")).otherwise(fallback).alias("chips"))
