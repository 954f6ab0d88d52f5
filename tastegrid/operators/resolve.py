"""Resolving incoming places against a catalogue, with refusal of ambiguous matches.

Candidates come from the same source key, from within a kilometre (strip sweep), or, for places without coordinates, from
a shared rarest word. Each pair gets the best tier it reaches; of an incoming place's candidates the most confident wins
unless the next one is of the same tier and as good as equal.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegrid.functions.numeric import haversine_m
from tastegrid.functions.text import normalize_name, tokens
from tastegrid.operators.geo_near import points_in_regions

EXACT_M, CHAIN_M, STRONG, MODERATE, MARGIN = 250.0, 1000.0, 0.92, 0.82, 0.05


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        if not x or not y:
            out.append(0.0)
            continue
        tx, ty = set(x.split()), set(y.split())
        both = len(tx & ty)
        sequence = difflib.SequenceMatcher(None, x, y).ratio()
        out.append(round(max(sequence, both / len(tx | ty), 0.85 * both / min(len(tx), len(ty))), 4))
    return pd.Series(out, dtype="float64")


def name_similarity(a, b) -> Column:
    """Of two normalised names: the best of sequence ratio, token overlap and 0.85 of containment (an Arrow function)."""
    return F.pandas_udf(_similar, "double")(a, b)


def _rarest(df: DataFrame, id_col: str, words: DataFrame) -> DataFrame:
    """(id, word): the word of each normalised name that fewest catalogue names have."""
    w = df.select(id_col, F.explode(F.array_distinct(tokens("norm"))).alias("word")).join(words, "word")
    return w.groupBy(id_col).agg(F.min_by("word", F.struct("c", "word")).alias("word"))


def resolve(incoming: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(row_id, matched_id, method, confidence, runner_up_id).

    incoming: row_id, name, lat, lng, source, external_id. catalogue: id, normalized_name, lat, lng, aliases, source_keys.
    A blank name without a known source key is new with confidence 0; no candidate is new with 0.3; null columns match nothing.
    """
    inc = incoming.withColumn("norm", normalize_name("name"))
    cat = catalogue.select("id", F.col("normalized_name").alias("norm"), F.col("lat").alias("clat"), F.col("lng").alias("clng"), "aliases", "source_keys")
    keys = cat.select("id", F.explode("source_keys").alias("k")).select("id", "k.source", "k.external_id")
    by_key = inc.join(keys, ["source", "external_id"]).groupBy("row_id").agg(F.min("id").alias("key_id"))

    named = inc.where("norm <> ''")
    placed = named.where("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)")
    near = points_in_regions(catalogue.select("id", "lat", "lng"), "id", placed.select("row_id", "lat", "lng", F.lit(CHAIN_M).alias("reach")), "row_id", "reach").select(F.col("region_id").alias("row_id"), "id")
    words = cat.select(F.explode(F.array_distinct(tokens("norm"))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    lost = named.join(placed.select("row_id"), "row_id", "left_anti")
    shared = _rarest(lost, "row_id", words).join(cat.select("id", F.explode(F.array_distinct(tokens("norm"))).alias("word")), "word").select("row_id", "id")
    pairs = near.unionByName(shared).distinct().join(named.select("row_id", F.col("norm").alias("a"), "lat", "lng"), "row_id").join(cat.drop("source_keys").withColumnRenamed("norm", "b"), "id")
    usable = F.col("lat").isNotNull() & ~F.isnan("lat") & F.col("clat").isNotNull() & ~F.isnan("clat")
    pairs = pairs.withColumn("d", F.when(usable, haversine_m("lat", "lng", "clat", "clng"))).withColumn("s", name_similarity("a", "b"))
    alias = F.exists("aliases", lambda x: normalize_name(x) == F.col("a"))
    tier = (
        F.when((F.col("a") == F.col("b")) & (F.col("d") <= EXACT_M), F.struct(F.lit("exact_name").alias("method"), F.lit(0.95).alias("confidence")))
        .when(alias & (F.col("d") <= CHAIN_M), F.struct(F.lit("alias").alias("method"), F.lit(0.90).alias("confidence")))
        .when((F.col("s") >= MODERATE) & (F.col("d") <= EXACT_M), F.struct(F.lit("fuzzy_geo").alias("method"), (0.60 + 0.4 * F.col("s")).alias("confidence")))
        .when((F.col("s") >= STRONG) & (F.col("d").isNull() | (F.col("d") <= CHAIN_M)), F.struct(F.lit("fuzzy_strict").alias("method"), (0.55 + 0.3 * F.col("s")).alias("confidence")))
    )
    pairs = pairs.withColumn("t", tier).where("t is not null").select("row_id", "id", "t.method", "t.confidence")
    w = W.partitionBy("row_id").orderBy(F.col("confidence").desc(), "id")
    pairs = pairs.withColumns({"rn": F.row_number().over(w), "next_id": F.lead("id").over(w), "next_method": F.lead("method").over(w), "next_confidence": F.lead("confidence").over(w)}).where("rn = 1")
    tie = F.coalesce((F.col("next_method") == F.col("method")) & (F.col("confidence") - F.col("next_confidence") <= MARGIN), F.lit(False))
    best = pairs.select("row_id", F.when(~tie, F.col("id")).alias("best_id"), F.when(tie, "ambiguous").otherwise(F.col("method")).alias("best_method"), F.round("confidence", 3).alias("best_confidence"), "next_id")
    out = inc.select("row_id", "norm").join(by_key, "row_id", "left").join(best, "row_id", "left")
    known = F.col("key_id").isNotNull()
    return out.select(
        "row_id", F.coalesce("key_id", "best_id").alias("matched_id"), F.when(known, "source_key").otherwise(F.coalesce("best_method", F.lit("new"))).alias("method"),
        F.when(known, 1.0).when(F.col("norm") == "", 0.0).otherwise(F.coalesce("best_confidence", F.lit(0.30))).alias("confidence"), F.when(~known, F.col("next_id")).alias("runner_up_id"),
    )
