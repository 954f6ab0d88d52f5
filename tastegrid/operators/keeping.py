"""Keeping tables up to date: keyed replacement, unique names, merged entities, place upserts; checks on extracted text."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegrid.functions.text import normalize_name, slugify


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents in `new` give way to the new ones."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def unique_slugs(df: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Adds slug: base, base-2, base-3, ... within the keys, in the order of a column."""
    df = df.withColumn("_base", slugify(name))
    n = F.row_number().over(W.partitionBy(*keys, "_base").orderBy(order))
    return df.withColumn("slug", F.when(n == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", n.cast("string")))).drop("_base")


def merge_entities(facts: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """facts with losers replaced by winners; merges: loser, winner."""
    m = merges.select(F.col("loser").alias("_loser"), F.col("winner").alias("_winner"))
    return facts.join(m, facts[column] == F.col("_loser"), "left").withColumn(column, F.coalesce("_winner", column)).drop("_loser", "_winner")


def upsert_places(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Full outer join by (source, external_id): a new value wins unless it is null or blank; adds action."""
    keys = ["source", "external_id"]
    o = old.select(*keys, *[F.col(f).alias("_o_" + f) for f in fields], F.lit(True).alias("_old"))
    n = new.select(*keys, *[F.col(f).alias("_n_" + f) for f in fields], F.lit(True).alias("_new"))
    j = o.join(n, keys, "full")
    differs = F.lit(False)
    for f in fields:
        value = F.nullif(F.col("_n_" + f).cast("string"), F.lit(""))
        differs = differs | (value.isNotNull() & ~value.eqNullSafe(F.col("_o_" + f).cast("string")))
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").when(differs, "updated").otherwise("skipped")
    merged = [F.when(F.nullif(F.col("_n_" + f).cast("string"), F.lit("")).isNotNull(), F.col("_n_" + f)).otherwise(F.col("_o_" + f)).alias(f) for f in fields]
    return j.select(*keys, *merged, action.alias("action"))


def drop_unsupported(text, allowed: Column, watched: list[str]) -> Column:
    """Sentences that use a watched word which isn't among the allowed ones are left out."""
    sentences = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\."), lambda s: F.btrim(s)), lambda s: s != "")
    bad = lambda s: F.exists(F.array(*map(F.lit, watched)), lambda w: F.array_contains(F.split(normalize_name(s), " "), w) & ~F.array_contains(allowed, w))
    return F.array_join(F.filter(sentences, lambda s: ~bad(s)), ". ")


def _covered(snippet: pd.Series, text: pd.Series) -> pd.Series:
    out = []
    for s, t in zip(snippet, text):
        if not s or not t:
            out.append(0.0)
        elif s in t:
            out.append(1.0)
        else:
            m = difflib.SequenceMatcher(None, s, t, autojunk=False).find_longest_match()
            out.append(m.size / len(s))
    return pd.Series(out, dtype="float64")


def grounded(snippet, text, least: float = 0.9) -> Column:
    """Whether the snippet, or an unbroken part of at least `least` of it, stands in the text (an Arrow function)."""
    return F.pandas_udf(_covered, "double")(normalize_name(snippet), normalize_name(text)) >= least
