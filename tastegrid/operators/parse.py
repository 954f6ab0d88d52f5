"""Search strings to filters, as columns, for any number of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: words that carry no dish
NOISE = ["best", "top", "famous", "popular", "must try", "near me", "the", "a", "some", "good", "food", "place", "places"]
SUPERLATIVES = ["best", "top", "famous", "popular", "must try"]


def parse_queries(df: DataFrame, id_col: str, query: str) -> DataFrame:
    """(id, superlative, near_me, min_price, max_price, area, dish). Absent parts are null, an empty query has the dish ''."""
    q = F.lower(F.btrim(F.col(query)))
    df = df.select(id_col, q.alias("q"))
    number = lambda pattern: F.nullif(F.regexp_extract("q", pattern, 1), F.lit("")).cast("int")
    both = F.contains(F.col("q"), F.lit("between"))
    area = r"\b(?:in|near|around) ([a-z ]+)$"
    rest = F.btrim(F.regexp_replace("q", area, ""))
    words = lambda ws: r"\b(?:" + "|".join(ws) + r")\b"
    return df.select(
        id_col, F.rlike("q", F.lit(words(SUPERLATIVES))).alias("superlative"), F.contains(F.col("q"), F.lit("near me")).alias("near_me"),
        F.when(both, number(r"between\s*(\d{2,5})")).otherwise(number(r"(?:over|above|more than)\s*(\d{2,5})")).alias("min_price"),
        F.when(both, number(r"between\s*\d{2,5}\s*(?:and|to|-)\s*(\d{2,5})")).otherwise(number(r"(?:under|below|less than|within|up to)\s*(\d{2,5})")).alias("max_price"),
        F.nullif(F.regexp_extract("q", area, 1), F.lit("")).alias("area"), F.btrim(F.regexp_replace(F.regexp_replace(rest, words(NOISE), ""), r"\s+", " ")).alias("dish"),
    )
