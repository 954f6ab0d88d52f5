"""Top N rows of every group under a total order, for very uneven groups.

Exact group counts split the groups into hot and light ones. A group is hot if it has more than `times` the rows of a mean
group, or more than `most_rows`, what a task sorts with ease; so by Markov's inequality at most one group in `times` is hot,
at every size of the input. Light groups go through an ordinary window. Hot ones are salted by range of the first sort key:
the counts per range, added up from the best range downwards, tell which ranges can hold a winner at all; these are cut
further by a hash of the tie key into salts of at most the hot size, ranked per salt, and ranked again over the few survivors.
Nothing is lost: every row of a range that may hold a winner is ranked. Neither list is broadcast by hint; both are joined as
Spark finds fit by their size.

Defined results: groups with null keys are groups; rows with a null or NaN first sort key come last; full ties in all
sort keys are resolved by nothing further, so the sort keys should end in a unique column; empty input gives no rows;
extra columns are carried along, names beginning with "_tn_" are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 64


def latest(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each key under the order; the map side already drops all but one row a key and task."""
    w = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_tn_latest", F.row_number().over(w)).where("_tn_latest = 1")
    return ranked.select(*dict.fromkeys([*keys, *columns]))


def top_n(df: DataFrame, keys: list[str], score: str, ties: list[Column], n: int, tie_key: str, times: float = 20.0, most_rows: int = 100_000) -> DataFrame:
    """The n best rows of each group by score descending, then `ties`; with the rank as column `rank`."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(_desc(score), *ties))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_tn_n"), F.min(_clean(score)).alias("_tn_lo"), F.max(_clean(score)).alias("_tn_hi"))
    mean = sizes.agg(F.least(F.lit(float(most_rows)), F.greatest(F.lit(2.0 * n), F.avg("_tn_n") * times)).alias("_tn_hot"))
    hot = sizes.crossJoin(F.broadcast(mean)).where(F.col("_tn_n") > F.col("_tn_hot"))  # one row of one number
    hot = hot.select(F.struct(*[F.col(k) for k in keys]).alias("_tn_g"), "_tn_lo", "_tn_hi", "_tn_hot")
    marked = df.withColumn("_tn_k", F.struct(*[F.col(k) for k in keys])).join(hot, F.col("_tn_k").eqNullSafe(F.col("_tn_g")), "left")
    light = marked.where("_tn_g is null").select(*df.columns).withColumn("rank", rank).where(F.col("rank") <= n)

    width = F.col("_tn_hi") - F.col("_tn_lo")
    place = F.when(_clean(score).isNull(), RANGES).when(width > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("_tn_hi") - _clean(score)) / width * RANGES).cast("int"))).otherwise(0)
    heavy = marked.where("_tn_g is not null").withColumn("_tn_range", place.cast("int"))
    per = heavy.groupBy("_tn_k", "_tn_range").agg(F.count("*").alias("count"), F.first("_tn_hot").alias("_tn_hot"))
    ahead = F.coalesce(F.sum("count").over(W.partitionBy("_tn_k").orderBy("_tn_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    needed = per.withColumn("_tn_ahead", ahead).where(F.col("_tn_ahead") < n)
    needed = needed.select(F.col("_tn_k").alias("_tn_k2"), F.col("_tn_range").alias("_tn_r2"), F.ceil(F.col("count") / F.col("_tn_hot")).cast("int").alias("_tn_salts"))
    heavy = heavy.join(needed, F.col("_tn_k").eqNullSafe(F.col("_tn_k2")) & (F.col("_tn_range") == F.col("_tn_r2")))
    heavy = heavy.withColumn("_tn_salt", F.pmod(F.xxhash64(tie_key), F.col("_tn_salts")))
    salted = F.row_number().over(W.partitionBy(*keys, "_tn_range", "_tn_salt").orderBy(_desc(score), *ties))
    heavy = heavy.withColumn("_tn_first", salted).where(F.col("_tn_first") <= n).select(*df.columns)
    heavy = heavy.withColumn("rank", rank).where(F.col("rank") <= n)
    return light.unionByName(heavy)


def _clean(score: str) -> Column:
    return F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))


def _desc(score: str) -> Column:
    return _clean(score).desc_nulls_last()
