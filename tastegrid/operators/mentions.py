"""Dictionary matches in texts, near-duplicates among neighbours, text lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegrid.functions.text import hamming, jaccard, normalize_name, simhash, token_set, tokens


def ngrams(texts: DataFrame, id_col: str, text: str, longest: int) -> DataFrame:
    """(id, at, n, gram) for every run of 1..longest tokens of the normalised text."""
    rows = texts.select(F.col(id_col), tokens(text).alias("_t")).where(F.size("_t") > 0)
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_t")))))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("_t") - F.col("n") + 1)))
    return rows.select(id_col, "at", "n", F.array_join(F.slice("_t", F.col("at"), F.col("n")), " ").alias("gram"))


def dictionary_matches(texts: DataFrame, id_col: str, text: str, entries: DataFrame, longest: int = 5) -> DataFrame:
    """(id, alias, key, at): entries (alias, key) found in texts as whole words; of each alias its first place; places inside
    the place of a longer alias do not count. Aliases of more than `longest` words match nothing. Entries with one alias
    and several keys give one row a key."""
    words = entries.where(F.length("alias") > 0).select("alias").distinct()
    found = ngrams(texts, id_col, text, longest).join(words, F.col("gram") == F.col("alias"))
    first = found.groupBy(id_col, "alias", "n").agg(F.min("at").alias("at"))
    # a place lies inside another one of its text if some longer one starts no later and ends no earlier
    spans = F.collect_list(F.struct("at", "n")).over(W.partitionBy(id_col))
    inside = F.exists(F.col("_all"), lambda o: (o["n"] > F.col("n")) & (o["at"] <= F.col("at")) & (o["at"] + o["n"] >= F.col("at") + F.col("n")))
    kept = first.withColumn("_all", spans).where(~inside).drop("_all")
    return kept.join(entries, "alias").select(id_col, "alias", "key", "at")


def single_mentions(matches: DataFrame, id_col: str) -> DataFrame:
    """(id, key, label) of the texts that name exactly one key."""
    return matches.groupBy(id_col).agg(F.count_distinct("key").alias("_k"), F.min("key").alias("key"), F.min("alias").alias("label")).where("_k = 1").drop("_k")


def neighbour_blocks(rows: DataFrame, key: str, time: str, id_col: str, back: int, block: int = 2000) -> DataFrame:
    """Adds _rank (place within the key by time and id), _block and _own, with the `back` rows before each block repeated in it,
    so that no window has to hold a whole key. Ranks come from counts per key and day and places within the day."""
    day = F.to_date(time)
    rows = rows.withColumn("_day", day)
    per = rows.groupBy(key, "_day").agg(F.count("*").alias("_n"))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rows = rows.join(per, rows[key].eqNullSafe(per[key]) & rows["_day"].eqNullSafe(per["_day"])).drop(per[key]).drop(per["_day"])
    rows = rows.withColumn("_rank", F.col("_before") + F.row_number().over(W.partitionBy(key, "_day").orderBy(time, id_col)) - 1)
    own = F.floor(F.col("_rank") / block)
    rows = rows.withColumn("_block", F.explode(F.when(F.col("_rank") % block >= block - back, F.array(own, own + 1)).otherwise(F.array(own))))
    return rows.withColumn("_own", F.col("_block") == own).drop("_day", "_before")


def near_duplicates(reviews: DataFrame, key: str, id_col: str, text: str, time: str, back: int = 40, bits: int = 12, overlap: float = 0.82) -> DataFrame:
    """(id, matched_id, similarity): the likest of the `back` earlier texts of the key within the Hamming distance and the token
    overlap; ties go to the smaller id."""
    rows = reviews.where(F.col(key).isNotNull()).select(key, id_col, time, simhash(text).alias("_h"), token_set(text).alias("_t"))
    rows = neighbour_blocks(rows, key, time, id_col, back)
    w = W.partitionBy(key, "_block").orderBy("_rank").rowsBetween(-back, -1)
    rows = rows.withColumn("_near", F.collect_list(F.struct(F.col(id_col).alias("id"), F.col("_h").alias("h"), F.col("_t").alias("t"))).over(w)).where("_own")
    close = F.filter("_near", lambda o: hamming(o["h"], F.col("_h")) <= bits)
    scored = F.filter(F.transform(close, lambda o: F.struct((-F.round(jaccard(o["t"], F.col("_t")), 4)).alias("s"), o["id"].alias("id"))), lambda x: x["s"] <= -overlap)
    best = F.try_element_at(F.array_sort(scored), F.lit(1))
    return rows.select(id_col, best["id"].alias("matched_id"), (-best["s"]).alias("similarity")).where("matched_id is not null")


def exact_duplicates(rows: DataFrame, id_col: str, fingerprint: Column) -> DataFrame:
    """(id, first_id) of rows that repeat an earlier one."""
    h = rows.select(id_col, fingerprint.alias("_f"))
    first = h.groupBy("_f").agg(F.min(id_col).alias("first_id"), F.count("*").alias("_n")).where("_n > 1")
    return h.join(first, "_f").where(F.col(id_col) != F.col("first_id")).select(id_col, "first_id")


def lookup_by_trigrams(queries: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(query, id, name, similarity) above `least`, through shared trigrams, so that only names with one in common meet.

    queries: query; names: id, name. Similarity is the Jaccard index of the trigram sets."""
    from tastegrid.functions.text import trigrams

    q = queries.select("query", trigrams("query").alias("_q")).withColumn("_qn", F.size("_q"))
    n = names.select("id", "name", trigrams("name").alias("_t")).withColumn("_tn", F.size("_t"))
    pairs = q.select("query", "_qn", F.explode("_q").alias("g")).join(n.select("id", "name", "_tn", F.explode("_t").alias("g")), "g")
    s = pairs.groupBy("query", "_qn", "id", "name", "_tn").agg(F.count("*").alias("c"))
    s = s.withColumn("similarity", F.round(F.col("c") / (F.col("_qn") + F.col("_tn") - F.col("c")), 4))
    return s.where(F.col("similarity") > least).select("query", "id", "name", "similarity")


def prefix_or_similar(queries: DataFrame, names: DataFrame, least: float = 0.3) -> DataFrame:
    """Suggestions: names that begin with the query or resemble it. (query, id, name, similarity)."""
    from tastegrid.functions.text import trigram_similarity

    near = lookup_by_trigrams(queries, names, least)
    begins = names.join(queries, F.startswith(normalize_name("name"), normalize_name("query")) & (F.length("query") > 0))
    begins = begins.select("query", "id", "name", F.round(trigram_similarity("query", "name"), 4).alias("similarity"))
    return near.unionByName(begins).distinct()
