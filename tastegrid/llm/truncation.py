"""Texts that lost their end.

Limits: for each source, and for all sources pooled, and each length, the share of the texts at least that long which end
just there (a discrete hazard). Each hazard is tested against those of neighbouring lengths (a Chernoff bound of the Poisson
tail) under Benjamini-Hochberg control, by window functions over all rows. A text of a significant length whose ending looks
incomplete is flagged `at_limit`: this is the method named. Texts cut in mid-transfer end at no fixed length, so no hazard
of lengths can tell them; they are flagged, as `truncated` only, on stronger evidence from the ending (see README).

How incomplete an ending looks is learnt from the texts themselves by a factorization machine over hashed terms (words at
the start and end of the last sentence, and their pairs): whole sentences against the same sentences cut at a random
place, from a bounded sample of texts (`sample_rows`, those of smallest hash of their id; `max_sentences` of theirs). Texts
that begin and end alike in many documents, such as greetings, are thereby known as complete. Hosts of links are counted in
all texts: a final link whose host is named fewer than `least_host` times in full is broken.

Defined results: null and empty texts aren't flagged; equal texts of one source are flagged alike; a null source is a
source of its own; an empty table gives no rows; the whole text counts for its length, the whole last sentence for its ending.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegrid.llm.models import stored
from tastegrid.llm.safety import BUCKETS, FactorizationMachine
from tastegrid.session import spread

ABBREVIATED = re.compile(r"(?:^|[\s(])(?:rs|mr|mrs|ms|dr|no|st|rd|ln|vs|approx|e\.g|i\.e|[a-z])\.$", re.I)
MARKER = re.compile(r"(?:…|\.{2,}|\(cont\.?\)|\(continued\)|\[more\]|\[\.\.\.\]|\[…\]|read more|see more|see full text|continue reading)\s*$", re.I)
EXPLICIT = re.compile(r"(?:\(cont\.?\)|\(continued\)|\[more\]|read more|see more|see full text|continue reading)\s*$", re.I)
LINK = re.compile(r"https?://([^\s/]*)(\S*)$", re.I)
STOP = re.compile(r"[.!?।]+[\"'”’)\]]*\s+|\n+")
CLOSERS = frozenset(")]}\"”»")
QUOTES = "\"'”’)]»"
SMILEY = re.compile(r"[:;][-']?[()DPp]$")
BROKEN = re.compile(r"<[a-z/]{0,6}$|&#?\w{0,6}$|�+$|https?:/{0,2}$|[(\[{₹$€#@/&+=,:;–—-]$")
DIGIT = re.compile(r"\d")
WORD = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*|[₹$€%&@#]")


def significant_lengths(df: DataFrame, source: str, length: str, reach: int = 25, fdr: float = 0.01) -> DataFrame:
    """(source, pooled, length, n, expected, p): lengths at which far more texts of the source end than at those around.

    Rows with pooled = true (and a null source) are of all sources together. The ranks of Benjamini and Hochberg need one
    order of all tests with p <= fdr: at most one row a source and length, whatever the number of texts."""
    per = df.where(F.col(length) > 0).groupBy(F.col(source).alias("source"), F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n")).withColumn("pooled", F.lit(False))
    per = per.unionByName(per.groupBy("length").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("source"), "length", "n", F.lit(True).alias("pooled")))
    by = W.partitionBy("source", "pooled").orderBy("length")
    per = per.withColumn("at_risk", F.sum("n").over(by.rowsBetween(0, W.unboundedFollowing)))
    around = by.rangeBetween(-reach, reach)
    here = by.rangeBetween(-1, 1)
    per = per.withColumn("deaths", F.sum("n").over(around) - F.sum("n").over(here))
    # lengths at which nothing ends count as exposed too; their number at risk is about that of this length
    per = per.withColumn("exposed", F.col("at_risk") * F.least(F.lit(2 * reach - 2), F.col("length") + reach - 1))
    mu = F.greatest((F.col("deaths") + 1.0) / F.col("exposed"), F.lit(1e-12)) * F.col("at_risk")
    k = F.col("n").cast("double")
    per = per.withColumn("expected", mu)
    per = per.withColumn("p", F.when(k > F.col("expected"), F.exp(-(k * F.log(k / F.col("expected")) - k + F.col("expected")))).otherwise(1.0))
    tests = per.agg(F.count("*").alias("tests"))
    small = per.where(F.col("p") <= fdr).crossJoin(F.broadcast(tests))  # one row of one number
    small = small.withColumn("rank", F.row_number().over(W.orderBy("p", "pooled", "source", "length")))
    small = small.withColumn("last", F.max(F.when(F.col("p") <= F.col("rank") / F.col("tests") * fdr, F.col("rank"))).over(W.partitionBy()))
    return small.where("rank <= last").select("source", "pooled", "length", "n", "expected", "p")


def strip_end(text: str) -> tuple[str, bool]:
    """The text without trailing blanks, pictures and marks of continuation; whether such a mark was there."""
    t, marked = text.rstrip(), False
    while (m := MARKER.search(t, max(0, len(t) - 40))) and m.start():
        t, marked = t[: m.start()].rstrip(), True
    return t, marked


def last_sentence(t: str) -> str:
    """What follows the last stop that ends no abbreviation; looked for from the end in growing stretches."""
    reach = 400
    while True:
        a = max(0, len(t) - reach)
        found = [m.end() for m in STOP.finditer(t, a) if not ABBREVIATED.search(t[max(0, m.start() - 8) : m.start() + 1])]
        if found or not a:
            return t[found[-1] :] if found else t
        reach *= 4


def final_host(text: Column) -> Column:
    """The host, in small letters, of the link a text ends with; null if it ends with none."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)https?://([^\s/]*)\S*\s*$", 1)), F.lit(""))


def ending(text: str, known_host: bool = True) -> tuple[str, str]:
    """("closed" | "broken" | "open", last sentence). A final link is broken if its host isn't known or nothing follows it."""
    if EXPLICIT.search(text, max(0, len(text) - 40)):
        return "broken", ""
    t, marked = strip_end(text)
    if not t:
        return "closed", ""
    if not marked and unicodedata.category(t[-1]) in ("So", "Sk", "Mn", "Cf", "Cs") and not "ऀ" <= t[-1] <= "৿":
        return "closed", ""
    if "://" in (word := t.rsplit(None, 1)[-1]) and (link := LINK.search(word)):
        return ("closed" if known_host and len(link[2]) > 1 else "broken"), ""
    if (t[-1] in CLOSERS or SMILEY.search(t, max(0, len(t) - 3)) or t.rstrip(QUOTES)[-1:] in tuple(".!?।")) and not ABBREVIATED.search(t[-12:]):
        return "closed", ""
    return ("broken" if BROKEN.search(t, max(0, len(t) - 20)) else "open"), last_sentence(t)


def _shape(w: str) -> str:
    return w if w.isalpha() else DIGIT.sub("0", w)


def end_terms(sentence: str) -> list[int]:
    """Hashed terms of how a sentence begins and ends."""
    ws = [_shape(w) for w in WORD.findall(sentence.lower())]
    if not ws:
        return [1]
    n = len(ws)
    a1, a2, a3 = ws[0], " ".join(ws[:2]), " ".join(ws[:3])
    z1, z2, z3, z4 = ws[-1], " ".join(ws[-2:]), " ".join(ws[-3:]), " ".join(ws[-4:])
    out = [
        f"z1:{z1}", f"z2:{z2}", f"z3:{z3}", f"z4:{z4}", f"a1:{a1}", f"a2:{a2}", f"a3:{a3}", f"a1z1:{a1}|{z1}", f"a2z1:{a2}|{z1}",
        f"a2z2:{a2}|{z2}", f"a3z1:{a3}|{z1}", f"n:{min(n, 25)}", f"a2n:{a2}|{min(n, 25)}", f"all:{' '.join(ws) if n < 6 else ''}",
    ]
    if n > 1:
        out += [f"y{j}:{ws[-j]}" for j in range(2, min(6, n) + 1)]
    out += ["w:" + w for w in set(ws[:12])]
    last = sentence.rstrip()[-1:]
    if not last.isalnum():
        out.append("c:" + unicodedata.category(last or " "))
    return list(dict.fromkeys(1 + zlib.crc32(f.encode()) % (BUCKETS - 1) for f in out))


def fit(texts: list[str], max_sentences: int = 40_000, seed: int = 7) -> FactorizationMachine:
    """The machine (1 = incomplete)."""
    r = random.Random(seed)
    whole, finals = [], []
    for t in texts:
        kind, last = ending(t)
        if kind == "open" and last and not LINK.search(last):
            finals.append(last)
        at = 0
        for m in STOP.finditer(t):
            if not ABBREVIATED.search(t[max(0, m.start() - 8) : m.start() + 1]):
                if t[at : m.start()].strip():
                    whole.append(t[at : m.start()])
                at = m.end()
    r.shuffle(whole)
    whole = whole[:max_sentences]
    r.shuffle(finals)
    rows, y, weight = [], [], []
    for s in whole:
        rows.append(end_terms(s))
        y.append(0.0)
        weight.append(1.0)
        for _ in range(2):
            cut = s[: r.randrange(1, max(2, len(s)))].rstrip()
            if cut and cut != s:
                rows.append(end_terms(cut))
                y.append(1.0)
                weight.append(0.5)
    # most open endings are complete in their way; what the cut sentences say outweighs the few that are not
    for s in finals[: max_sentences // 2]:
        rows.append(end_terms(s))
        y.append(0.0)
        weight.append(0.5)
    model = FactorizationMachine(seed=seed)
    if rows:
        model.fit(rows, np.array(y), np.array(weight), epochs=4, batch=256, l2=1e-5, seed=seed)
    return model


def fit_on(df: DataFrame, id_col: str, text: str, sample_rows: int = 12_000, table: str = "") -> FactorizationMachine:
    """Fits to the sample_rows texts with the smallest hash of their id."""
    rows = df.where(F.length(text) > 0).select(id_col, text).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).toPandas()
    texts = rows[text].tolist()
    return stored(df.sparkSession, table, "truncation", (sample_rows,), texts, lambda: fit(texts))


def flag(df: DataFrame, id_col: str, text: str, source: str, length: str, model: FactorizationMachine, at_length: float = 0.2, elsewhere: float = 0.4, least_host: int = 3) -> DataFrame:
    """(id, source, length, significant, ending, incomplete, at_limit, truncated) of every row."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.b, model.w, model.v))

    @F.pandas_udf("struct<ending:string,incomplete:double>")
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = FactorizationMachine(rank=1)
        m.b, m.w, m.v = shared.value
        for s, known in batches:
            ends = [ending(t, bool(k)) if isinstance(t, str) else ("closed", "") for t, k in zip(s, known)]
            score = np.array([{"closed": 0.0, "broken": 1.0}.get(k, 0.5) for k, _ in ends])
            at = [i for i, (k, _) in enumerate(ends) if k == "open"]
            if at:
                score[at] = m.score([end_terms(ends[i][1]) for i in at])
            yield pd.DataFrame({"ending": [k for k, _ in ends], "incomplete": score})

    rows = df.select(id_col, F.col(source).alias("source"), F.col(length).cast("long").alias("length"), F.col(text).alias("text"), final_host(F.col(text)).alias("host"))
    full = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(?i)https?://([^\s/]+)/"), F.lit(1)), lambda h: F.lower(h))
    hosts = df.select(F.explode(full).alias("_h")).groupBy("_h").agg(F.count("*").alias("_c")).where(F.col("_c") >= least_host).select("_h")
    # the few texts that end with a link meet the counts of hosts; the rest passes by
    plain, linked = rows.where("host is null").withColumn("known", F.lit(False)), rows.where("host is not null")
    linked = linked.join(hosts, F.col("host") == F.col("_h"), "left").withColumn("known", F.col("_h").isNotNull()).drop("_h")
    rows = spread(plain).unionByName(linked).withColumn("look", look("text", "known"))
    peaks = significant_lengths(df, source, length).select(F.col("source").alias("_s"), F.col("length").alias("_l"), "pooled")
    own, pooled = peaks.where("not pooled").drop("pooled"), peaks.where("pooled").select(F.col("_l").alias("_p"))
    rows = rows.select(id_col, "source", "length", "look.ending", "look.incomplete")
    rows = rows.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("length") == F.col("_l")), "left").join(pooled, F.col("length") == F.col("_p"), "left")
    rows = rows.withColumn("significant", F.col("_l").isNotNull() | F.col("_p").isNotNull()).drop("_s", "_l", "_p")
    at_limit = F.col("significant") & (F.col("incomplete") > at_length)
    return rows.withColumns({"at_limit": at_limit, "truncated": at_limit | (F.col("incomplete") > elsewhere)})
