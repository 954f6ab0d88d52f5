"""Mixing sources to target weights by hierarchical budgeting.

The texts form a tree (domain, language, source). A source's target share is laid over its languages as its tokens are, so
that a leaf (domain, language, source) has a weight, a language the sum of its leaves' and a domain that of its languages'.
The total is handed down by weight; a node that cannot use its share (all its texts, repeated as often as they may be) leaves
the rest to its siblings, and only what they cannot use either goes up to the siblings of their parent. Each leaf fills its
budget with whole epochs of its texts and a prefix, by tokens, of one more epoch in an order seeded by a hash.

Defined results: texts of no listed source, or with 0 tokens, are not used; a null language is a language of its own; if
all sources together cannot fill the total, everything is used as often as allowed; equal hashes are ordered by id; an
empty table gives no rows. The order of an epoch is found in two steps (sums of hash ranges, then the one range in which
the prefix ends), so no leaf is ever sorted as a whole. The tree is budgeted on the driver; one of more than MOST_LEAVES
leaves, which no column of sources and languages should have, is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: hash ranges of an epoch, as a power of two
RANGE_BITS = 12
#: more leaves than this are an error
MOST_LEAVES = 100_000


@dataclass
class Node:
    weight: float = 0.0
    capacity: float = 0.0
    kids: dict = field(default_factory=dict)
    budget: float = 0.0


def share_out(node: Node, total: float) -> float:
    """Gives the node what it can use of total, and its children theirs; returns what is used."""
    node.budget = min(total, node.capacity)
    left, open_kids = node.budget, {k: c for k, c in node.kids.items() if c.weight > 0 and c.capacity > 0}
    for c in node.kids.values():
        c.budget = 0.0
    # who is full at the present rate is filled and leaves the rest to the others
    while open_kids and left > 1e-9:
        weights = sum(c.weight for c in open_kids.values())
        full = [k for k, c in open_kids.items() if c.capacity - c.budget <= left * c.weight / weights + 1e-9]
        if not full:
            for c in open_kids.values():
                c.budget += left * c.weight / weights
            left = 0.0
        for k in full:
            c = open_kids.pop(k)
            left -= c.capacity - c.budget
            c.budget = c.capacity
    if node.kids:
        node.budget -= max(0.0, left)
        for c in node.kids.values():
            share_out(c, c.budget)
    return node.budget


def budgets(leaves: list[tuple[str, str, float]], targets: dict[str, tuple[float, int]], domains: dict[str, str], total: float | None = None) -> dict[tuple[str, str], float]:
    """Tokens of every (source, language). leaves: (source, language, tokens there are); targets: share and most repeats."""
    there: dict[str, float] = {}
    for source, _, tokens in leaves:
        there[source] = there.get(source, 0.0) + max(tokens, 0.0)
    root = Node(1.0)
    for source, lang, tokens in leaves:
        if source not in targets or tokens <= 0:
            continue
        share, repeats = targets[source]
        leaf = Node(share * tokens / there[source], tokens * repeats)
        domain = root.kids.setdefault(domains.get(source, source), Node())
        speech = domain.kids.setdefault(lang, Node())
        speech.kids[source] = leaf
        for node in (root, domain, speech):
            node.weight += leaf.weight
            node.capacity += leaf.capacity
    share_out(root, min(root.capacity, sum(x[2] for x in leaves) if total is None else total))
    return {(source, lang): leaf.budget for domain in root.kids.values() for lang, speech in domain.kids.items() for source, leaf in speech.kids.items()}


def _small(df: DataFrame, what: str) -> list:
    rows = df.limit(MOST_LEAVES + 1).collect()
    if len(rows) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} {what}")
    return rows


def mix(items: DataFrame, id_col: str, source: str, language: str, size: str, targets: DataFrame, domains: dict[str, str], total: float | None = None, seed: int = 1) -> DataFrame:
    """(id, source, language, tokens, repeats) of all texts used. targets: source, target_share, max_repeats."""
    spark = items.sparkSession
    rows = items.where((F.col(size) > 0) & F.col(source).isNotNull()).select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.coalesce(F.col(language), F.lit("?")).alias("language"), F.col(size).cast("long").alias("tokens"))
    want = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in _small(targets.where("source is not null"), "targets")}
    there = [(r["source"], r["language"], float(r["t"])) for r in _small(rows.groupBy("source", "language").agg(F.sum("tokens").alias("t")), "leaves")]
    plan, epochs = [], {(s, lang): t for s, lang, t in there}
    for (s, lang), b in budgets(there, want, domains, total).items():
        whole = int((b + 1e-6) // epochs[s, lang])
        plan.append((s, lang, whole, int(round(b - whole * epochs[s, lang])), want[s][1]))
    plan = spark.createDataFrame(plan, "source string, language string, whole int, prefix long, most int")
    rows = rows.join(F.broadcast(plan), ["source", "language"])  # at most MOST_LEAVES rows
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "whole", "id")).withColumn("range", F.shiftrightunsigned("order", 64 - RANGE_BITS).cast("int"))
    leaf = ["source", "language"]
    sums = rows.groupBy(*leaf, "range", "prefix").agg(F.sum("tokens").alias("t"))
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(W.partitionBy(*leaf).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("state", F.when(F.col("before") + F.col("t") <= F.col("prefix"), 1).when(F.col("before") >= F.col("prefix"), 0).otherwise(2)).drop("prefix", "t")
    rows = rows.join(sums, [*leaf, "range"])
    edge = rows.where("state = 2")
    edge = edge.withColumn("upto", F.col("before") + F.sum("tokens").over(W.partitionBy(*leaf).orderBy("order", "id").rowsBetween(W.unboundedPreceding, 0)))
    edge = edge.withColumn("extra", (F.col("upto") <= F.col("prefix")).cast("int")).drop("upto")
    rest = rows.where("state <> 2").withColumn("extra", F.col("state"))
    used = rest.unionByName(edge).withColumn("repeats", F.least(F.col("whole") + F.col("extra"), F.col("most"))).where("repeats > 0")
    return used.select(F.col("id").alias(id_col), "source", "language", "tokens", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, texts, tokens, share, most_repeats): what each source came to."""
    per = mixed.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    total = per.agg(F.sum("tokens").alias("all_tokens"))
    out = targets.join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = F.coalesce(F.col("tokens"), F.lit(0))
    return out.select("source", "target_share", "max_repeats", F.coalesce("texts", F.lit(0)).alias("texts"), zero.alias("tokens"), (zero / F.col("all_tokens")).alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
