"""Filling containers of fixed capacity: minimum bin slack with subset-sum bitsets.

Items longer than the capacity are cut into pieces of the capacity and a rest; no other item is split. A hash of the
item spreads the pieces over windows of about `window` pieces, which are packed apart from each other. In a window, each
container takes the longest piece left and then the multiset of remaining lengths that comes closest to the capacity: a
bitset of reachable sums grows by the remaining lengths, counts in powers of two, until the capacity is reached or no
length is left, and is traced back to counts.

Defined results: null and empty items (0 tokens) are left out, as they need no container; ties among equal lengths go to
the smaller (id, part); an empty table gives no containers; a capacity that is null or below 1 has none; extra columns
are not read.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (within counts) whose sum comes closest to room from below."""
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach, steps, goal = 1, [], 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return used


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in sizes; every size is at most the capacity."""
    by: dict[int, list[int]] = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        by[sizes[i]].append(i)  # popped from the end: the first position first
    counts = {s: len(v) for s, v in by.items()}
    out = []
    longest = sorted(counts, reverse=True)
    at = 0
    while True:
        while at < len(longest) and not counts.get(longest[at]):
            at += 1
        if at == len(longest):
            return out
        first = longest[at]
        box = [by[first].pop()]
        counts[first] -= 1
        for length, n in fill({s: c for s, c in counts.items() if c and s <= capacity - first}, capacity - first).items():
            counts[length] -= n
            box += [by[length].pop() for _ in range(n)]
        for s in [s for s in (first, *counts) if not counts.get(s, 1)]:
            counts.pop(s, None)
        out.append(box)


def pieces(items: DataFrame, id_col: str, size: str, capacities: DataFrame) -> DataFrame:
    """(container_kind, capacity, id, part, tokens): the pieces of every item for every kind of container.

    capacities is a small table; it is broadcast only below Spark's own size limit.
    """
    kinds = capacities.where("container_kind is not null and capacity_tokens >= 1").select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity"))
    rows = items.where(F.col(size) > 0).select(F.col(id_col).alias("id"), F.col(size).cast("long").alias("size")).crossJoin(kinds)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1)))
    return rows.select("container_kind", "capacity", "id", "part", F.least(F.col("capacity").cast("long"), F.col("size") - F.col("part").cast("long") * F.col("capacity")).cast("int").alias("tokens"))


def pack_items(items: DataFrame, id_col: str, size: str, capacities: DataFrame, window: int = 4000) -> DataFrame:
    """(container_kind, container_id, id, part, tokens); container_id is unique within its kind."""
    parts = pieces(items, id_col, size, capacities)
    full = parts.where("tokens = capacity").select("container_kind", F.concat_ws("-", F.lit("full"), F.col("id").cast("string"), "part").alias("container_id"), "id", "part", "tokens")
    rest = parts.where("tokens < capacity")
    windows = max(1, -(-items.where(F.col(size) > 0).count() // window))
    rest = rest.withColumn("window", F.pmod(F.xxhash64("id", "part"), F.lit(windows)).cast("int"))
    kind = items.schema[id_col].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "id", "part"], ascending=[False, True, True], ignore_index=True)
        box = [""] * len(pdf)
        for n, at in enumerate(pack(pdf["tokens"].tolist(), int(pdf["capacity"].iloc[0]))):
            for i in at:
                box[i] = f"{pdf['window'].iloc[0]}-{n}"
        return pdf.assign(container_id=box)[["container_kind", "container_id", "id", "part", "tokens"]]

    packed = rest.groupBy("container_kind", "window").applyInPandas(run, f"container_kind string, container_id string, id {kind}, part int, tokens int")
    return packed.unionByName(full).withColumnRenamed("id", id_col)


def fill_rates(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, fill): the share of the containers' space that is used."""
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t")).groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    per = per.join(capacities.select("container_kind", "capacity_tokens"), "container_kind")
    return per.select("container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
