"""Counts of distinct items per key and event-time window, corrected by late arrivals up to a cut-off.

Deliveries are replayed in order of arrival into a finger B-tree of partial counts keyed by event time. The
query of a window is answered at its cut-off: it sees just what had arrived before. Behind the oldest window
still to be answered, whole subtrees are evicted at once. Keys with very many items are split over several
trees by a hash of the item; as the items are disjoint, their counts add up.

Defined results: a null key, event time, arrival or window end matches nothing (count 0); deliveries whose event
time lies after their arrival are no evidence; repeated deliveries of an item count once per window, also when
their event times differ; two queries with equal key and window get equal counts; empty input gives counts of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


class _Node:
    __slots__ = ("keys", "vals", "kids", "parent", "total")

    def __init__(self, keys, vals, kids, parent=None):
        self.keys, self.vals, self.kids, self.parent = keys, vals, kids, parent
        self.total = 0


class FingerBTree:
    """B-tree of (time, count) with subtree totals and a finger at the newest leaf.

    insert climbs from the finger only as far as the time is old, then descends; totals of the ancestors change
    along one path. count(lo, hi) covers lo <= time < hi. evict(lo) drops every subtree older than lo.
    """

    ORDER = 32

    def __init__(self) -> None:
        self.root = self.finger = _Node([], [], None)

    def insert(self, time: int, value: int = 1) -> None:
        node = self.finger
        while node.parent is not None and (not node.keys or time < node.keys[0]):
            node = node.parent
        while node.kids is not None:
            i = _right(node.keys, time) - 1
            if i < 0:
                i = 0
                node.keys[0] = time
            node = node.kids[i]
        i = _right(node.keys, time)
        if i and node.keys[i - 1] == time:
            node.vals[i - 1] += value
        else:
            node.keys.insert(i, time)
            node.vals.insert(i, value)
        up = node
        while up is not None:
            up.total += value
            if up.parent is not None and up.parent.kids[0] is up and time < up.parent.keys[0]:
                up.parent.keys[0] = time
            up = up.parent
        if len(node.keys) > self.ORDER:
            self._split(node)

    def _split(self, node: _Node) -> None:
        while len(node.keys) > self.ORDER:
            half = len(node.keys) // 2
            new = _Node(node.keys[half:], node.vals[half:] if node.kids is None else None, node.kids[half:] if node.kids is not None else None)
            del node.keys[half:]
            if node.kids is None:
                del node.vals[half:]
                new.total = sum(new.vals)
            else:
                del node.kids[half:]
                for k in new.kids:
                    k.parent = new
                new.total = sum(k.total for k in new.kids)
            node.total -= new.total
            if self.finger is node:
                self.finger = new
            if node.parent is None:
                self.root = _Node([node.keys[0]], None, [node])
                self.root.total = node.total
                node.parent = self.root
                self.root.total += new.total
            up = node.parent
            i = up.kids.index(node) + 1
            up.kids.insert(i, new)
            up.keys.insert(i, new.keys[0])
            new.parent = up
            node = up

    def before(self, time: int) -> int:
        """Sum over times earlier than `time`."""
        node, out = self.root, 0
        while node.kids is not None:
            i = _left(node.keys, time) - 1
            if i < 0:
                return out
            out += sum(k.total for k in node.kids[:i])
            node = node.kids[i]
        return out + sum(node.vals[: _left(node.keys, time)])

    def count(self, lo: int, hi: int) -> int:
        return self.before(hi) - self.before(lo) if hi > lo else 0

    def evict(self, lo: int) -> None:
        """Forget times earlier than lo: subtrees left of the path to lo go in one cut each."""
        node = self.root
        while True:
            if node.kids is None:
                i = _left(node.keys, lo)
                gone = sum(node.vals[:i])
                del node.keys[:i], node.vals[:i]
            else:
                i = max(0, _right(node.keys, lo) - 1)
                gone = sum(k.total for k in node.kids[:i])
                del node.keys[:i], node.kids[:i]
            up = node
            while gone and up is not None:
                up.total -= gone
                up = up.parent
            if node.kids is None:
                break
            node = node.kids[0]
        while self.root.kids is not None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None


def _right(keys, x):
    lo, hi = 0, len(keys)
    if hi and x >= keys[-1]:
        return hi
    while lo < hi:
        mid = (lo + hi) >> 1
        if x < keys[mid]:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _left(keys, x):
    lo, hi = 0, len(keys)
    while lo < hi:
        mid = (lo + hi) >> 1
        if keys[mid] < x:
            lo = mid + 1
        else:
            hi = mid
    return lo


def window_counts(
    deliveries: DataFrame, windows: DataFrame, key: str, item: list[str], event_time: str, arrival: str, window_id: str, window_end: str,
    length_days: float = 60, lateness_days: float = 14, rows_per_tree: int = 500_000,
) -> DataFrame:
    """(window_id, n): distinct items of the key with event time in [end - length, end) that arrived before end + lateness."""
    length, late = int(length_days * DAY_US), int(lateness_days * DAY_US)
    ev = deliveries.select(F.col(key).alias("k"), F.struct(*item).alias("item"), F.unix_micros(event_time).alias("t"), F.unix_micros(arrival).alias("a"))
    ev = ev.where("k is not null and t is not null and a is not null and t <= a")
    ev = ev.groupBy("k", "item", "t").agg(F.min("a").alias("a"))
    qs = windows.select(F.col(key).alias("k"), F.col(window_id).alias("wid"), F.unix_micros(window_end).alias("e"))
    asked = qs.where("k is not null and e is not null")

    by_item = W.partitionBy("k", "item").orderBy("t", "a")
    ev = ev.withColumn("more", F.count("*").over(W.partitionBy("k", "item")) > 1)
    one = ev.where("not more").select("k", F.xxhash64("item").alias("h"), F.col("a").alias("at"), F.lit(2).alias("kind"), F.col("t").alias("v"), F.lit(1).alias("n"), F.lit(None).cast(asked.schema["wid"].dataType).alias("wid"))
    # items delivered with several event times: the window ends at which they count, as a union of intervals
    spans = ev.where("more").select("k", "item", F.greatest("t", F.col("a") - late).alias("b"), (F.col("t") + length).alias("f")).where("b < f")
    order = W.partitionBy("k", "item").orderBy("b", "f")
    reached = F.max("f").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reached.isNull() | (F.col("b") > reached), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    spans = spans.groupBy("k", "item", "island").agg(F.min("b").alias("b"), F.max("f").alias("f"))
    steps = spans.select("k", F.xxhash64("item").alias("h"), F.explode(F.array(F.struct((F.col("b") + 1).alias("v"), F.lit(1).alias("n")), F.struct((F.col("f") + 1).alias("v"), F.lit(-1).alias("n")))).alias("s"))
    steps = steps.select("k", "h", F.lit(-(1 << 62)).cast("long").alias("at"), F.lit(0).alias("kind"), "s.v", "s.n", F.lit(None).cast(asked.schema["wid"].dataType).alias("wid"))
    del by_item

    puts = one.unionByName(steps)
    trees = puts.groupBy("k").count().where(F.col("count") > rows_per_tree).select("k", F.ceil(F.col("count") / rows_per_tree).cast("int").alias("trees"))
    puts = puts.join(trees, "k", "left").withColumn("tree", F.pmod("h", F.coalesce("trees", F.lit(1))).cast("int"))
    gets = asked.join(trees, "k", "left").withColumn("tree", F.explode(F.sequence(F.lit(0), F.coalesce("trees", F.lit(1)) - 1)))
    gets = gets.select("k", "tree", (F.col("e") + late).alias("at"), F.lit(1).alias("kind"), F.col("e").alias("v"), F.lit(0).alias("n"), "wid")
    rows = puts.select("k", "tree", "at", "kind", "v", "n", "wid").unionByName(gets)
    rows = rows.repartition("k", "tree").sortWithinPartitions("k", "tree", "at", "kind")
    wid_type = asked.schema["wid"].dataType.simpleString()

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, events, ends = None, FingerBTree(), FingerBTree()
        for got in batches:
            ids, counts = [], []
            wids = got["wid"].to_numpy(dtype=object)
            cols = (got[c].to_numpy().tolist() for c in ("k", "tree", "kind", "v", "n"))
            for r, (k, tree, kind, v, n) in enumerate(zip(*cols)):
                if at != (k, tree):
                    at, events, ends = (k, tree), FingerBTree(), FingerBTree()
                if kind == 1:
                    ids.append(wids[r])
                    counts.append(events.count(v - length, v) + ends.before(v + 1))
                    events.evict(v - length)
                elif kind == 2:
                    events.insert(v)
                else:
                    ends.insert(v, n)
            if ids:
                yield pd.DataFrame({"wid": ids, "n": np.asarray(counts, dtype="int64")})

    counts = rows.mapInPandas(replay, f"wid {wid_type}, n long")
    counts = counts.unionByName(qs.select("wid", F.lit(0).cast("long").alias("n")))
    return counts.groupBy(F.col("wid").alias(window_id)).agg(F.sum("n").alias("n"))
