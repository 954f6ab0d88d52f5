import random
from datetime import datetime, timedelta

from tastegrid.operators.late_events import FingerBTree, window_counts

D0 = datetime(2026, 1, 1)
EV = "k string, s string, x string, t timestamp, a timestamp, wid string, n int"


def test_tree_equals_lists():
    r = random.Random(5)
    for _ in range(60):
        tree, plain, base = FingerBTree(), [], 0
        for _ in range(500):
            base += r.randint(0, 4)
            x = base - r.choice([0, 0, 1, 7, 60, 400])
            tree.insert(x)
            plain.append(x)
            if r.random() < 0.1:
                lo = base - r.randint(0, 500)
                hi = lo + r.randint(-5, 400)
                assert tree.count(lo, hi) == sum(lo <= y < hi for y in plain)
            if r.random() < 0.03:
                lo = base - r.randint(0, 600)
                tree.evict(lo)
                plain = [y for y in plain if y >= lo]
                assert tree.root.total == len(plain)
    assert FingerBTree().count(0, 10) == 0


def brute(events, windows):
    out = {}
    for wid, k, e in windows:
        out[wid] = len({(s, x) for kk, s, x, t, a, *_ in events if k is not None and e is not None and kk == k and t is not None and a is not None and t <= a and e - timedelta(days=60) <= t < e and a < e + timedelta(days=14)})
    return out


def test_counts_equal_brute_force(spark):
    r = random.Random(11)
    day = lambda x: D0 + timedelta(days=x)
    events = []
    for _ in range(900):
        t = r.choice([r.randint(0, 200), r.uniform(0, 200)])
        events.append((r.choice(["a", "a", "a", "b", "c"]), r.choice("xy"), str(r.randint(0, 150)), day(t), day(t + r.choice([0, 1, 13, 14, 15, 90, -1])), "clash", 1))
    events += [("a", "x", "1", None, day(3), None, None), ("a", "x", "2", day(3), None, None, None), (None, "x", "3", day(3), day(3), None, None), ("a", None, None, day(30), day(30), None, None)]
    windows = [(f"w{i}", r.choice(["a", "b", "c", "zz"]), day(r.choice([60, 90, 100.5, 200, 260]))) for i in range(60)] + [("v1", None, day(60)), ("v2", "a", None)]
    ev, ws = spark.createDataFrame(events, EV), spark.createDataFrame(windows, "wid string, k string, e timestamp")
    for per_tree in (500_000, 40):  # one tree a key, and several
        got = window_counts(ev, ws, "k", ["s", "x"], "t", "a", "wid", "e", rows_per_tree=per_tree)
        assert {r["wid"]: r["n"] for r in got.collect()} == brute(events, windows)


def test_empty(spark):
    ws = spark.createDataFrame([("w", "a", D0)], "wid string, k string, e timestamp")
    none = spark.createDataFrame([], EV)
    assert [r["n"] for r in window_counts(none, ws, "k", ["s", "x"], "t", "a", "wid", "e").collect()] == [0]
    assert window_counts(none, ws.limit(0), "k", ["s", "x"], "t", "a", "wid", "e").count() == 0
