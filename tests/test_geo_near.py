import random

import numpy as np
import pytest

from tastegrid.operators.geo_near import haversine_np, near_pairs, points_in_regions

SCHEMA = "id string, lat double, lng double, strip int, x string"


def brute(rows, metres):
    ok = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and r[2] is not None and r[1] == r[1] and r[2] == r[2] and abs(r[1]) <= 90 and abs(r[2]) <= 180 and (r[1], r[2]) != (0, 0):
            ok.setdefault((r[0], r[1], r[2]))
    ids = sorted(ok)
    out = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if a[0] != b[0] and haversine_np(a[1], a[2], b[1], b[2]) <= metres:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def cloud(seed):
    r = random.Random(seed)
    rows = []
    for i in range(220):
        lat0, lng0 = r.choice([(22.5, 88.3), (-17.8, 179.9995), (-17.8, -179.9995), (89.9999, 10.0), (-89.9999, -100.0), (51.5, 0.0)])
        rows.append((f"p{i:04d}", lat0 + r.uniform(-1, 1) * 0.0008 if abs(lat0) < 89 else lat0, max(-180.0, min(180.0, lng0 + r.uniform(-1, 1) * (0.0008 if abs(lat0) < 89 else 180))), i, "x"))
    rows += [(f"q{i}", 22.5, 88.3, 0, None) for i in range(6)]  # one position many times
    rows += [("n1", None, 1.0, 0, None), ("n2", 1.0, None, 0, None), ("n3", float("nan"), 1.0, 0, None), ("n4", 0.0, 0.0, 0, None), ("n5", 91.0, 0.1, 0, None), ("n6", 1.0, 181.0, 0, None), (None, 22.5, 88.3, 0, None)]
    rows += [rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("per_strip", [7, 50, 100000])
def test_pairs_equal_brute_force(spark, per_strip):
    rows = cloud(per_strip)
    got = near_pairs(spark.createDataFrame(rows, SCHEMA), "id", 40.0, rows_per_strip=per_strip).collect()
    found = [(r["id_a"], r["id_b"]) for r in got]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, 40.0)


@pytest.mark.parametrize("per_strip", [9, 100000])
def test_regions_equal_brute_force(spark, per_strip):
    rows = cloud(3)
    regions = [("a", 22.5, 88.3, 60), ("b", -17.8, 179.9999, 90), ("c", 89.9999, 0.0, 500), ("d", 22.5003, 88.3003, 25000), ("e", None, 1.0, 5), ("f", 22.5, 88.3, None), ("g", -17.8, -179.9999, 0)]
    got = points_in_regions(spark.createDataFrame(rows, SCHEMA), "id", spark.createDataFrame(regions, "id string, lat double, lng double, radius_m int"), "id", rows_per_strip=per_strip)
    found = [(r["region_id"], r["id"]) for r in got.collect()]
    want = {(g[0], r[0]) for g in regions if g[1] is not None and g[3] is not None for r in rows if r[0] and r[1] is not None and r[2] is not None and not np.isnan(r[1]) and abs(r[1]) <= 90 and abs(r[2]) <= 180 and (r[1], r[2]) != (0, 0) and haversine_np(g[1], g[2], r[1], r[2]) <= g[3]}
    assert len(found) == len(set(found)) and set(found) == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_pairs(none, "id", 40.0).count() == 0
    assert points_in_regions(none, "id", spark.createDataFrame([], "id string, lat double, lng double, radius_m int"), "id").count() == 0
