"""Points near points and points inside circular regions, by a latitude-strip sweep.

Latitude is cut into strips of about equal numbers of distinct positions. A position goes to its own strip
and to the strips below it that reach within the distance, so every close pair meets in the strip of its
southern member, which owns it. Each strip is sorted by longitude on disk and swept in a stream: only
positions still within reach in longitude stay active. Repeated rows at one position take part once and are
expanded afterwards, so a position that holds a third of the rows costs one sweep entry.

Rows with a null, NaN or out-of-range coordinate, or with both coordinates 0, take no part. Empty input gives
an empty result. Columns other than id, lat and lng are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: quantiles of latitude the driver holds; beyond them strips are cut further, evenly
QUANTILES = 4096


def usable(df: DataFrame, id_col: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(id, lat, lng) of the rows whose coordinates can be used; -0.0 becomes 0.0."""
    d = df.select(F.col(id_col).alias("id"), (F.col(lat).cast("double") + 0.0).alias("lat"), (F.col(lng).cast("double") + 0.0).alias("lng"))
    return d.where(
        F.col("id").isNotNull() & F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lng") == 0))
    )


def haversine_np(lat1, lng1, lat2, lng2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _reach_deg(metres: float) -> float:
    return math.degrees(metres / EARTH_M) * (1 + 1e-9) + 1e-9


def _half_width(lat: np.ndarray, metres: np.ndarray | float) -> np.ndarray:
    """Largest difference of longitude within the distance; 360 where the circle holds a pole."""
    d = np.asarray(metres, dtype=float) / EARTH_M
    edge = np.radians(np.abs(lat)) + d
    with np.errstate(invalid="ignore", divide="ignore"):
        w = np.degrees(np.arcsin(np.clip(np.sin(np.minimum(d, math.pi / 2)) / np.cos(np.radians(lat)), -1, 1)))
    return np.where(edge >= math.pi / 2 - 1e-9, 360.0, w * (1 + 1e-9) + 1e-9)


@dataclass(frozen=True)
class Strips:
    """Borders of latitude (quantiles) and the number of even cuts between two of them; strips are numbered from the south."""

    bounds: tuple[float, ...] = ()
    cuts: int = 1

    def __len__(self) -> int:
        return (len(self.bounds) + 1) * self.cuts

    def of(self, lat: np.ndarray) -> np.ndarray:
        edges = np.array([-90.0, *self.bounds, 90.0])
        at = np.clip(np.searchsorted(edges, lat, side="right") - 1, 0, len(edges) - 2)
        if self.cuts == 1:
            return at.astype("int32")
        share = (lat - edges[at]) / np.maximum(edges[at + 1] - edges[at], 1e-300)
        return (at * self.cuts + np.clip(np.floor(share * self.cuts), 0, self.cuts - 1)).astype("int32")

    def column(self, lat):
        """Strip of a latitude: a nested CASE while borders are few."""
        if len(self) == 1:
            return F.lit(0)
        if self.cuts == 1 and len(self.bounds) <= 64:

            def search(lo: int, hi: int):
                if lo == hi:
                    return F.lit(lo)
                mid = (lo + hi) // 2
                return F.when(lat < self.bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

            return search(0, len(self.bounds))

        @F.pandas_udf("int")
        def find(s: pd.Series) -> pd.Series:
            return pd.Series(self.of(s.to_numpy()))

        return find(lat)


def strips_of(coords: DataFrame, rows_per_strip: int, quantiles: int = QUANTILES) -> Strips:
    """Strips of about rows_per_strip positions each, however many there are."""
    wanted = -(-coords.count() // rows_per_strip)
    k = min(quantiles, wanted)
    if k < 2:
        return Strips()
    bounds = tuple(sorted(set(coords.approxQuantile("lat", [i / k for i in range(1, k)], 0.2 / k))))
    return Strips(bounds, max(1, -(-wanted // k)))


def near_positions(coords: DataFrame, radius_m: float, rows_per_strip: int = 4000, give: tuple[str, ...] = ("lat", "lng"), keep_pair: Callable | None = None) -> DataFrame:
    """Pairs of rows at most radius_m apart, each once: the columns `give` of both (lat_a, lng_a, lat_b, lng_b) and distance_m.

    keep_pair(first, second, metres), of two frames' columns as arrays by name, says which of the pairs in reach to give; so
    pairs that further columns of the rows rule out are never written."""
    extra = [c for c in coords.columns if c not in ("lat", "lng")]
    strips = strips_of(coords, rows_per_strip)
    reach = _reach_deg(radius_m)
    lo, hi = strips.column(F.greatest(F.col("lat") - F.lit(reach), F.lit(-90.0))), strips.column(F.col("lat"))
    rows = coords.withColumn("own", hi).withColumn("strip", F.explode(F.sequence(lo, F.col("own"))))
    # the widest reach in longitude of the strip bounds what has to stay active
    width = F.when(
        F.radians(F.abs("lat")) + F.lit(2 * radius_m / EARTH_M) >= math.pi / 2 - 1e-9, F.lit(360.0)
    ).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(radius_m / EARTH_M)) / F.cos(F.radians(F.abs("lat")) + F.lit(radius_m / EARTH_M))))) * (1 + 1e-9) + 1e-9)
    rows = rows.withColumn("w", F.least(width, F.lit(180.0)))
    # positions near the eastern edge come again beyond the western one; such a copy is only looked back at
    rows = rows.withColumn("x", F.explode(F.when(F.col("lng") + F.col("w") >= 180, F.array(F.col("lng"), F.col("lng") - 360)).otherwise(F.array("lng"))))
    rows = rows.select("strip", "x", "lat", "lng", "w", (F.col("own") == F.col("strip")).alias("native"), (F.col("x") == F.col("lng")).alias("real"), *extra)
    parts = max(1, min(len(strips), 16 * coords.sparkSession.sparkContext.defaultParallelism))
    rows = rows.repartition(parts, "strip").sortWithinPartitions("strip", "x", "real")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep: pd.DataFrame | None = None
        for got in batches:
            for strip, part in got.groupby("strip", sort=False):
                if keep is not None and len(keep) and keep["strip"].iloc[0] != strip:
                    keep = None
                both = part if keep is None else pd.concat([keep, part], ignore_index=True)
                first = len(both) - len(part)
                x, lat, lng, w, native, real = (both[c].to_numpy() for c in ("x", "lat", "lng", "w", "native", "real"))
                own = {c: both[c].to_numpy() for c in ("lat", "lng", *extra)}
                start = np.searchsorted(x, x[first:] - w[first:], side="left")
                count = np.where(real[first:], np.arange(first, len(both)) - start, 0)
                for at in _blocks(count, 2_000_000):
                    n = count[at]
                    j = np.repeat(np.arange(first, len(both))[at], n)
                    i = np.repeat(start[at], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    near = (np.abs(lat[i] - lat[j]) <= reach) & (real[i] | (x[j] - x[i] < 180))
                    i, j = i[near], j[near]
                    d = haversine_np(lat[i], lng[i], lat[j], lng[j])
                    i_owns = (lat[i] < lat[j]) | ((lat[i] == lat[j]) & (lng[i] <= lng[j]))
                    ok = (d <= radius_m) & np.where(i_owns, native[i], native[j])
                    i, j, d = i[ok], j[ok], d[ok]
                    if keep_pair is not None and len(i):
                        ok = keep_pair({c: v[i] for c, v in own.items()}, {c: v[j] for c, v in own.items()}, d)
                        i, j, d = i[ok], j[ok], d[ok]
                    if len(i):
                        yield pd.DataFrame({f"{c}_{s}": own[c][k] for s, k in (("a", i), ("b", j)) for c in give} | {"distance_m": d})
                widest = both["w"].max()
                keep = both[x >= x[-1] - widest]

    kinds = dict(coords.dtypes)
    return rows.mapInPandas(sweep, ", ".join(f"{c}_{s} {kinds[c]}" for s in "ab" for c in give) + ", distance_m double")


def _blocks(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows with about `most` candidate pairs each."""
    total, begin = 0, 0
    for k, c in enumerate(count):
        if total and total + c > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += c
    if begin < len(count):
        yield slice(begin, len(count))


def near_pairs(points: DataFrame, id_col: str, radius_m: float, lat: str = "lat", lng: str = "lng", rows_per_strip: int = 4000) -> DataFrame:
    """Pairs (id_a < id_b, distance_m) of rows at most radius_m apart, each once; several rows of one id count as one."""
    pts = usable(points, id_col, lat, lng).dropDuplicates(["id", "lat", "lng"])
    groups = pts.groupBy("lat", "lng").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    pairs = near_positions(groups.select("lat", "lng"), radius_m, rows_per_strip)
    same = groups.where("first_id < last_id").select(
        F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"), F.lit(0.0).alias("distance_m")
    )
    a = pts.select(F.col("id").alias("x"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"))
    b = pts.select(F.col("id").alias("y"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"))
    out = pairs.join(a, ["lat_a", "lng_a"]).join(b, ["lat_b", "lng_b"]).where("x <> y")
    selves = same.join(a, ["lat_a", "lng_a"]).join(b, ["lat_b", "lng_b"]).where("x < y")
    both = out.select("x", "y", "distance_m").unionByName(selves.select("x", "y", "distance_m"))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "distance_m")


def points_in_regions(
    points: DataFrame, id_col: str, regions: DataFrame, region_id: str, radius_col: str = "radius_m", lat: str = "lat", lng: str = "lng", rows_per_strip: int = 4000
) -> DataFrame:
    """(region_id, id, distance_m) for every point at most the region's radius from its centre.

    A region enters every strip it touches at its western edge and stays active until its eastern edge;
    regions that cross the antimeridian enter twice. Regions without a usable centre or radius have no points.
    """
    pts = usable(points, id_col, lat, lng)
    coords = pts.select("lat", "lng").distinct()
    strips = strips_of(coords, rows_per_strip)
    regs = regions.select(F.col(region_id).alias("rid"), F.col("lat").cast("double"), F.col("lng").cast("double"), F.col(radius_col).cast("double").alias("r"))
    regs = regs.where(F.col("rid").isNotNull() & F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & (F.col("r") >= 0) & ~F.isnan("r"))
    tall = F.degrees(F.col("r") / EARTH_M) * (1 + 1e-9) + 1e-9
    pole = F.radians(F.abs("lat")) + F.col("r") / EARTH_M >= math.pi / 2 - 1e-9
    wide = F.when(pole, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.col("r") / EARTH_M) / F.cos(F.radians("lat"))))) * (1 + 1e-9) + 1e-9)
    regs = regs.withColumns({"w": wide, "strip": F.explode(F.sequence(strips.column(F.greatest(F.col("lat") - tall, F.lit(-90.0))), strips.column(F.least(F.col("lat") + tall, F.lit(90.0)))))})
    shift = F.when(F.col("w") >= 180, F.array(F.lit(0.0))).otherwise(
        F.array_compact(F.array(F.lit(0.0), F.when(F.col("lng") - F.col("w") < -180, F.lit(360.0)), F.when(F.col("lng") + F.col("w") > 180, F.lit(-360.0))))
    )
    regs = regs.withColumn("shift", F.explode(shift))
    events = regs.select("strip", (F.col("lng") + F.col("shift") - F.col("w")).alias("x"), F.lit(0).alias("kind"), "lat", "lng", (F.col("lng") + F.col("shift") + F.col("w")).alias("end"), "r", F.col("rid").cast("string"))
    events = events.unionByName(coords.select(strips.column(F.col("lat")).alias("strip"), F.col("lng").alias("x"), F.lit(1).alias("kind"), "lat", "lng", F.lit(None).cast("double").alias("end"), F.lit(None).cast("double").alias("r"), F.lit(None).cast("string").alias("rid")))
    parts = max(1, min(len(strips), 16 * pts.sparkSession.sparkContext.defaultParallelism))
    events = events.repartition(parts, "strip").sortWithinPartitions("strip", "x", "kind")

    fields = ["rid", "lat", "lng", "x", "end", "r"]

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, active = None, None
        for got in batches:
            for strip, part in got.groupby("strip", sort=False):
                new = part.loc[part["kind"] == 0, fields]
                active = new if strip != at else pd.concat([active, new], ignore_index=True)
                at = strip
                p = part[part["kind"] == 1]
                if not len(p):
                    continue
                # all active regions at once: the stretch of points each may hold, expanded in blocks
                x, plat = p["x"].to_numpy(), p["lat"].to_numpy()
                rid, rlat, rlng, begin, end, r = (active[c].to_numpy() for c in fields)
                start = np.searchsorted(x, begin.astype(float), "left")
                count = np.maximum(np.searchsorted(x, end.astype(float), "right") - start, 0)
                for some in _blocks(count, 2_000_000):
                    n = count[some]
                    i = np.repeat(np.arange(len(count))[some], n)
                    j = np.repeat(start[some], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    d = haversine_np(rlat[i], rlng[i], plat[j], x[j])
                    ok = d <= r[i]
                    if ok.any():
                        i, j = i[ok], j[ok]
                        yield pd.DataFrame({"region_id": rid[i], "lat": plat[j], "lng": x[j], "distance_m": d[ok]})
                active = active[end >= x[-1]]

    found = events.mapInPandas(sweep, "region_id string, lat double, lng double, distance_m double")
    return found.join(pts, ["lat", "lng"]).select("region_id", "id", "distance_m").distinct()
