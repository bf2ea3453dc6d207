"""Geodesy as column expressions, and geometry of WKT shapes in vectorised functions.

Points are struct(lat, lon) in degrees; WKT is lon lat. Distances are metres on the WGS 84 ellipsoid.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

#: WGS 84.
A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
#: Radius of the sphere of the same area.
AUTHALIC = 6371007.1809


def point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the mean sphere; within half a percent of the ellipsoid. Good for filters before the exact distance."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geodesic(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Vincenty's inverse formula over arrays; where it does not converge (near antipodes), the mean sphere."""
    p1, p2 = np.radians(np.asarray(lat1, float)), np.radians(np.asarray(lat2, float))
    dl = np.radians(np.asarray(lon2, float) - np.asarray(lon1, float))
    dl = (dl + np.pi) % (2 * np.pi) - np.pi
    u1, u2 = np.arctan((1 - FLAT) * np.tan(p1)), np.arctan((1 - FLAT) * np.tan(p2))
    lam, ok = dl.copy(), np.zeros(dl.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(100):
            x = np.cos(u2) * np.sin(lam)
            y = np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)
            ss, cs = np.hypot(x, y), np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / ss)
            c2 = 1 - sa**2
            cm = np.where(c2 < 1e-15, 0, cs - 2 * np.sin(u1) * np.sin(u2) / c2)
            c = FLAT / 16 * c2 * (4 + FLAT * (4 - 3 * c2))
            new = dl + (1 - c) * FLAT * sa * (sigma + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
            ok = np.abs(new - lam) < 1e-12
            lam = np.where(ok, lam, new)
            if ok.all():
                break
        k = c2 * (A**2 - B**2) / B**2
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        ds = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        out = B * big * (sigma - ds)
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
    out = np.where(ok, out, 2 * 6371008.8 * np.arcsin(np.sqrt(np.minimum(h, 1))))
    return np.where(np.isnan(p1 + p2 + dl), np.nan, out)


@pandas_udf(DoubleType())
def distance(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    d = geodesic(lat1, lon1, lat2, lon2)
    return pd.Series(d).where(~np.isnan(d), None)


# ---------------------------------------------------------------- shapes

_NUMBER = re.compile(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?")


def parse(wkt: str | None) -> tuple[str, list[list[np.ndarray]]] | None:
    """(kind, parts): each part a list of rings or lines of (lon, lat); None for what cannot be read."""
    m = re.match(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*Z?\s*(\(.*\))\s*$", wkt or "", re.S)
    if not m:
        return None
    kind, body = m[1].upper(), m[2]

    def ring(text: str) -> np.ndarray:
        xy = [tuple(float(v) for v in _NUMBER.findall(p)[:2]) for p in text.split(",")]
        return np.array([p for p in xy if len(p) == 2], float).reshape(-1, 2)

    lists = re.findall(r"\(([^()]*)\)", body)
    if kind in ("POINT", "LINESTRING"):
        return kind, [[ring(lists[0])]] if lists else []
    if kind == "MULTIPOINT":
        return kind, [[p.reshape(1, 2)] for x in lists for p in ring(x)]
    if kind == "MULTILINESTRING":
        return kind, [[ring(x)] for x in lists]
    if kind == "POLYGON":
        return kind, [[ring(x) for x in lists]]
    if kind == "MULTIPOLYGON":
        return kind, [[ring(x) for x in re.findall(r"\(([^()]*)\)", p)] for p in re.findall(r"\(\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*\)", body)]
    return None


def to_wkt(parts: list[list[np.ndarray]]) -> str:
    """Polygons as MULTIPOLYGON, one as POLYGON."""

    def poly(rings):
        return "(" + ", ".join("(" + ", ".join(f"{x:.10g} {y:.10g}" for x, y in r) + ")" for r in rings) + ")"

    return f"POLYGON {poly(parts[0])}" if len(parts) == 1 else "MULTIPOLYGON (" + ", ".join(map(poly, parts)) + ")"


def _in_ring(r: np.ndarray, x: float, y: float) -> bool:
    """Strictly inside; the boundary is outside."""
    x1, y1, x2, y2 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    on = (np.abs(cross) < 1e-12) & (np.minimum(x1, x2) - 1e-12 <= x) & (x <= np.maximum(x1, x2) + 1e-12) & (np.minimum(y1, y2) - 1e-12 <= y) & (y <= np.maximum(y1, y2) + 1e-12)
    if on.any():
        return False
    up = (y1 > y) != (y2 > y)
    with np.errstate(all="ignore"):
        at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return bool((up & (x < at)).sum() % 2)


def _on_edge(r: np.ndarray, x: float, y: float) -> bool:
    x1, y1, x2, y2 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return bool(((np.abs(cross) < 1e-12) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))).any())


def inside(shape, x: float, y: float) -> bool:
    if shape is None or "POLYGON" not in shape[0]:
        return False
    return any(_in_ring(p[0], x, y) and not any(_in_ring(h, x, y) or _on_edge(h, x, y) for h in p[1:]) for p in shape[1])


def _segments(shape) -> np.ndarray:
    out = [np.hstack([r[:-1], r[1:]]) for p in shape[1] for r in p if len(r) > 1]
    return np.concatenate(out) if out else np.empty((0, 4))


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which segments of a meet which of b."""

    def side(p, q, r):
        return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    a, b = a[:, None, :], b[None, :, :]
    p, q = (a[..., 0], a[..., 1]), (a[..., 2], a[..., 3])
    r, s = (b[..., 0], b[..., 1]), (b[..., 2], b[..., 3])
    box = (np.minimum(p[0], q[0]) <= np.maximum(r[0], s[0])) & (np.minimum(r[0], s[0]) <= np.maximum(p[0], q[0])) & (np.minimum(p[1], q[1]) <= np.maximum(r[1], s[1])) & (np.minimum(r[1], s[1]) <= np.maximum(p[1], q[1]))
    return box & (side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)


def intersects_shapes(a, b) -> bool:
    if a is None or b is None:
        return False
    if _cross(_segments(a), _segments(b)).any():
        return True
    for s, t in ((a, b), (b, a)):
        for part in t[1]:
            x, y = part[0][0]
            if inside(s, x, y) or any(_on_edge(r, x, y) for p in s[1] for r in p if len(r) > 1):
                return True
            if s[0] == "POINT" and t[0] == "POINT" and np.allclose(s[1][0][0][0], (x, y)):
                return True
    return False


def contains_shapes(a, b) -> bool:
    """All of b lies inside a, no part of it on a's boundary only."""
    if a is None or b is None or "POLYGON" not in a[0]:
        return False
    points = np.concatenate([r for p in b[1] for r in p])
    if b[0] in ("POINT", "MULTIPOINT"):
        return all(inside(a, x, y) for x, y in points)
    ok = all(inside(a, x, y) or any(_on_edge(r, x, y) for p in a[1] for r in p) for x, y in points)
    seg = _segments(b)
    mid = (seg[:, :2] + seg[:, 2:]) / 2
    return ok and all(inside(a, x, y) or any(_on_edge(r, x, y) for p in a[1] for r in p) for x, y in mid)


def _ring_area(r: np.ndarray) -> float:
    """Signed square metres of a ring, on the sphere of the ellipsoid's area at authalic latitudes."""
    e2 = FLAT * (2 - FLAT)
    e = math.sqrt(e2)
    s = np.sin(np.radians(r[:, 1]))

    def q(v):
        return (1 - e2) * (v / (1 - e2 * v * v) + np.arctanh(e * v) / e)

    beta = np.clip(q(s) / q(1.0), -1, 1)
    lon = np.radians(r[:, 0])
    return float(AUTHALIC**2 * np.sum((lon[1:] - lon[:-1]) * (beta[1:] + beta[:-1])) / 2)


def area_of(shape) -> float | None:
    if shape is None or "POLYGON" not in shape[0]:
        return None
    return sum(abs(_ring_area(p[0])) - sum(abs(_ring_area(h)) for h in p[1:]) for p in shape[1])


def length_of(shape, exterior: bool = False) -> float | None:
    if shape is None:
        return None
    rings = [r for p in shape[1] for r in (p[:1] if exterior else p) if len(r) > 1]
    return float(sum(geodesic(r[:-1, 1], r[:-1, 0], r[1:, 1], r[1:, 0]).sum() for r in rings))


def centroid_of(shape) -> tuple[float, float] | None:
    """(lat, lon), planar: by area for polygons, by length for lines, the mean for points."""
    if shape is None or not shape[1]:
        return None
    if "POLYGON" in shape[0]:
        total = cx = cy = 0.0
        for p in shape[1]:
            for i, r in enumerate(p):
                o = r[0]
                x, y = (r - o).T
                w = x[:-1] * y[1:] - x[1:] * y[:-1]
                sign = (1 if i == 0 else -1) * (1 if w.sum() >= 0 else -1)
                total += sign * w.sum() / 2
                cx += sign * (((x[:-1] + x[1:]) * w).sum() / 6 + o[0] * w.sum() / 2)
                cy += sign * (((y[:-1] + y[1:]) * w).sum() / 6 + o[1] * w.sum() / 2)
        if total:
            return cy / total, cx / total
    seg = _segments(shape)
    if "LINE" in shape[0] and len(seg):
        w = np.hypot(seg[:, 2] - seg[:, 0], seg[:, 3] - seg[:, 1])
        if w.sum():
            return float(((seg[:, 1] + seg[:, 3]) / 2 * w).sum() / w.sum()), float(((seg[:, 0] + seg[:, 2]) / 2 * w).sum() / w.sum())
    points = np.concatenate([r for p in shape[1] for r in p])
    return float(points[:, 1].mean()), float(points[:, 0].mean())


def hull_of(points: np.ndarray) -> np.ndarray:
    """Convex hull as a closed ring, by monotone chains."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return np.vstack([p, p[:1]])

    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = half(list(p)) + half(list(p[::-1]))
    return np.array([*ring, ring[0]])


def valid_shape(shape) -> bool:
    """Rings are closed, have three corners and do not cross themselves."""
    if shape is None:
        return False
    for p in shape[1]:
        for r in p:
            if not np.isfinite(r).all():
                return False
            if "POLYGON" in shape[0]:
                if len(r) < 4 or not np.allclose(r[0], r[-1]):
                    return False
                s = np.hstack([r[:-1], r[1:]])
                hit = _cross(s, s)
                n = len(s)
                i, j = np.nonzero(hit)
                if ((np.abs(i - j) > 1) & (np.abs(i - j) < n - 1)).any():
                    return False
    return True


def buffer_of(shape, metres: float, corners: int = 32) -> str | None:
    """Convex cover: the hull of circles about the shape's corners, metres scaled to degrees at its centroid."""
    c = centroid_of(shape)
    if c is None:
        return None
    m_lat = math.pi * A / 180
    scale = np.array([m_lat * max(math.cos(math.radians(c[0])), 1e-9), m_lat])
    t = np.linspace(0, 2 * np.pi, corners, endpoint=False)
    circle = np.stack([np.cos(t), np.sin(t)], axis=1) * metres / scale
    points = np.concatenate([r for p in shape[1] for r in p])
    return to_wkt([[hull_of((points[:, None, :] + circle[None]).reshape(-1, 2))]])


def clip(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection of ring a with the convex ring b, edge by edge; empty if there is none."""
    if _planar(b) < 0:
        b = b[::-1]
    out = list(a[:-1])
    for p, q in zip(b[:-1], b[1:], strict=True):
        if not out:
            break
        left = [(q[0] - p[0]) * (v[1] - p[1]) - (q[1] - p[1]) * (v[0] - p[0]) for v in out]
        new = []
        for i, v in enumerate(out):
            u, lu, lv = out[i - 1], left[i - 1], left[i]
            if (lu >= 0) != (lv >= 0):
                new.append(u + (v - u) * (lu / (lu - lv)))
            if lv >= 0:
                new.append(v)
        out = new
    return np.array([*out, out[0]]) if len(out) > 2 else np.empty((0, 2))


def _planar(r: np.ndarray) -> float:
    return float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2)


def _shape_udf(f: Callable, kind):
    @pandas_udf(kind)
    def one(w: pd.Series) -> pd.Series:
        return w.map(lambda x: f(parse(x)))

    return one


def _pair_udf(f: Callable, kind):
    @pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(parse(x), parse(y)) for x, y in zip(a, b, strict=True)])

    return two


area = _shape_udf(area_of, DoubleType())
perimeter = _shape_udf(lambda s: length_of(s, True) if s and "POLYGON" in s[0] else None, DoubleType())
length = _shape_udf(length_of, DoubleType())
is_valid = _shape_udf(valid_shape, BooleanType())
convex_hull = _shape_udf(lambda s: None if s is None else to_wkt([[hull_of(np.concatenate([r for p in s[1] for r in p]))]]), StringType())
contains = _pair_udf(contains_shapes, BooleanType())
intersects = _pair_udf(intersects_shapes, BooleanType())


def _clipped(a, b) -> str | None:
    """Intersection where the second shape's parts are convex."""
    if a is None or b is None or "POLYGON" not in a[0] or "POLYGON" not in b[0]:
        return None
    parts = [[r] for p in a[1] for q in b[1] if len(r := clip(p[0], q[0]))]
    return to_wkt(parts) if parts else "MULTIPOLYGON EMPTY"


intersection = _pair_udf(_clipped, StringType())


@pandas_udf(StructType([StructField("lat", DoubleType()), StructField("lon", DoubleType())]))
def centroid(w: pd.Series) -> pd.DataFrame:
    found = [centroid_of(parse(x)) or (None, None) for x in w]
    return pd.DataFrame(found, columns=["lat", "lon"])


def buffer(w: Column, metres: float) -> Column:
    return _shape_udf(lambda s: buffer_of(s, metres), StringType())(w)


@pandas_udf(BooleanType())
def contains_point(w: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.Series:
    cache: dict = {}
    out = []
    for x, y, z in zip(w, lat, lon, strict=True):
        if x not in cache:
            cache[x] = parse(x)
        out.append(inside(cache[x], z, y))
    return pd.Series(out)


@pandas_udf(StructType([StructField(c, DoubleType()) for c in ("lat_min", "lat_max", "lon_min", "lon_max")]))
def box(w: pd.Series) -> pd.DataFrame:
    rows = []
    for x in w:
        s = parse(x)
        p = np.concatenate([r for q in s[1] for r in q]) if s and s[1] else np.full((1, 2), np.nan)
        rows.append((p[:, 1].min(), p[:, 1].max(), p[:, 0].min(), p[:, 0].max()))
    return pd.DataFrame(rows, columns=["lat_min", "lat_max", "lon_min", "lon_max"])


# ---------------------------------------------------------------- joins


def containment_join(shapes: DataFrame, points: DataFrame, wkt: str, lat: str, lon: str, cell: float = 1.0) -> DataFrame:
    """Pairs of a shape and a point in it: an equi-join on grid cells, then boxes, then the exact test."""
    s = shapes.withColumn("_b", box(F.col(wkt)))
    s = s.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_b.lat_min") / cell), F.floor(F.col("_b.lat_max") / cell)))).withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_b.lon_min") / cell), F.floor(F.col("_b.lon_max") / cell))))
    p = points.withColumn("_py", F.floor(F.col(lat) / cell)).withColumn("_px", F.floor(F.col(lon) / cell))
    both = s.join(p, (F.col("_cy") == F.col("_py")) & (F.col("_cx") == F.col("_px")))
    both = both.where(F.col(lat).between(F.col("_b.lat_min"), F.col("_b.lat_max")) & F.col(lon).between(F.col("_b.lon_min"), F.col("_b.lon_max")))
    return both.where(contains_point(F.col(wkt), F.col(lat), F.col(lon))).drop("_b", "_cy", "_cx", "_py", "_px")


def distance_join(a: DataFrame, b: DataFrame, metres: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs within metres of each other, with their distance; columns of a and b keep their names with a_ and b_.

    Cells are as high as the radius; near the poles, where a cell's width would be smaller, longitude does not select.
    """
    cell = max(metres / 110_000.0, 1e-9)
    a = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])

    def band(la: Column) -> Column:
        return F.floor(la / cell)

    def column(la: Column, lo: Column) -> Column:
        width = cell / F.cos(F.radians(F.least(F.abs(la) + cell, F.lit(89.0))))
        return F.when(F.abs(la) + cell < 89, F.floor((lo + 180) / width)).otherwise(0)

    # b is put in the columns that each of the three bands around it would use
    b = b.withColumn("_band", F.explode(F.array(*[band(F.col(f"b_{lat}")) + i for i in (-1, 0, 1)])))
    middle = (F.col("_band") + 0.5) * cell
    count = F.floor(F.lit(360.0) / (cell / F.cos(F.radians(F.least(F.abs(middle) + cell, F.lit(89.0))))))
    own = column(middle, F.col(f"b_{lon}"))
    b = b.withColumn("_col", F.explode(F.array_distinct(F.array(own - 1, own, own + 1, F.when(own <= 0, count).otherwise(own), F.when(own >= count - 1, F.lit(0)).otherwise(own)))))
    a = a.withColumn("_aband", band(F.col(f"a_{lat}")))
    a = a.withColumn("_acol", column((F.col("_aband") + 0.5) * cell, F.col(f"a_{lon}")))
    both = a.join(b, (F.col("_aband") == F.col("_band")) & (F.col("_acol") == F.col("_col"))).drop("_band", "_col", "_aband", "_acol")
    args = [F.col(f"a_{lat}"), F.col(f"a_{lon}"), F.col(f"b_{lat}"), F.col(f"b_{lon}")]
    return both.where(haversine(*args) <= metres * 1.01).withColumn("metres", distance(*args)).where(F.col("metres") <= metres)


def nearest(points: DataFrame, lat: float, lon: float, k: int, lat_column: str = "lat", lon_column: str = "lon") -> DataFrame:
    """The k points nearest to a place, with metres: those within one per cent of the k-th by the built-in distance on the
    sphere, which is off by less, are ranked by the exact one."""
    here = [F.col(lat_column), F.col(lon_column), F.lit(float(lat)), F.lit(float(lon))]
    near = points.withColumn("_sphere", haversine(*here)).where("_sphere is not null")
    last = near.select("_sphere").orderBy("_sphere").limit(k).agg(F.max("_sphere")).first()[0]
    near = near.where(F.col("_sphere") <= (last or 0.0) * 1.02 + 1.0).drop("_sphere")
    return near.withColumn("metres", distance(*here)).orderBy("metres", "id").limit(k)


def within_bounds(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)
