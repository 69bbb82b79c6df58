"""Geometry on columns; tracks are arrays of (lat, lon) structs. Codecs work on whole Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_M = 6371008.8
POINTS = "array<struct<lat:double,lon:double>>"
#: The same as a type, which needs no session to be made.
_POINTS = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the radius's unit."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def project(lat: Column, lon: Column, ref_lat: Column | float, per_degree: float = math.pi * EARTH_M / 180) -> tuple[Column, Column]:
    """Local plane (x, y) in metres around a reference latitude."""
    ref = F.lit(ref_lat) if isinstance(ref_lat, float) else ref_lat
    return lon * per_degree * F.cos(F.radians(ref)), lat * per_degree


def cell_floor(v: Column, size: float) -> Column:
    return F.floor(v / size)


def cell_truncated(v: Column, size: float) -> Column:
    """Cells that meet in a double one around zero."""
    return (v / size).cast("long")


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point to a segment, which may be a point."""
    dx, dy = bx - ax, by - ay
    span = dx * dx + dy * dy
    t = F.when(span == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / span)))
    return F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2)


def densified(track: Column, spacing: float, ref_lat: float = 44.2) -> Column:
    """A track with a vertex at least every `spacing` metres, ends kept."""

    def between(a: Column, b: Column) -> Column:
        (x1, y1), (x2, y2) = project(a["lat"], a["lon"], ref_lat), project(b["lat"], b["lon"], ref_lat)
        steps = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2)) / spacing).cast("int"))
        at = lambda t: F.struct((a["lat"] + (b["lat"] - a["lat"]) * t).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * t).alias("lon"))
        return F.transform(F.sequence(F.lit(1), steps), lambda s: at(s / steps))

    parts = F.transform(F.slice(track, F.lit(2), F.greatest(F.size(track) - 1, F.lit(0))), lambda b, i: between(F.element_at(track, i + 1), b))
    return F.when(F.size(track) < 2, track).otherwise(F.concat(F.slice(track, 1, 1), F.flatten(parts)))


def signed_area(ring: Column) -> Column:
    """Shoelace area of points (x, y), closed by itself; positive is counter-clockwise."""
    return F.aggregate(F.transform(ring, lambda p, i: p["x"] * F.get(ring, F.pmod(i + 1, F.size(ring)))["y"] - F.get(ring, F.pmod(i + 1, F.size(ring)))["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v) / 2


def circularity(area: Column, length: Column) -> Column:
    return F.when(length > 0, F.abs(area) / (length * length / (4 * math.pi))).otherwise(0.0)


def _whole(v: np.ndarray) -> np.ndarray:
    if not np.isfinite(v).all():
        raise ValueError("a track has a point without a position")
    return np.rint(v * 1e5).astype(np.int64)


def _flat(tracks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of tracks (null: none), and latitudes and longitudes of all their points."""
    sizes = pc.fill_null(pc.list_value_length(tracks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = tracks.flatten()
    return sizes, *[points.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("lat", "lon")]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


@F.arrow_udf(T.StringType())
def polyline_encode(tracks: pa.Array) -> pa.Array:
    """Tracks as delta-coded text at five decimals; null stays null. All points of a batch are coded at once."""
    sizes, lat, lon = _flat(tracks)
    now = np.stack([_whole(lat), _whole(lon)], axis=1)
    starts = _starts(sizes)
    v = now.copy()
    v[1:] -= now[:-1]
    first = starts[:-1][sizes > 0]
    v[first] = now[first]
    v = v.reshape(-1)
    v = np.where(v < 0, -2 * v - 1, 2 * v)
    width, rest = np.ones(len(v), np.int64), v >> 5
    while rest.any():
        width += rest > 0
        rest >>= 5
    at = _starts(width)
    place = np.arange(at[-1]) - np.repeat(at[:-1], width)
    chars = ((np.repeat(v, width) >> (5 * place)) & 31) + 63 + 32 * (place < np.repeat(width, width) - 1)
    text = chars.astype(np.uint8)
    ends = at[2 * starts]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text), _valid(tracks)).cast(pa.string())


def _valid(given: pa.Array) -> pa.Buffer | None:
    return None if given.null_count == 0 else pa.array(given.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)).cast(pa.bool_()).buffers()[1]


@F.arrow_udf(_POINTS)
def polyline_decode(texts: pa.Array) -> pa.Array:
    """The inverse of polyline_encode."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = b"".join(texts.drop_null().cast(pa.binary()).to_pylist())
    b = np.frombuffer(joined, np.uint8).astype(np.int64) - 63
    owner = np.repeat(np.arange(len(sizes)), sizes)
    last = b < 32
    first = np.ones(len(b), bool)
    first[1:] = last[:-1] | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(first)
    place = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b))))
    v = np.add.reduceat((b & 31) << (5 * place), begin) if len(b) else np.zeros(0, np.int64)
    ended = last[np.append(begin[1:], len(b)) - 1] if len(b) else np.zeros(0, bool)  # a text that breaks off has no last value
    v, of = v[ended], owner[begin][ended]
    v = np.where(v & 1, -((v + 1) // 2), v // 2)
    count = np.bincount(of, minlength=len(sizes))
    nth = np.arange(len(v)) - np.repeat(_starts(count)[:-1], count)
    paired = nth < (count // 2 * 2)[of]
    pairs, points = v[paired].reshape(-1, 2), count // 2
    total = np.cumsum(pairs, axis=0)
    starts = _starts(points)
    before = np.concatenate([np.zeros((1, 2), np.int64), total])[starts[:-1]] if len(sizes) else np.zeros((0, 2), np.int64)
    total = (total - np.repeat(before, points, axis=0)) / 1e5
    return _listed(texts, points, total[:, 0], total[:, 1])


def _listed(like: pa.Array, sizes: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> pa.Array:
    """Lists of points, null where `like` is."""
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(lat)), pa.array(np.ascontiguousarray(lon))], ["lat", "lon"])
    kind = pa.list_(points.type)
    return pa.Array.from_buffers(kind, len(sizes), [_valid(like), pa.py_buffer(_starts(sizes).astype(np.int32))], children=[points])


def simplifier(tolerance_m: float):
    """A function that drops points nearer than the tolerance to the line that stays (Douglas-Peucker, farthest first).

    All tracks of a batch are cut at once: each round looks at the pieces that the round before has made.
    """

    @F.arrow_udf(_POINTS)
    def simplify(tracks: pa.Array) -> pa.Array:
        sizes, lat, lon = _flat(tracks)
        starts = _starts(sizes)
        some = sizes > 0
        head, tail = starts[:-1][some], starts[1:][some] - 1
        scale = math.pi * EARTH_M / 180
        ref = np.repeat(np.array([math.cos(math.radians(v)) for v in lat[head]]), sizes[some])
        x, y = lon * scale * ref, lat * scale
        keep = np.zeros(len(lat), bool)
        keep[head] = keep[tail] = True
        a, b = head, tail
        while len(a):
            long = b - a >= 2
            a, b = a[long], b[long]
            if not len(a):
                break
            inner = b - a - 1
            at = _starts(inner)
            i = np.arange(at[-1]) - np.repeat(at[:-1] - a - 1, inner)
            dx, dy = x[b] - x[a], y[b] - y[a]
            span = np.hypot(dx, dy)
            wide = lambda v: np.repeat(v, inner)  # noqa: E731, B023
            near = np.hypot(x[i] - wide(x[a]), y[i] - wide(y[a]))
            line = np.abs(wide(dy) * x[i] - wide(dx) * y[i] + wide(x[b] * y[a]) - wide(y[b] * x[a])) / wide(np.where(span == 0, 1.0, span))
            off = np.where(wide(span) == 0, near, line)
            most = np.maximum.reduceat(off, at[:-1])
            hits = np.flatnonzero(off == wide(most))
            far = i[hits[np.searchsorted(hits, at[:-1][most > tolerance_m])]]
            cut = most > tolerance_m
            keep[far] = True
            a, b = np.concatenate([a[cut], far]), np.concatenate([far, b[cut]])
        kept = np.add.reduceat(keep, head) if len(head) else np.zeros(0, np.int64)
        left = np.zeros(len(sizes), np.int64)
        left[some] = kept
        return _listed(tracks, left, lat[keep], lon[keep])

    return simplify
