"""Nearest target on the sphere without a radius: cells grow until the best found can't be beaten."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.geometry import haversine
from millrace.operators.durable import durable, salted_join

EARTH_KM = 6371.0
_CELL = ["cx", "cy", "cz"]


def _given(*columns: Column) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & c.isNotNull() & ~F.isnan(c.cast("double"))
    return test


def _cells(lat: Column, lon: Column, side: float) -> list[Column]:
    """Cell of a point of the unit sphere in space, where neither the date line nor a pole is a border."""
    x, y, z = F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))
    return [F.floor(v / side).alias(c) for v, c in zip((x, y, z), _CELL)]


def _vectors(lat: pa.ChunkedArray, lon: pa.ChunkedArray) -> np.ndarray:
    a, b = np.radians(lat.to_numpy()), np.radians(lon.to_numpy())
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def _leading(points: pa.Table, targets: pa.Table) -> pa.Table:
    """Each point beside the targets that are nearest but for rounding."""
    p, t, rows, cols = _vectors(points["lat"], points["lon"]), _vectors(targets["t_lat"], targets["t_lon"]).T, [], []
    for lo in range(0, len(p) if t.shape[1] else 0, 128):
        near = p[lo : lo + 128] @ t
        i, j = np.nonzero(near >= near.max(axis=1, keepdims=True) - 1e-14)
        rows.append(i + lo)
        cols.append(j)
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, cols))
    own, other = points.select(["pid", "lat", "lon"]).take(pa.array(i)), targets.select(["tid", "t_lat", "t_lon"]).take(pa.array(j))
    return pa.table([*own.columns, *other.columns], names=[*own.column_names, *other.column_names])


def _closest(asked: DataFrame, known: DataFrame, crowded: DataFrame, most: int = 20_000) -> DataFrame:
    """(pid, lat, lon, tid, t_lat, t_lon): points of crowded cells beside their nearest targets, of each part of a cell. A part has about `most` points and targets."""
    counted = asked.join(crowded, _CELL, "left_semi").groupBy(*_CELL).agg(F.ceil(F.count("*") / most).alias("slots"))
    parts = durable(crowded.withColumn("lots", F.ceil(F.col("n") / most)).join(counted, _CELL).select(*_CELL, "lots", "slots"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(parts, _CELL).withColumn("slot", F.pmod(F.xxhash64("pid", "lat", "lon"), "slots")).withColumn("lot", every("lots"))
    right = known.join(parts, _CELL).withColumn("lot", F.pmod(F.xxhash64("t_lat", "t_lon"), "lots")).withColumn("slot", every("slots"))
    key, tasks = [*_CELL, "lot", "slot"], 4 * asked.sparkSession.sparkContext.defaultParallelism  # little to read, much to compute: not to be put together by size
    sides = [x.select(*key, *rest).repartition(tasks, *key).groupBy(*key) for x, rest in ((left, ["pid", "lat", "lon"]), (right, ["tid", "t_lat", "t_lon"]))]
    types = {f.name: f.dataType.simpleString() for x in (left, right) for f in x.schema}
    return sides[0].cogroup(sides[1]).applyInArrow(_leading, ", ".join(f"{c} {types[c]}" for c in ("pid", "lat", "lon", "tid", "t_lat", "t_lon")))


def nearest(points: DataFrame, targets: DataFrame, pid: str = "pid", tid: str = "tid", value: str | None = None, lat: str = "lat", lon: str = "lon", few: int = 256) -> DataFrame:
    """(pid, lat, lon, tid, km) of each different point: its nearest target and the great-circle distance, ties to the least tid.

    Longitudes may run to 180 or to 360. Targets without a position, or whose `value` is null or NaN, are
    skipped; a point without a position, or for which no target is left, has a null tid.

    A point meets the targets in its own cell and the 26 around it. Whatever lies outside is farther off
    than a cell is wide, so a best nearer than that is final; the other points go on with cells twice as
    wide, until one block of cells holds the whole sphere. Cells start as wide as targets are apart, so that on
    a grid nearly all points end in the first rounds. Targets, not points, are copied to the cells around, and
    stand there in lists of up to `few`: a point meets a list in one row and takes its best at once, so no row is made of
    a point and a target. Cells with more targets are compared as blocks of vectors, in parts of bounded size.
    """
    held = _given(F.col(lat), F.col(lon)) if value is None else _given(F.col(lat), F.col(lon), F.col(value))
    spots = durable(targets.where(held).groupBy(F.col(lat).cast("double").alias("t_lat"), F.col(lon).cast("double").alias("t_lon")).agg(F.min(tid).alias("tid")))
    given = points.select(F.col(pid).alias("pid"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).distinct()
    n = spots.count()
    none = given.select("*", F.lit(None).cast(spots.schema["tid"].dataType).alias("tid"), F.lit(None).cast("double").alias("km"))
    if not n:
        return none
    todo, done, side = durable(given.where(_given(F.col("lat"), F.col("lon")))), none.where(~_given(F.col("lat"), F.col("lon"))), min(1.0, math.sqrt(4 * math.pi / n))
    while not todo.isEmpty():
        around = F.array(*[F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(_CELL, (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
        asked = durable(todo.select("pid", "lat", "lon", *_cells(F.col("lat"), F.col("lon"), side)))
        known = spots.select("tid", "t_lat", "t_lon", *_cells(F.col("t_lat"), F.col("t_lon"), side)).select("tid", "t_lat", "t_lon", F.inline(around))
        known = durable(known.join(asked.select(*_CELL).distinct(), _CELL, "left_semi"))
        per = durable(known.groupBy(*_CELL).agg(F.count("*").alias("n")))
        lists = known.join(per.where(F.col("n") <= few), _CELL).groupBy(*_CELL).agg(F.collect_list(F.struct("tid", "t_lat", "t_lon")).alias("near"))
        km = lambda t_lat, t_lon: haversine(F.col("lat"), F.col("lon"), t_lat, t_lon, EARTH_KM).alias("km")
        met = salted_join(asked, lists, _CELL).select("pid", "lat", "lon", F.array_min(F.transform("near", lambda t: F.struct(km(t["t_lat"], t["t_lon"]), t["tid"].alias("tid")))).alias("best"))
        crowded = per.where(F.col("n") > few)
        if not crowded.isEmpty():
            met = met.unionByName(_closest(asked, known, crowded).select("pid", "lat", "lon", F.struct(km(F.col("t_lat"), F.col("t_lon")), "tid").alias("best")))
        best = met.groupBy("pid", "lat", "lon").agg(F.min("best").alias("best"))
        best = durable(best.select("pid", "lat", "lon", "best.tid", "best.km"))
        final = F.lit(True) if side >= 2 else 2 * F.sin(F.col("km") / (2 * EARTH_KM)) <= side * (1 - 1e-9)
        done = done.unionByName(best.where(final))
        todo = durable(todo.join(best.where(final).select("pid", "lat", "lon"), ["pid", "lat", "lon"], "left_anti"))
        side *= 2
    return done
