"""Convex hull: points inside the extremes of a few directions are left out, each partition is narrowed to its own corners, a few rounds narrow further, the driver finishes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directions whose farthest points are looked for first.
DIRECTIONS = 16


def monotone_chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull corners in counter-clockwise order; points on an edge are left out."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(order: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def convex_hull(points: DataFrame, x: str = "lon", y: str = "lat") -> list[tuple[float, float]]:
    """Hull of a point table; ``ValueError`` if it is empty.

    A point inside the polygon of the farthest points of ``DIRECTIONS`` directions is no corner, so
    nearly all points are left out before Python sees them.
    The hull of all points is the hull of the partitions' hulls, so only corners leave a
    partition; with many partitions their corners are narrowed again, 64 to one, before
    the last few come to the driver.
    """

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[float, float]] = []
        for b in batches:
            held = monotone_chain(held + list(zip(b["x"], b["y"], strict=True)))
        yield pd.DataFrame(held, columns=["x", "y"])

    df = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    far = [F.max_by(F.struct("x", "y"), F.col("x") * math.cos(a) + F.col("y") * math.sin(a)) for a in (2 * math.pi * i / DIRECTIONS for i in range(DIRECTIONS))]
    extremes = [(p.x, p.y) for p in df.agg(F.array(*far).alias("p")).first().p if p is not None]
    df = df.where(~strictly_inside(monotone_chain(extremes), "x", "y"))
    parts = df.rdd.getNumPartitions()
    df = df.mapInPandas(corners, "x double, y double")
    while parts > 64:
        parts = -(-parts // 64)
        df = df.repartition(parts).mapInPandas(corners, "x double, y double")
    found = [(r.x, r.y) for r in df.collect()]
    if not found:
        raise ValueError("no homes: a hull needs at least one point")
    return monotone_chain(found)


def bounding_box(points: DataFrame, buffer: float = 0.01, x: str = "lon", y: str = "lat") -> DataFrame:
    """One row: lon_min, lat_min, lon_max, lat_max of the points, widened by ``buffer`` degrees on every side, and their number; nulls without points."""
    low, high = F.lit(-buffer), F.lit(buffer)
    return points.agg(
        (F.min(x) + low).alias("lon_min"), (F.min(y) + low).alias("lat_min"), (F.max(x) + high).alias("lon_max"), (F.max(y) + high).alias("lat_max"), F.count("*").alias("points")
    )


def strictly_inside(hull: list[tuple[float, float]], x: str = "lon", y: str = "lat") -> Column:
    """Left of every edge: on an edge or a corner is outside.  A hull without area holds nothing."""
    if len(hull) < 3:
        return F.lit(False)
    xs, ys = [p[0] for p in hull], [p[1] for p in hull]
    # the box first: simple ranges that a columnar scan can skip by
    inside = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
        inside = inside & ((F.lit(bx - ax) * (F.col(y) - ay) - F.lit(by - ay) * (F.col(x) - ax)) > 0)
    return inside
