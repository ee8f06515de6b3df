"""Homes to road edges: a spatial range join with nearest vertex, on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.lineage import cut

#: Runs of the search, and factor of the padding from one to the next.
MAX_RUNS, INCREMENT = 5, 10.0


def nearest_edges(homes: DataFrame, edges: DataFrame, padding: float, by: list[str] | None = None) -> DataFrame:
    """(by, hid, u, v, key, dist_m) for every home with an edge in reach.

    In reach: the home lies in the edge's bounding box widened by twice the padding (both
    boxes are padded).  Among those the edge with the nearest *vertex* wins, ties by
    (u, v, key).  Each home has one grid cell, each widened box is listed under the cells
    that it meets, so that an equi-join finds the candidates; a crowded cell is a skewed
    join key, which adaptive execution splits.  ``by`` are further equi-join columns, such
    as a region.
    """
    by = by or []
    reach = 2 * padding
    cell = reach
    h = homes.select(*by, "hid", "lon", "lat", F.floor(F.col("lon") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
    e = edges.select(*by, "u", "v", "key", "coords", geo.bounds(F.col("coords")).alias("b"))
    low = lambda c: F.floor((F.col(c) - reach) / cell)
    high = lambda c: F.floor((F.col(c) + reach) / cell)
    e = e.withColumn("cx", F.explode(F.sequence(low("b.x1"), high("b.x2")))).withColumn("cy", F.explode(F.sequence(low("b.y1"), high("b.y2"))))
    near = h.join(e, [*by, "cx", "cy"]).where(
        (F.col("lon") >= F.col("b.x1") - reach) & (F.col("lon") <= F.col("b.x2") + reach) & (F.col("lat") >= F.col("b.y1") - reach) & (F.col("lat") <= F.col("b.y2") + reach)
    )
    vertex = near.select(*by, "hid", "lon", "lat", "u", "v", "key", F.explode("coords").alias("p")).select(*by, "hid", "lon", "lat", "u", "v", "key", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    dist = geo.with_geodesic(vertex, "lon", "lat", "px", "py", "m")
    best = dist.groupBy(*by, "hid").agg(F.min(F.struct(F.col("m").alias("dist_m"), "u", "v", "key")).alias("n"))
    return best.select(*by, "hid", "n.u", "n.v", "n.key", "n.dist_m")


def around(homes: DataFrame, edges: DataFrame, reach: float, by: list[str] | None = None) -> DataFrame:
    """The edges whose bounding box, widened by ``reach``, meets the homes' box; no other has a home in reach."""
    by = by or []
    box = F.broadcast(homes.groupBy(*by).agg(F.min("lon").alias("hx1"), F.min("lat").alias("hy1"), F.max("lon").alias("hx2"), F.max("lat").alias("hy2")))
    e = edges.withColumn("b_", geo.bounds(F.col("coords")))
    e = e.join(box, by) if by else e.crossJoin(box)
    meets = (F.col("hx2") >= F.col("b_.x1") - reach) & (F.col("hx1") <= F.col("b_.x2") + reach) & (F.col("hy2") >= F.col("b_.y1") - reach) & (F.col("hy1") <= F.col("b_.y2") + reach)
    return e.where(meets).select(*edges.columns)


def map_homes(homes: DataFrame, edges: DataFrame, padding: float, by: list[str] | None = None, max_runs: int = MAX_RUNS, increment: float = INCREMENT) -> DataFrame:
    """One row per home: the nearest edge at the first padding that has any (``pad_level`` from 0); nulls if none of the runs has.

    Only homes without an edge go on to the next run; runs stop as soon as none is left.
    """
    by = by or []
    found: DataFrame | None = None
    left = cut(homes.select(*by, "hid", "lon", "lat"))
    for level in range(max_runs):
        pad = padding * increment**level
        got = cut(nearest_edges(left, around(left, edges, 2 * pad, by), pad, by).withColumn("pad_level", F.lit(level)))
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select(*by, "hid"), [*by, "hid"], "left_anti")
        if left.isEmpty():
            return found
    nothing = left.select(*by, "hid", *(F.lit(None).cast(t).alias(c) for c, t in (("u", "long"), ("v", "long"), ("key", "int"), ("dist_m", "double"), ("pad_level", "int"))))
    return found.unionByName(nothing)


def homes_by_edge(mapping: DataFrame, homes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, u, v, key, homes): the mapped homes of each edge, in order of id."""
    by = by or []
    own = mapping.where("u is not null").join(homes.select(*by, "hid", "lon", "lat", "load"), [*by, "hid"])
    return own.groupBy(*by, "u", "v", "key").agg(F.sort_array(F.collect_list(F.struct("hid", "lon", "lat", "load"))).alias("homes"))


def unmapped(homes: DataFrame, mapping: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Homes that no run has mapped."""
    return homes.join(mapping.where("u is not null"), [*(by or []), "hid"], "left_anti")
