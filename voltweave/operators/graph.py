"""Graph operators: components, joining components, splicing, network Voronoi cells, community split.

Nodes are (node_id string, lon, lat, label, load), edges (u, v, key, highway, length, coords).
Each function takes ``by``, columns (such as a region) within which graphs are separate.
"""

from __future__ import annotations

import heapq
from copy import copy
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.lineage import cut, parallelism


def joined(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes 0..n-1 can reach: roots hang on lower roots, then all paths are shortened."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def components(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None, task_edges: int | None = None) -> DataFrame:
    """(by, node_id, component): component is the smallest node id that can be reached.

    Regions of up to ``task_edges`` edges (and nodes) are a task each, as arrays; if any has more, rounds of joins do them all.
    """
    most = TASK_EDGES if task_edges is None else task_edges
    sizes = [df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most) for df in (nodes, edges)] if by else []
    if not by or not all(df.isEmpty() for df in sizes):
        return components_rounds(nodes, edges, by)
    kinds = dict(nodes.dtypes)

    def run(points: pa.Table, e: pa.Table) -> pa.Table:
        if not points.num_rows:
            return pa.table({k: pa.array([], points.schema.field(k).type) for k in by} | {c: pa.array([], points.schema.field("node_id").type) for c in ("node_id", "component")})
        names = pc.unique(points["node_id"])
        names = names.take(pc.sort_indices(names))
        u, v = (pc.index_in(e[c], names) for c in ("u", "v"))
        known = pc.and_(pc.is_valid(u), pc.is_valid(v))
        u, v = (x.filter(known).to_numpy() for x in (u, v))
        least = names.take(pa.array(joined(u, v, len(names))))
        return pa.table({k: pa.repeat(points[k][0], len(names)) for k in by} | {"node_id": names, "component": least})

    types = ", ".join([*(f"{k} {kinds[k]}" for k in by), f"node_id {kinds['node_id']}, component {kinds['node_id']}"])
    left, right = nodes.select(*by, "node_id").where("node_id is not null"), edges.select(*by, F.col("u").cast(kinds["node_id"]).alias("u"), F.col("v").cast(kinds["node_id"]).alias("v"))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # new identities: both may stem from the same tables
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, types)


def components_rounds(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None, max_rounds: int = 60) -> DataFrame:
    """The same by rounds of joins, for graphs that no worker holds.

    Labels are lowered over the edges and then over the labels themselves (a node takes its
    label's label), so that the rounds grow with the logarithm of a component's diameter.
    Each round is checkpointed; the loop ends when no label changes.
    """
    by = by or []
    both = edges.select(*by, F.col("u").alias("a"), F.col("v").alias("b"))
    both = cut(both.union(both.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    label = cut(nodes.select(*by, "node_id", F.col("node_id").alias("c")))
    for _ in range(max_rounds):
        seen = both.join(label.select(*by, F.col("node_id").alias("b"), "c"), [*by, "b"]).groupBy(*by, F.col("a").alias("node_id")).agg(F.min("c").alias("m"))
        low = label.join(seen, [*by, "node_id"], "left").select(*by, "node_id", "c", F.coalesce(F.least("c", "m"), "c").alias("n"))
        # hooking: a label learns the lowest label that any of its nodes has seen
        hook = low.groupBy(*by, F.col("c").alias("node_id")).agg(F.min("n").alias("h"))
        low = low.join(hook, [*by, "node_id"], "left").select(*by, "node_id", "c", F.least("n", F.coalesce("h", "n")).alias("n"))
        up = low.select(*by, F.col("node_id").alias("n"), F.col("n").alias("nn"))
        new = cut(low.join(up, [*by, "n"]).select(*by, "node_id", F.col("nn").alias("c2"), "c"))
        changed = new.where("c != c2").limit(1).count()
        label = new.select(*by, "node_id", F.col("c2").alias("c"))
        if not changed:
            return label.withColumnRenamed("c", "component")
    raise RuntimeError("components did not settle")


def join_components(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the connected network.

    A graph in one piece stays as it is.  Otherwise components without a transformer are
    dropped and every other one is tied to the largest (most nodes, then smallest id) by
    the shortest pair of road nodes, ties by (u, v).  A component that cannot be tied raises ValueError.
    """
    by = by or []
    comp = cut(components(nodes, edges, by))
    own = nodes.join(comp, [*by, "node_id"])
    stat = own.groupBy(*by, "component").agg(F.count("*").alias("n"), F.max((F.col("label") == "T").cast("int")).alias("t"))
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    stat = stat.withColumn("pieces", F.count("*").over(total)).where("pieces = 1 or t = 1")
    rank = total.orderBy(F.desc("n"), "component")
    stat = cut(stat.withColumn("rank", F.row_number().over(rank)).select(*by, "component", "rank"))
    kept = cut(own.join(stat, [*by, "component"]))
    ids = kept.select(*by, "node_id")
    old = edges.join(ids.withColumnRenamed("node_id", "u"), [*by, "u"], "left_semi").select(*edges.columns)
    ties = nearest_pairs(kept.where("rank = 1 and label = 'R'"), kept.where("rank > 1 and label = 'R'"), by)
    untied = stat.where("rank > 1").join(ties.select(*by, "component"), [*by, "component"], "left_anti").limit(3).collect()
    if untied:
        raise ValueError(f"not connected: {', '.join(str(r.component) for r in untied)}")
    new = ties.select(*by, "u", "v", F.lit("unclassified").alias("highway"), "length", geo.straight("ux", "uy", "vx", "vy").alias("coords"))
    return kept.select(*nodes.columns), add_edges(old, new, by)


def union_edges(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges of both undirected graphs; of equal (by, u, v, key), in either direction, the attributes of ``new`` hold.

    Both have the same columns; a pair's ends come back in order, u the smaller.
    """
    by = by or []
    rest = [c for c in old.columns if c not in (*by, "u", "v", "key")]
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    pair = both.select(*by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "key", "side", F.struct(*rest).alias("a"))
    one = pair.groupBy(*by, "u", "v", "key").agg(F.max_by("a", "side").alias("a"), F.count("*").alias("rows"))
    return one.select(*by, "u", "v", "key", "a.*", "rows")


def nearest_pairs(main: DataFrame, others: DataFrame, by: list[str], first_cell: float = 0.002) -> DataFrame:
    """For every component of ``others`` the shortest pair (u in ``main``, v in it) with its length and points.

    Pairs are looked up in grid cells and the eight around them.  A component is settled at the first cell
    width that finds it a pair no longer than the cell is wide (in metres of its narrower side), since
    everything as near is then among the candidates; the width doubles for the rest.  What no cell of up
    to 20 degrees settles is held against all of ``main``.
    """
    others = others.select(*by, "component", F.col("node_id").alias("v"), F.col("lon").alias("vx"), F.col("lat").alias("vy"))
    main = main.select(*by, F.col("node_id").alias("u"), F.col("lon").alias("ux"), F.col("lat").alias("uy"))
    done: DataFrame | None = None
    left = others
    for level in count():
        w = first_cell * 2**level
        last = w > 20
        if last:
            both = left.join(main, by) if by else left.crossJoin(main)
        else:
            a = main.withColumn("cx", F.floor(F.col("ux") / w)).withColumn("cy", F.floor(F.col("uy") / w))
            around = F.sequence(F.lit(-1), F.lit(1))
            b = left.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
            b = b.withColumn("cx", F.floor(F.col("vx") / w) + F.col("dx")).withColumn("cy", F.floor(F.col("vy") / w) + F.col("dy"))
            both = b.join(a, [*by, "cx", "cy"])
        pair = geo.with_geodesic(both, "ux", "uy", "vx", "vy", "length")
        best = pair.groupBy(*by, "component").agg(F.min(F.struct("length", "u", "v", "ux", "uy", "vx", "vy")).alias("p"))
        safe = F.lit(w * 110_000.0) * F.cos(F.radians(F.greatest(F.abs("p.uy"), F.abs("p.vy"))))
        got = cut(best.where(F.lit(True) if last else F.col("p.length") <= safe).select(*by, "component", "p.*"))
        done = got if done is None else done.unionByName(got)
        left = left.join(got.select(*by, "component"), [*by, "component"], "left_anti")
        if last or left.isEmpty():
            break
    return done


def add_edges(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Old edges and new ones without a key; a new edge takes the next free keys of its pair of nodes."""
    by = by or []
    pair = [*by, "a", "b"]
    low = lambda df: df.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v"))
    own = low(new)
    used = low(old).join(own.select(*pair).distinct(), pair, "left_semi").groupBy(*pair).agg((F.max("key") + 1).alias("base"))
    order = Window.partitionBy(*pair).orderBy("length", "u", "v")
    keyed = own.join(used, pair, "left").withColumn("key", (F.coalesce("base", F.lit(0)) + F.row_number().over(order) - 1).cast("int"))
    return old.unionByName(keyed.select(*old.columns))


def splice(road_nodes: DataFrame, road_edges: DataFrame, transformers: DataFrame, sequences: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Road network with transformers: every road edge that has a sequence becomes a chain of straight edges.

    ``sequences`` is (by, u, v, key, seq) with seq an ordered array of node ids; a sequence of an
    unknown edge is skipped, in either direction.  Chain edges inherit the highway class; an edge
    to a node without a place is left out.
    """
    by = by or []
    nodes = road_nodes.select(*by, "node_id", "lon", "lat", F.lit(0.0).alias("load"), F.lit("R").alias("label"))
    canon = [*by, "u_", "v_", "key"]
    low = lambda df: df.withColumn("u_", F.least("u", "v")).withColumn("v_", F.greatest("u", "v"))
    edges, seq = low(road_edges), low(sequences)
    known = seq.select(*canon, "seq").join(edges.select(*canon, "highway"), canon)
    used = known.select(*by, F.explode("seq").alias("node_id")).distinct()
    t = transformers.select(*by, F.col("transformer_id").alias("node_id"), "lon", "lat", "load", F.lit("T").alias("label")).join(used, [*by, "node_id"], "left_semi")
    every = nodes.unionByName(t.select(*nodes.columns))
    chain = known.select(*by, F.coalesce("highway", F.lit("unclassified")).alias("highway"), F.explode(pairs("seq")).alias("p")).select(*by, "highway", "p.u", "p.v")
    place = every.select(*by, "node_id", "lon", "lat")
    ends = chain.join(place.toDF(*by, "u", "ux", "uy"), [*by, "u"]).join(place.toDF(*by, "v", "vx", "vy"), [*by, "v"])
    made = geo.with_geodesic(ends, "ux", "uy", "vx", "vy", "length").withColumn("coords", geo.straight("ux", "uy", "vx", "vy"))
    rest = edges.join(known.select(*canon), canon, "left_anti").select(*road_edges.columns)
    return every, add_edges(rest, made.select(*by, "u", "v", "highway", "length", "coords"), by)


def pairs(seq: str):
    """Array of consecutive (u, v) of an array."""
    at = F.sequence(F.lit(0), F.size(seq) - 2)
    return F.when(F.size(seq) >= 2, F.transform(at, lambda i: F.struct(F.col(seq)[i].alias("u"), F.col(seq)[i + 1].alias("v"))))


def induced(edges: DataFrame, cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges whose two ends are in the same cell, with ``sub_id``; cells is (by, node_id, sub_id)."""
    by = by or []
    a, b = cells.select(*by, F.col("node_id").alias("u"), "sub_id"), cells.select(*by, F.col("node_id").alias("v"), F.col("sub_id").alias("sub_v"))
    return edges.join(a, [*by, "u"]).join(b, [*by, "v"]).where("sub_id = sub_v").select("sub_id", *edges.columns)


# -- network Voronoi cells -----------------------------------------------------------------------


def dijkstra(u: np.ndarray, v: np.ndarray, w: np.ndarray, centres: list[str]) -> dict[str, tuple[float, str]]:
    """Distance and nearest centre of every node in reach; of equal distances (to a micrometre) the smaller centre."""
    near: dict[str, list[tuple[str, float]]] = {}
    for a, b, d in zip(u, v, w, strict=True):
        near.setdefault(a, []).append((b, d))
        near.setdefault(b, []).append((a, d))
    best: dict[str, tuple[float, str]] = {}
    heap = [((0.0, c), 0.0, c) for c in sorted(set(centres))]
    heapq.heapify(heap)
    while heap:
        (_, centre), d, node = heapq.heappop(heap)
        if node in best:
            continue
        best[node] = (d, centre)
        for other, step in near.get(node, ()):
            if other not in best:
                heapq.heappush(heap, ((round(d + step, 6), centre), d + step, other))
    return best


def nearest(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same over node numbers 0..n-1: distances (inf: out of reach) and places in ``seeds``, whose order decides ties.

    Of the nodes that have come nearer, those within a mean edge of the least are relaxed at once, so that there are no
    objects per node or edge and few nodes are relaxed again.
    """
    frm = np.concatenate([u, v])
    order = np.argsort(frm, kind="stable")
    to, step = np.concatenate([v, u])[order], np.concatenate([w, w])[order]
    degree = np.bincount(frm, minlength=n)
    first = np.cumsum(degree) - degree
    dist, near, centre = np.full(n, np.inf), np.full(n, np.inf), np.full(n, len(seeds), np.int32)  # near: to a micrometre
    wide = step.mean() if len(step) else 0.0
    waits = np.zeros(n, bool)
    todo = seeds
    dist[todo], near[todo], centre[todo] = 0, 0, np.arange(len(seeds))
    while len(todo):
        ahead = dist[todo]
        soon = ahead <= ahead.min() + wide
        front, todo = todo[soon], todo[~soon]
        waits[front] = False
        d = degree[front]
        slot = np.arange(d.sum()) + np.repeat(first[front] - (np.cumsum(d) - d), d)
        end, far, own = to[slot], np.repeat(dist[front], d) + step[slot], np.repeat(centre[front], d)
        short = np.round(far, 6)
        better = np.flatnonzero((short < near[end]) | ((short == near[end]) & (own < centre[end])))
        better = better[np.lexsort((far[better], own[better], short[better], end[better]))]
        front = end[better]
        one = np.flatnonzero(np.diff(front, prepend=-1))
        front, better = front[one], better[one]
        dist[front], near[front], centre[front] = far[better], short[better], own[better]
        todo = np.concatenate([todo, front[~waits[front]]])
        waits[front] = True
    return dist, centre


def voronoi(edges: DataFrame, centres: DataFrame, by: list[str]) -> DataFrame:
    """(by, node_id, centre, dist): nearest centre of every node along the network, a region a task.

    A region's graph must fit a worker, at some 150 bytes an edge; ``voronoi_frontier`` has no such limit, and
    ``nearest_centres`` chooses.
    """
    kinds = {c: t for c, t in edges.dtypes}

    def run(e: pa.Table, c: pa.Table) -> pa.Table:
        whole = (e if e.num_rows else c).slice(0, 1)
        names = pa.chunked_array([*e["u"].chunks, *e["v"].chunks, *c["node_id"].chunks], pa.string()).dictionary_encode()
        if names.num_chunks:
            names = names.combine_chunks()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        code, names = names.indices.to_numpy(), names.dictionary
        m = e.num_rows
        seeds = names.take(pa.array(np.unique(code[2 * m :])))
        seeds = seeds.take(pc.sort_indices(seeds))
        dist, centre = nearest(code[:m], code[m : 2 * m], e["length"].to_numpy(), len(names), pc.index_in(seeds, names).to_numpy())
        found = np.flatnonzero(np.isfinite(dist))
        out = {k: pa.repeat(whole[k][0], len(found)) for k in by}
        return pa.table(out | {"node_id": names.take(pa.array(found)), "centre": seeds.take(pa.array(centre[found])), "dist": dist[found]})

    types = ", ".join([*(f"{k} {kinds[k]}" for k in by), "node_id string, centre string, dist double"])
    left, right = edges.select(*by, "u", "v", "length"), centres.select(*by, "node_id")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # new identities: both may stem from the same tables
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, types)


def voronoi_frontier(edges: DataFrame, centres: DataFrame, by: list[str] | None = None, max_rounds: int = 10_000) -> DataFrame:
    """The same by rounds of joins (multi-source Bellman-Ford on the frontier), for graphs that no worker holds."""
    by = by or []
    e = edges.select(*by, "u", "v", "length")
    both = e.union(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v"), "length"))
    both = cut(both.groupBy(*by, "u", "v").agg(F.min("length").alias("w")))
    best = cut(centres.select(*by, "node_id", F.lit(0.0).alias("dist"), F.col("node_id").alias("centre")).distinct())
    front = best
    for _ in range(max_rounds):
        step = front.join(both.withColumnRenamed("u", "node_id"), [*by, "node_id"]).select(*by, F.col("v").alias("node_id"), (F.col("dist") + F.col("w")).alias("d"), "centre")
        step = step.groupBy(*by, "node_id").agg(F.min(F.struct(F.round("d", 6).alias("r"), "centre", "d")).alias("n"))
        both_ways = best.join(step, [*by, "node_id"], "full_outer")
        better = F.col("n").isNotNull() & (F.col("dist").isNull() | (F.col("n.r") < F.round("dist", 6)) | ((F.col("n.r") == F.round("dist", 6)) & (F.col("n.centre") < F.col("centre"))))
        new = both_ways.select(*by, "node_id", F.when(better, F.col("n.d")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("n.centre")).otherwise(F.col("centre")).alias("centre"), better.alias("moved"))
        new = cut(new)
        front = new.where("moved").drop("moved")
        best = new.drop("moved")
        if front.isEmpty():
            return best.select(*by, "node_id", "centre", "dist")
    raise RuntimeError("distances did not settle")


#: Edges of a region's graph up to which one task holds it.
TASK_EDGES = 4_000_000


def nearest_centres(edges: DataFrame, centres: DataFrame, by: list[str], task_edges: int = TASK_EDGES) -> DataFrame:
    """(by, node_id, centre, dist): regions of up to ``task_edges`` edges a task each, larger ones by rounds of joins."""
    large = edges.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > task_edges).select(*by)
    if large.isEmpty():
        return voronoi(edges, centres, by)
    if not by:
        return voronoi_frontier(edges, centres, by)
    small, rest = ([df.join(large, by, how) for df in (edges, centres)] for how in ("left_anti", "left_semi"))
    return voronoi(*small, by).unionByName(voronoi_frontier(*rest, by))


def partition(edges: DataFrame, centres: DataFrame, by: list[str], min_nodes: int = 100, task_edges: int = TASK_EDGES) -> DataFrame:
    """(by, sub_id, node_id, dist): cells around the substations' road nodes.

    ``centres`` is (by, sub_id, node_id).  Centres whose cell has at most ``min_nodes`` nodes are dropped
    and the cells of the rest are computed anew; ``ValueError`` if none is left.  Of substations on one
    node the one with the smallest id has the cell.
    """
    first = cut(nearest_centres(edges, centres, by, task_edges))
    big = first.groupBy(*by, "centre").agg(F.count("*").alias("n")).where(F.col("n") > min_nodes)
    own = centres.groupBy(*by, "node_id").agg(F.min("sub_id").alias("sub_id"))
    valid = cut(own.join(big.select(*by, F.col("centre").alias("node_id")), [*by, "node_id"], "left_semi"))
    if valid.isEmpty():
        raise ValueError("no substation has a large enough cell")
    cells = nearest_centres(edges.join(valid.select(*by).distinct(), by, "left_semi") if by else edges, valid, by, task_edges)
    return cells.join(valid.select(*by, F.col("node_id").alias("centre"), "sub_id"), [*by, "centre"]).select(*by, "sub_id", "node_id", "dist")


# -- community split -----------------------------------------------------------------------------


#: (source, node) pairs of a batch of sources; a pair takes some 25 bytes.
BATCH_PAIRS = 4_000_000
#: Nodes up to which a stretch of a graph is not cut again, and nodes of a layer up to which it is cut there.
STRETCH, LAYER = 128, 24


class _Walks:
    """Breadth-first searches from batches of sources, level by level; ``flow`` gathers what their shortest paths carry over each edge.

    Arrays over (source, node) pairs are made once and only the pairs that a batch has met are reset.
    """

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, pairs: int):
        frm, to = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(frm, kind="stable")
        self.degree = np.bincount(frm, minlength=n)
        self.first = np.cumsum(self.degree) - self.degree
        self.to, self.edge = to[order], order % max(len(a), 1)
        self.n, self.flow = n, np.zeros(len(a))
        self.size = min(n, max(1, pairs // max(n, 1)))
        self.dist = np.full(self.size * n, -1, np.int32)
        self.place, self.count = np.empty(self.size * n, np.int32), np.empty(self.size * n)
        self.row = np.arange(self.size) * n

    def beside(self) -> _Walks:
        """Searches over the same graph that add to the same flow, with arrays of their own."""
        other = copy(self)
        other.dist, other.place, other.count = np.full_like(self.dist, -1), np.empty_like(self.place), np.empty_like(self.count)
        return other

    def steps(self, pair: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all edges out of the pairs: place of the pair, pair at the other end, slot of the edge."""
        d = self.degree[node]
        at = np.repeat(np.arange(len(node)), d)
        slot = np.arange(len(at)) + np.repeat(self.first[node] - (np.cumsum(d) - d), d)
        return at, (pair - node)[at] + self.to[slot], slot

    def batches(self, sources: np.ndarray):
        return (sources[k : k + self.size] for k in range(0, len(sources), self.size))

    def search(self, sources: np.ndarray, wanted: np.ndarray | None = None, inside: np.ndarray | None = None, deepest: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(pairs, their nodes) of each level: until all ``wanted`` nodes are met from each source, through nodes ``inside`` only."""
        dist, place, count = self.dist, self.place, self.count
        pair, node = self.row[: len(sources)] + sources, sources
        dist[pair], count[pair] = 0, 1
        levels = []
        left = np.inf if wanted is None else len(sources) * np.count_nonzero(wanted) - np.count_nonzero(wanted[node])
        while len(pair):
            levels.append((pair, node))
            if left <= 0 or deepest is not None and len(levels) > deepest:
                break
            at, end, slot = self.steps(pair, node)
            new = dist[end] < 0
            if inside is not None:
                new &= inside[self.to[slot]]
            new = np.flatnonzero(new)
            at, end, slot = at[new], end[new], slot[new]
            here = np.arange(len(end), dtype=np.int32)
            place[end] = here
            one = np.flatnonzero(place[end] == here)  # each pair once
            found = end[one]
            place[found] = here[: len(found)]
            dist[found] = len(levels)
            count[found] = np.bincount(place[end], count[pair][at], len(found))
            pair, node = found, self.to[slot[one]]
            if wanted is not None:
                left -= np.count_nonzero(wanted[node])
        return levels

    def clear(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for pair, _ in levels:
            self.dist[pair] = -1

    def spend(self, levels: list[tuple[np.ndarray, np.ndarray]], weight) -> None:
        """Adds to ``flow`` the share of each edge in the shortest paths to all pairs, ``weight(pairs, nodes)`` paths to each; then clears."""
        dist, place, count = self.dist, self.place, self.count
        carried = np.zeros(len(levels[-1][0]))
        for d in range(len(levels) - 1, 0, -1):
            pair, node = levels[d]
            value = weight(pair, node) + carried
            some = np.flatnonzero(value)
            pair, node, value = pair[some], node[some], value[some]
            at, end, slot = self.steps(pair, node)
            up = np.flatnonzero(dist[end] == d - 1)
            at, end = at[up], end[up]
            share = count[end] * (value / count[pair])[at]
            over = self.edge[slot[up]]
            if 8 * len(over) < len(self.flow):  # few of the edges
                np.add.at(self.flow, over, share)
            else:
                self.flow += np.bincount(over, share, len(self.flow))
            carried = np.bincount(place[end], share, len(levels[d - 1][0])) if d > 1 else carried
        self.clear(levels)

    def reach(self, sources: np.ndarray, nodes: np.ndarray, **limits) -> tuple[np.ndarray, np.ndarray]:
        """Distance (-1: none) and number of shortest paths from each source to each of the nodes."""
        dist, count = [], []
        for some in self.batches(sources):
            levels = self.search(some, **limits)
            at = self.row[: len(some), None] + nodes
            dist.append(self.dist[at])
            count.append(np.where(dist[-1] < 0, 0, self.count[at]))
            self.clear(levels)
        return np.concatenate(dist), np.concatenate(count)


def _layers(walks: _Walks) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Nodes in order of their layer, where each layer begins, and the range of layers of each piece: by distance from a node at the piece's far end."""
    order, first, pieces, seen = [], [0], [], np.zeros(walks.n, bool)
    for i in range(walks.n):
        if seen[i]:
            continue
        levels = walks.search(np.array([i]))
        far = levels[-1][1][:1]
        walks.clear(levels)
        levels = walks.search(far)
        for _, node in levels:
            order.append(node)
            first.append(first[-1] + len(node))
            seen[node] = True
        walks.clear(levels)
        pieces.append((len(first) - 1 - len(levels), len(first) - 1))
    return np.concatenate(order), np.array(first), pieces


def _across(dl: np.ndarray, cl: np.ndarray, dr: np.ndarray, cr: np.ndarray, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Of the shortest paths between all left and all right nodes, how many (a pair counts one) reach each left and each right node by way of each middle node.

    ``dl``, ``cl`` (middle, left) and ``dr``, ``cr`` (middle, right) are distances and numbers of shortest paths, the right
    ones after the last middle node (count 0: none). Nodes with the same differences of distances share the middle nodes that
    lie on their shortest paths, so that the numbers of paths are products of matrices.
    """
    middle = len(dl)
    by_left, by_right = np.zeros(cl.shape), np.zeros(cr.shape)
    far = np.where(cr > 0, dr, 1 << 28)
    lead, own = np.unique((dl - dl.min(axis=0)).T, axis=0, return_inverse=True)
    trail, other = np.unique(np.minimum(far - far.min(axis=0), 1 << 28).T, axis=0, return_inverse=True)
    own, other = own.reshape(-1), other.reshape(-1)
    rows, bits = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own))[:-1]), 1 << np.arange(middle)
    for x, left in enumerate(rows):
        total = lead[x] + trail
        codes = (total == total.min(axis=1, keepdims=True)) @ bits
        which = codes[other]
        for code in np.unique(codes):
            on, right = np.flatnonzero(code & bits), np.flatnonzero(which == code)
            if len(on) == 1:
                by_left[on[0], left] += len(right)
                by_right[on[0], right] += len(left)
                continue
            p, q = cl[on[:, None], left], cr[on[:, None], right]
            of_left, of_right = np.zeros(p.shape), np.zeros(q.shape)
            for i in range(0, len(left), tile):
                some = p[:, i : i + tile]
                for j in range(0, len(right), tile):
                    others = q[:, j : j + tile]
                    paths = some.T @ others
                    np.reciprocal(paths, out=paths)
                    of_left[:, i : i + tile] += others @ paths.T
                    of_right[:, j : j + tile] += some @ paths
            by_left[on[:, None], left] += p * of_left
            by_right[on[:, None], right] += q * of_right
    return by_left, by_right


class _Cuts:
    """Betweenness of the edges, stretch by stretch: ``take`` adds to ``flow`` what a stretch's pairs of nodes carry.

    A graph is cut at narrow layers (all nodes at one distance from its far end) into a left and a right part, again and
    again. Paths between the parts are counted at the layer: those of a pair are the products of the numbers to
    and from its nodes, so that a search from each of these few nodes is enough. Pairs within a
    stretch of up to ``stretch`` nodes, or without a layer of up to ``layer`` nodes, are searched from
    each of their nodes until they have met. A batch of searches has at most ``pairs`` pairs (one source at least), so that
    memory grows with the nodes and edges, not with their square.
    """

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, pairs: int, stretch: int, layer: int):
        self.n, self.stretch, self.layer = n, stretch, layer
        self.walks = _Walks(n, a, b, pairs)
        self.after = self.walks.beside()
        self.flow = self.walks.flow
        self.order, self.first, self.pieces = _layers(self.walks)
        self.width = np.diff(self.first)
        self.depth = np.empty(n, np.int64)
        self.depth[self.order] = np.repeat(np.arange(len(self.width)), self.width)

    def take(self, low: int, high: int) -> list[tuple[int, int]]:
        """Adds the pairs within layers ``low`` to ``high``, but for those within the stretches that it returns."""
        walks, order, first, width, n = self.walks, self.order, self.first, self.width, self.n
        nodes = order[first[low] : first[high]]
        wanted = np.zeros(n, bool)
        wanted[nodes] = True
        ahead = first[low + 1 : high] - first[low]  # nodes up to each layer but the last
        fair = low + 1 + np.flatnonzero((ahead >= len(nodes) // 4) & (ahead <= len(nodes) - len(nodes) // 4))
        fair = fair[fair < high - 1]
        cut_at = fair[np.lexsort((np.abs(first[fair] - (first[low] + first[high]) // 2), width[fair]))[:1]] if len(nodes) > self.stretch else fair[:0]
        if not len(cut_at) or width[cut_at[0]] > self.layer:
            half = np.where(wanted, 0.5, 0.0)  # each pair is met from both ends
            for some in walks.batches(nodes):
                walks.spend(walks.search(some, wanted), lambda _, node: half[node])
            return []
        k = int(cut_at[0])
        left, middle, right = order[first[low] : first[k]], order[first[k] : first[k + 1]], order[first[k + 1] : first[high]]
        at = len(left), len(left) + len(middle)
        once = len(middle) <= walks.size  # then the searches are kept, else made again
        if once:
            levels, pair = walks.search(middle, wanted), walks.row[: len(middle), None]
            dist, number = walks.dist[pair + nodes], walks.count[pair + nodes]
            number[dist < 0] = 0
        else:
            dist, number = walks.reach(middle, nodes, wanted=wanted)
        beyond = {"inside": self.depth > k, "deepest": int(dist[:, at[1] :].max())}
        if once:
            later = self.after.search(middle, **beyond)
            far, paths = self.after.dist[pair + right], self.after.count[pair + right]
        else:
            far, paths = walks.reach(middle, right, **beyond)
        paths = np.where(far == dist[:, at[1] :], paths, 0)
        by_left, by_right = _across(dist[:, : at[0]], number[:, : at[0]], far, paths)
        weight = np.zeros((min(walks.size, len(middle)), n))
        rows = np.arange(len(middle))
        for some in (rows[x : x + walks.size] for x in range(0, len(rows), walks.size)):
            weight[: len(some), left], weight[: len(some), middle], weight[: len(some), right] = by_left[some] + 1, 0.5, 1
            walks.spend(levels if once else walks.search(middle[some], wanted), lambda pair, _: weight.reshape(-1)[pair])
            weight[: len(some), left], weight[: len(some), middle], weight[: len(some), right] = 0, 0, by_right[some]
            if once:
                self.after.spend(later, lambda pair, _: weight.reshape(-1)[pair])
            else:
                walks.spend(walks.search(middle[some], **beyond), lambda pair, _: weight.reshape(-1)[pair])
        return [(low, k), (k + 1, high)]

    def spread(self, every: int = 16, deepest: int = 64) -> np.ndarray:
        """At least the greatest distance between two nodes of each layer (the number of nodes where none was found).

        Two nodes of a layer are no farther apart than their forebears in an earlier layer and the ways to these.
        """
        walks, order, first = self.walks, self.order, self.first
        anchor = np.concatenate([np.arange(low, high, every) for low, high in self.pieces])
        apart = np.zeros(len(anchor), np.int64)
        for k in range(0, len(anchor), walks.size):
            some = anchor[k : k + walks.size]
            levels = walks.search(order[first[some]], deepest=deepest)
            at = np.repeat(np.arange(len(some)), self.width[some])
            own = order[np.arange(len(at)) + np.repeat(first[some] - (np.cumsum(self.width[some]) - self.width[some]), self.width[some])]
            dist = walks.dist[walks.row[at] + own].astype(np.int64)
            np.maximum.at(apart[k : k + walks.size], at, np.where(dist < 0, self.n, 2 * dist))
            walks.clear(levels)
        layers = np.arange(len(self.width))
        last = np.searchsorted(anchor, layers, side="right") - 1
        return np.minimum(apart[last] + 2 * (layers - anchor[last]), self.n)


def edge_betweenness(n: int, a: np.ndarray, b: np.ndarray, pairs: int = BATCH_PAIRS, stretch: int = STRETCH, layer: int = LAYER) -> np.ndarray:
    """Shortest-path betweenness of each edge, unweighted; ``_Cuts`` has the limits."""
    if not n:
        return np.zeros(len(a))
    cuts = _Cuts(n, a, b, pairs, stretch, layer)
    todo = list(cuts.pieces)
    while todo:
        todo += cuts.take(*todo.pop())
    return cuts.flow


def busiest(n: int, a: np.ndarray, b: np.ndarray, pairs: int = BATCH_PAIRS, stretch: int = STRETCH, layer: int = LAYER) -> int:
    """The edge of highest betweenness; ties (to a billionth) to the first edge.

    Stretches are taken only as long as their pairs could make another edge the busiest. A shortest path between nodes
    of layers i <= j, where no two nodes of layer i are more than s apart, is at most j - i + s long and so keeps to the layers from i - s / 2 to
    j + s / 2; each pair adds at most one to an edge. Edges that may tie with the highest have all their paths counted.
    """
    cuts = _Cuts(n, a, b, pairs, stretch, layer)
    flow, first, spread = cuts.flow, cuts.first, cuts.spread()
    at = np.minimum(cuts.depth[a], cuts.depth[b])
    ends = np.array(cuts.pieces)
    own = np.repeat(np.arange(len(ends)), ends[:, 1] - ends[:, 0])
    room = np.zeros(len(own), np.int64)  # the most that pairs not counted yet can add to an edge at each layer
    waiting: dict[tuple[int, int], tuple[slice, np.ndarray]] = {}

    def wait(low: int, high: int) -> None:
        total = int(first[high] - first[low])
        if total < 2:
            return
        half = (int(spread[low:high].max()) + 1) // 2
        reach = slice(max(int(ends[own[low], 0]), low - half), min(int(ends[own[low], 1]), high + half))
        d = np.arange(reach.start, reach.stop)
        lower = first[np.clip(d + half + 1, low, high)] - first[low]
        upper = first[high] - first[np.clip(d - half, low, high)]
        most = np.minimum(lower * upper, total * (total - 1) // 2)
        room[reach] += most
        waiting[low, high] = reach, most

    for part in cuts.pieces:
        wait(*part)
    while True:
        free = room[at]
        up = flow + free
        unsure = np.flatnonzero((free > 0) & (up >= flow.max() * (1 - 2e-9)))
        if not len(unsure):
            return int(np.flatnonzero((flow >= flow.max() * (1 - 1e-9)) & (free == 0))[0])
        layer_at = at[unsure[up[unsure].argmax()]]
        part = max((p for p, (reach, most) in waiting.items() if reach.start <= layer_at < reach.stop and most[layer_at - reach.start]), key=lambda p: first[p[1]] - first[p[0]])
        reach, most = waiting.pop(part)
        room[reach] -= most
        for rest in cuts.take(*part):
            wait(*rest)


def _pieces(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return joined(a, b, n)


def girvan_newman(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label of each node after removing the edges of highest betweenness until there is one more component; ties (to a billionth) to the first edge."""
    start = len(np.unique(_pieces(n, a, b)))
    while len(a):
        out = busiest(n, a, b)
        a, b = np.delete(a, out), np.delete(b, out)
        label = _pieces(n, a, b)
        if len(np.unique(label)) > start:
            return label
    return np.arange(n)


def split(n: int, a: np.ndarray, b: np.ndarray, load: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Community of each node and whether it stays too heavy: pieces of a thousandth of load >= ``most`` are split on; one node cannot be."""
    community, oversize = np.zeros(n, np.int64), np.zeros(n, bool)
    todo, done = [np.arange(n)], 0
    while todo:
        own = todo.pop()
        heavy = 1e-3 * load[own].sum() >= most
        if not heavy or len(own) == 1:
            community[own], oversize[own] = done, heavy
            done += 1
            continue
        at = np.full(n, -1)
        at[own] = np.arange(len(own))
        inside = (at[a] >= 0) & (at[b] >= 0)
        label = girvan_newman(len(own), at[a[inside]], at[b[inside]])
        todo += [own[label == x] for x in np.unique(label)[::-1]]
    return community, oversize


def simple_edges(names: pd.Series, u: pd.Series, v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``names`` of the two ends of each pair that has an edge, the lower first, in order; no loops. ``KeyError`` for an end without a place."""
    at = pd.Index(names)
    x, y = (at.get_indexer(ends) for ends in (u, v))
    if len(x) and min(x.min(), y.min()) < 0:
        raise KeyError("an edge ends at no node")
    pair = np.unique((np.minimum(x, y) * len(at) + np.maximum(x, y))[x != y])
    return pair // len(at), pair % len(at)


def communities(part_nodes: DataFrame, part_edges: DataFrame, capacity: float, max_feeders: int, by: list[str]) -> DataFrame:
    """(by, node_id, community, oversize) within each cell; capacity is the larger of the setting and a feeder's share of the cell's load."""
    kinds = dict(part_nodes.dtypes)

    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return pd.DataFrame(columns=[*by, "node_id", "community", "oversize"])
        nodes = nodes.sort_values("node_id", ignore_index=True)
        a, b = simple_edges(nodes["node_id"], edges["u"], edges["v"])
        load = nodes["load"].to_numpy(float)
        community, oversize = split(len(nodes), a, b, load, max(capacity, 1e-3 * load.sum() / max_feeders))
        # communities that hang together are one network again
        whole = nodes[by].iloc[[0]]
        out = pd.DataFrame({"node_id": nodes["node_id"], "community": community, "oversize": oversize})
        for i, k in enumerate(by):
            out.insert(i, k, whole[k].iloc[0])
        return out

    types = ", ".join([*(f"{k} {kinds[k]}" for k in by), "node_id string, community long, oversize boolean"])
    n = parallelism(part_nodes)
    left, right = part_nodes.select(*by, "node_id", "load"), part_edges.select(*by, "u", "v")
    left, right = (df.toDF(*df.columns).repartition(n, *by) for df in (left, right))  # new identities: both may stem from the same tables
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, types)

