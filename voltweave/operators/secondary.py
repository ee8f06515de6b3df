"""Secondary networks: transformer sites and service lines along every road link.

The choice of lines for a link is a path cover: its homes are covered by paths that
each start at a transformer site, with at most ``max_hops`` homes and ``max_rating``
of load on a path, at the least total of length + penalty * crossing.  Sites have no
cost and no limit of their own, so the first home of a path takes its cheapest site,
and only homes enter the solver.  Up to ``EXACT`` homes are solved exactly by
dynamic programming over subsets; larger links by savings and local moves on the
Delaunay edges, with a lower bound beside the cost.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Secondary
from ..functions import geo
from ..functions.lineage import cut, parallelism
from .mapping import homes_by_edge

#: Homes up to which all pairs are candidates and the cover is exact.
EXACT = 10
#: Links of one size that are solved at once (10 homes take some 150 KB a link).
BATCH = 128


def sites(edges: DataFrame, separation: float, by: list[str] | None = None) -> DataFrame:
    """(by, u, v, key, t, tx, ty): possible transformers every ``separation`` metres of each link."""
    keys = [*(by or []), "u", "v", "key"]
    return geo.interpolate(edges, keys, separation).select(*keys, F.col("i").alias("t"), F.col("x").alias("tx"), F.col("y").alias("ty"))


def home_sides(link_homes: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, u, v, key, hid, lon, lat, load, side) of the homes mapped to each link; 1 left of it, else -1."""
    keys = [*(by or []), "u", "v", "key"]
    one = link_homes.select(*keys, F.explode("homes").alias("h")).join(edges.select(*keys, "coords"), keys)
    side = geo.side_of_line(F.col("coords"), F.struct(F.col("h.lon").alias("x"), F.col("h.lat").alias("y")))
    return one.select(*keys, "h.hid", "h.lon", "h.lat", "h.load", side.alias("side"))


def home_pairs(sides: DataFrame, penalty: float, by: list[str] | None = None, limit: int = EXACT) -> DataFrame:
    """(by, u, v, key, a, b, length, crossing, cost) of all pairs of homes of a link, a < b.

    Only for links of at most ``limit`` homes; those of more have the edges of their triangulation as candidates.
    """
    keys = [*(by or []), "u", "v", "key"]
    small = sides.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") <= limit).select(*keys)
    sides = sides.join(small, keys, "left_semi")
    a = sides.select(*keys, F.col("hid").alias("a"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.col("side").alias("sa"))
    b = sides.select(*keys, F.col("hid").alias("b"), F.col("lon").alias("bx"), F.col("lat").alias("by_"), F.col("side").alias("sb"))
    both = geo.with_geodesic(a.join(b, keys).where("a < b"), "ax", "ay", "bx", "by_", "length")
    crossing = F.abs(F.col("sa") - F.col("sb"))
    return both.select(*keys, "a", "b", "length", crossing.alias("crossing"), (F.col("length") + penalty * crossing).alias("cost"))


def site_homes(sides: DataFrame, points: DataFrame, penalty: float, nearest: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, u, v, key, t, hid, tx, ty, length, crossing, cost) of site-to-home lines; only each site's ``nearest`` homes if that is set."""
    keys = [*(by or []), "u", "v", "key"]
    both = geo.with_geodesic(sides.join(points, keys), "lon", "lat", "tx", "ty", "length")
    if nearest is not None:
        order = Window.partitionBy(*keys, "t").orderBy("length", "hid")
        both = both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= nearest)
    crossing = F.abs(F.col("side"))
    return both.select(*keys, "t", "hid", "tx", "ty", "length", crossing.alias("crossing"), (F.col("length") + penalty * crossing).alias("cost"))


# -- path cover ----------------------------------------------------------------------------------


@lru_cache(maxsize=EXACT + 1)
def _layers(m: int) -> list[tuple[np.ndarray, ...]]:
    """For sets of 1, 2, ... m homes as bit masks: the sets; (set, last home) pairs with their rest; subsets that hold the lowest home, largest first."""
    out = []
    for k in range(1, m + 1):
        sets = np.array([sum(1 << i for i in c) for c in combinations(range(m), k)])
        whole, last = np.array([(s, j) for s in sets.tolist() for j in range(m) if s >> j & 1]).T
        parts = np.array([sorted((s & -s | sum(1 << i for i in c) for r in range(k) for c in combinations([i for i in range(m) if (s & s - 1) >> i & 1], r)), reverse=True) for s in sets.tolist()])
        out.append((sets, whole, last, whole ^ 1 << last, parts))
    return out


def exact_covers(cost: np.ndarray, start: np.ndarray, load: np.ndarray, rating: float, hops: int) -> list[list[list[int]] | None]:
    """For each of n links of m homes the cheapest cover by paths, or ``None``; ``cost`` (n, m, m) between homes, ``start`` (n, m) from the best site (inf: none).

    Dynamic programming over subsets, all links and all subsets of one size at once.
    """
    n, m = start.shape
    if not m:
        return [[] for _ in range(n)]
    layers, full = _layers(m), (1 << m) - 1
    path = np.full((n, full + 1, m), np.inf)  # cheapest path over a set that ends at a home
    prev = np.full((n, full + 1, m), -1, np.int8)
    total = np.zeros((n, full + 1))
    cover, part = np.full((n, full + 1), np.inf), np.zeros((n, full + 1), np.int64)
    cover[:, 0] = 0
    for s in range(1, full + 1):
        total[:, s] = total[:, s & s - 1] + load[:, (s & -s).bit_length() - 1]
    for k, (_, whole, last, rest, _) in enumerate(layers[:hops] if hops > 0 else [], 1):
        fits = total[:, whole] <= rating
        if k == 1:
            path[:, whole, last] = np.where(fits, start[:, last], np.inf)
            continue
        step = path[:, rest, :] + cost.transpose(0, 2, 1)[:, last, :]
        before = step.argmin(axis=2)
        least = np.where(fits, np.take_along_axis(step, before[:, :, None], 2)[:, :, 0], np.inf)
        path[:, whole, last] = least
        prev[:, whole, last] = np.where(np.isfinite(least), before, -1)
    best, end = path.min(axis=2), path.argmin(axis=2)
    for sets, _, _, _, parts in layers:  # parts hold the lowest home, so that every cover is seen once
        step = best[:, parts] + cover[:, sets[:, None] ^ parts]
        which = step.argmin(axis=2)
        cover[:, sets] = np.take_along_axis(step, which[:, :, None], 2)[:, :, 0]
        part[:, sets] = parts[np.arange(len(sets)), which]
    out: list[list[list[int]] | None] = []
    for x in range(n):
        if cover[x, full] == np.inf:
            out.append(None)
            continue
        paths, s = [], full
        while s:
            sub = int(part[x, s])
            s ^= sub
            i, own = int(end[x, sub]), []
            while i >= 0:
                own.append(i)
                i, sub = int(prev[x, sub, i]), sub ^ 1 << i
            paths.append(own[::-1])
        out.append(paths)
    return out


def exact_cover(cost: np.ndarray, start: np.ndarray, load: np.ndarray, rating: float, hops: int) -> list[list[int]] | None:
    """The same for one link."""
    return exact_covers(cost[None], start[None], load[None], rating, hops)[0]


def _triangles(p: list[tuple[float, float]]) -> dict[tuple[int, int], int]:
    """Delaunay triangles by insertion within the last three points, whose triangle holds all others: each directed edge and the corner to its left.

    A point walks to the triangle that holds it from the one made last; the triangles that give way lie around that one.
    """
    n = len(p) - 3
    left = {(n, n + 1): n + 2, (n + 1, n + 2): n, (n + 2, n): n + 1}
    at = (n, n + 1, n + 2)

    def holds(a: int, b: int, c: int, x: float, y: float) -> bool:
        """The circle around the triangle holds the point."""
        ax, ay, bx, by, cx, cy = p[a][0] - x, p[a][1] - y, p[b][0] - x, p[b][1] - y, p[c][0] - x, p[c][1] - y
        d = (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)
        return d * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) > 1e-14

    for i in range(n):
        x, y = p[i]
        a, b, c = at
        for _ in range(len(left)):
            for u, v in ((a, b), (b, c), (c, a)):
                (ux, uy), (vx, vy) = p[u], p[v]
                if (vx - ux) * (y - uy) - (vy - uy) * (x - ux) < 0 and (v, u) in left:
                    a, b, c = v, u, left[v, u]
                    break
            else:
                break
        if not holds(a, b, c, x, y):  # flat triangles can mislead the walk
            a, b, c = next(((u, v, w) for (u, v), w in left.items() if holds(u, v, w, x, y)), (a, b, c))
            if not holds(a, b, c, x, y):
                continue
        todo, gone, rim = [(a, b, c)], {(a, b), (b, c), (c, a)}, []
        while todo:
            a, b, c = todo.pop()
            for u, v in ((a, b), (b, c), (c, a)):
                if (v, u) in gone:
                    continue
                w = left.get((v, u))
                if w is not None and holds(v, u, w, x, y):
                    todo.append((v, u, w))
                    gone |= {(v, u), (u, w), (w, v)}
                else:
                    rim.append((u, v))
        for e in gone:
            del left[e]
        for u, v in rim:
            left[u, v], left[v, i], left[i, u] = i, u, v
        at = (*rim[0], i)
    return left


def delaunay(points: np.ndarray) -> set[tuple[int, int]]:
    """Edges of the Delaunay triangulation (insertion by circumcircles, found by a walk); all pairs if the points have no area or some coincide."""
    n = len(points)
    every = {(i, j) for i in range(n) for j in range(i + 1, n)}
    if n < 4 or len(np.unique(points, axis=0)) < n:
        return every
    p = points - points.mean(axis=0)
    p = p / max(np.abs(p).max(), 1e-12)
    if np.linalg.matrix_rank(p, tol=1e-9) < 2:
        return every
    triangles = _triangles([*map(tuple, p.tolist()), (0.0, 40.0), (-40.0, -40.0), (40.0, -40.0)])
    out = {(min(a, b), max(a, b)) for a, b in triangles if a < n and b < n}
    # a home on the rim of the helper triangle may have lost its neighbours: tie it to the nearest
    for i in set(range(n)) - {k for e in out for k in e}:
        j = min((k for k in range(n) if k != i), key=lambda k: float(((p[i] - p[k]) ** 2).sum()))
        out.add((min(i, j), max(i, j)))
    return out


def savings_cover(cost: np.ndarray, start: np.ndarray, load: np.ndarray, rating: float, hops: int) -> list[list[int]] | None:
    """A cover by joining paths at the best saving, then moving single homes while that helps; ``cost`` is inf where no line may run."""
    return sparse_cover(_neighbours(cost), start, load, rating, hops)


def _neighbours(cost: np.ndarray) -> list[dict[int, float]]:
    """For each home the cost of the lines to others."""
    return [{int(j): float(row[j]) for j in np.flatnonzero(np.isfinite(row)) if j != i} for i, row in enumerate(cost)]


def sparse_cover(near: list[dict[int, float]], start: np.ndarray, load: np.ndarray, rating: float, hops: int) -> list[list[int]] | None:
    """The same from the lines that may run; a home is only tried beside those that it has a line with, and again once one of their paths has changed."""
    if (load > rating).any() or np.isinf(start).any() or hops < 1:
        return None
    n, first, load = len(load), start.tolist(), load.tolist()
    paths = [[i] for i in range(n)]
    where, total = list(range(n)), list(load)
    gain = sorted(((first[j] - c, i, j) for i in range(n) for j, c in near[i].items() if first[j] > c), reverse=True)
    for _, i, j in gain:  # the path of j hangs on i: it starts at j, and i ends its own
        a, b = where[i], where[j]
        if a != b and paths[a][-1] == i and paths[b][0] == j and len(paths[a]) + len(paths[b]) <= hops and total[a] + total[b] <= rating:
            paths[a] += paths[b]
            total[a] += total[b]
            for k in paths[b]:
                where[k] = a
            paths[b], total[b] = [], 0.0
    empty = [b for b in range(n) if not paths[b]]  # in order, so a heap

    def step(x: int | None, y: int | None) -> float | None:
        """Cost of y's line from x, or from its site; None if it may not run."""
        return 0.0 if y is None else first[y] if x is None else near[x].get(y)

    changed, tried, now = [0] * n, [-1] * n, 0
    better = True
    while better:
        better = False
        for i in range(n):
            a = where[i]
            if max(changed[a], max((changed[where[k]] for k in near[i]), default=0)) <= tried[i]:
                continue
            tried[i] = now
            own = paths[a]
            k = own.index(i)
            x, y = own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None
            bridge = step(x, y)
            if bridge is None:
                continue  # without this home the path would use a line that may not run
            base = step(x, i) + step(i, y) - bridge
            rest = own[:k] + own[k + 1 :]
            places = set()
            for j in near[i]:
                b = where[j]
                other = rest if b == a else paths[b]
                if b == a or (len(other) < hops and total[b] + load[i] <= rating):
                    at = other.index(j)
                    places |= {(b, at), (b, at + 1)}
            if empty:
                places.add((empty[0], 0))
            best = (1e-9, None, 0)
            for b, at in sorted(places):
                other = rest if b == a else paths[b]
                x, y = other[at - 1] if at else None, other[at] if at < len(other) else None
                to, on, cut_ = step(x, i), step(i, y), step(x, y)
                if to is None or on is None or cut_ is None:
                    continue
                won = base - (to + on - cut_)
                if won > best[0]:
                    best = (won, b, at)
            if best[1] is not None:
                _, b, at = best
                if not paths[b]:
                    heapq.heappop(empty)
                if not rest:
                    heapq.heappush(empty, a)
                paths[a], total[a] = rest, total[a] - load[i]
                paths[b] = paths[b][:at] + [i] + paths[b][at:]
                total[b] += load[i]
                where[i] = b
                now += 1
                changed[a] = changed[b] = now
                better = True
    return [own for own in paths if own]


def tree_bound(cost: np.ndarray, start: np.ndarray) -> float:
    """Weight of the smallest tree over the homes and one common start: no cover is cheaper."""
    return sparse_bound(_neighbours(np.minimum(cost, cost.T)), start)


def sparse_bound(near: list[dict[int, float]], start: np.ndarray) -> float:
    """The same from the lines that may run, which go both ways."""
    heap, left, total = [(c, i) for i, c in enumerate(start.tolist())], set(range(len(start))), 0.0
    heapq.heapify(heap)
    while left:
        c, i = heapq.heappop(heap)
        if i not in left:
            continue
        if c == math.inf:
            return math.inf
        total += c
        left.remove(i)
        for j, d in near[i].items():
            if j in left:
                heapq.heappush(heap, (d, j))
    return total


def _distance(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Pairwise geodesic metres along the last axis."""
    return _metres(lon[..., :, None], lat[..., :, None], lon[..., None, :], lat[..., None, :])


def _metres(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Geodesic metres, by the same formula as the Column form."""
    f, a = geo.FLAT, geo.AXIS
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(y))) for y in (y1, y2))
    s1, s2, c1, c2 = np.sin(u1), np.sin(u2), np.cos(u1), np.cos(u2)
    span = np.radians(x2 - x1)
    lam = span
    for _ in range(geo.ROUNDS):
        ss = np.sqrt((c2 * np.sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * np.cos(lam)) ** 2)
        cs = s1 * s2 + c1 * c2 * np.cos(lam)
        sg = np.arctan2(ss, cs)
        sa = np.where(ss == 0, 0, c1 * c2 * np.sin(lam) / np.where(ss == 0, 1, ss))
        ca = 1 - sa * sa
        cm = np.where(ca == 0, 0, cs - 2 * s1 * s2 / np.where(ca == 0, 1, ca))
        cc = f / 16 * ca * (4 + f * (4 - 3 * ca))
        lam = span + (1 - cc) * f * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1)))
    b = a * (1 - f)
    uu = ca * (a * a - b * b) / (b * b)
    aa = 1 + uu / 16384 * (4096 + uu * (uu * (320 - 175 * uu) - 768))
    bb = uu / 1024 * (256 + uu * (uu * (74 - 47 * uu) - 128))
    ds = bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return b * aa * (sg - ds)


def _lines(lon: np.ndarray, lat: np.ndarray, side: np.ndarray, penalty: float) -> list[dict[int, float]]:
    """Cost of the lines along the triangulation, for each home."""
    pairs = np.array(sorted(delaunay(np.column_stack([lon, lat]))))
    a, b = pairs.T
    cost = _metres(lon[a], lat[a], lon[b], lat[b]) + penalty * np.abs(side[a] - side[b])
    near: list[dict[int, float]] = [{} for _ in lon]
    for i, j, c in zip(a.tolist(), b.tolist(), cost.tolist(), strict=True):
        near[i][j] = near[j][i] = c
    return near


COLUMNS = ["link", "hid", "prev", "path", "pos", "status", "cost", "bound"]
RESULT = "link long, hid long, prev long, path int, pos int, status string, cost double, bound double"


def _solve_links(homes: pd.DataFrame, args: Secondary) -> pd.DataFrame:
    """The lines of whole links; those of up to ``EXACT`` homes are solved many at once, by number of homes."""
    homes = homes.sort_values(["link", "hid"], ignore_index=True)
    link, ids = homes["link"].to_numpy(), homes["hid"].to_numpy()
    value = {c: homes[c].to_numpy(float) for c in ("lon", "lat", "load", "side")} | {"d0": homes["d0"].fillna(np.inf).to_numpy(float)}
    first = np.flatnonzero(np.append(True, link[1:] != link[:-1]))
    size = np.diff(np.append(first, len(link)))
    rows: list[tuple] = []
    for m in np.unique(size).tolist():
        same = first[size == m]
        for k in range(0, len(same), BATCH if m <= EXACT else 1):
            at = same[k : k + (BATCH if m <= EXACT else 1), None] + np.arange(m)
            lon, lat, load, side, start = (value[c][at] for c in ("lon", "lat", "load", "side", "d0"))
            if m <= EXACT:
                cost = _distance(lon, lat) + args.penalty * np.abs(side[:, :, None] - side[:, None, :])
                covers, status, near = exact_covers(cost, start, load, args.max_rating, args.max_hops), "exact", [_neighbours(c) for c in cost]
            else:
                near = [_lines(lon[0], lat[0], side[0], args.penalty)]
                covers, status = [sparse_cover(near[0], start[0], load[0], args.max_rating, args.max_hops)], "heuristic"
            for x, paths in enumerate(covers):
                own, name, c = ids[at[x]].tolist(), int(link[at[x, 0]]), near[x]
                if paths is None:
                    rows += [(name, h, None, None, None, "infeasible", None, None) for h in own]
                    continue
                total = float(sum(start[x, p[0]] + sum(c[a][b] for a, b in zip(p, p[1:], strict=False)) for p in paths))
                bound = sparse_bound(c, start[x])
                rows += [(name, own[i], own[p[k - 1]] if k else None, n, k, status, total, bound) for n, p in enumerate(paths) for k, i in enumerate(p)]
    return pd.DataFrame(rows, columns=COLUMNS, dtype=object)


def design(sides: DataFrame, lines: DataFrame, args: Secondary, by: list[str] | None = None) -> DataFrame:
    """(by, u, v, key, hid, prev, t, path, pos, status, cost, bound): the line that serves each home.

    ``prev`` is the home before it on its path (null: served by site ``t`` itself); a link without a cover has
    status ``infeasible`` and no lines.  Links of one home need no solver.  Others are sent in buckets of many
    links, a link never split; a bucket's size is bounded by the links that hash to it.
    """
    keys = [*(by or []), "u", "v", "key"]
    best = lines.groupBy(*keys, "hid").agg(F.min(F.struct("cost", "t")).alias("b")).select(*keys, "hid", F.col("b.cost").alias("d0"), F.col("b.t").alias("t"))
    homes = sides.join(best, [*keys, "hid"], "left").withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    fine = (F.col("load") <= args.max_rating) & F.col("d0").isNotNull() & (F.lit(args.max_hops) >= 1)
    lone = homes.where("n = 1").select(
        *keys, "hid", F.lit(None).cast("long").alias("prev"), F.when(fine, F.col("t")).alias("t"), F.when(fine, 0).alias("path"), F.when(fine, 0).alias("pos"),
        F.when(fine, "exact").otherwise("infeasible").alias("status"), F.when(fine, F.col("d0")).alias("cost"), F.when(fine, F.col("d0")).alias("bound"),
    )
    link = F.xxhash64(*keys)
    many = homes.where("n > 1").withColumn("link", link)

    def solve(frames):
        left = None
        for f in frames:
            f = f if left is None else pd.concat([left, f], ignore_index=True)
            last = f["link"].iloc[-1]
            left = f[f["link"] == last]
            f = f[f["link"] != last]
            if len(f):
                yield _solve_links(f, args)
        if left is not None and len(left):
            yield _solve_links(left, args)

    sent = many.select("link", "hid", "lon", "lat", "load", "side", "d0").repartition(parallelism(sides), "link").sortWithinPartitions("link", "hid")
    got = sent.mapInPandas(solve, RESULT)
    solved = many.select("link", *keys, "hid", "t").join(got, ["link", "hid"]).select(
        *keys, "hid", "prev", F.when(F.col("prev").isNull() & (F.col("status") != "infeasible"), F.col("t")).alias("t"), "path", "pos", "status", "cost", "bound"
    )
    return lone.unionByName(solved)


def failures(design_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Links without a cover, with their number of homes."""
    return design_rows.where("status = 'infeasible'").groupBy(*(by or []), "u", "v", "key").agg(F.count("*").alias("homes"))


def number_transformers(chosen: DataFrame, base: int, by: list[str] | None = None) -> DataFrame:
    """(by, u, v, key, t, transformer_id): ``T<base + n>``, n counting the used sites in order of (by, u, v, key, t).

    Ranks come from a range sort with offsets per partition, not from one task: each partition numbers its own
    rows and a small table of counts shifts them.
    """
    keys = [*(by or []), "u", "v", "key", "t"]
    part = chosen.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, F.spark_partition_id().alias("p"))
    part = cut(part.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(*keys))))
    count = part.groupBy("p").agg(F.count("*").alias("c"))
    start = count.withColumn("s", F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))).select("p", F.coalesce("s", F.lit(0)).alias("s"))
    return part.join(F.broadcast(start), "p").select(*keys, F.concat(F.lit("T"), (F.lit(base) + F.col("s") + F.col("r") - 1).cast("string")).alias("transformer_id"))


def assemble(rows: DataFrame, sides: DataFrame, points: DataFrame, base: int, by: list[str] | None = None) -> dict[str, DataFrame]:
    """Transformers with their total load, secondary edges, and the ordered node sequence of each link.

    Edges: from the transformer or the home before, to the home, with the geodesic length.  Sequence: start node,
    used transformers in order along the road, end node.
    """
    keys = [*(by or []), "u", "v", "key"]
    served = rows.where("status != 'infeasible'")
    root = served.where("pos = 0").select(*keys, "path", F.col("t").alias("site"))
    homes = served.join(root, [*keys, "path"]).join(sides.select(*keys, "hid", "lon", "lat", "load"), [*keys, "hid"])
    names = number_transformers(homes.select(*keys, F.col("site").alias("t")), base, by)
    homes = homes.join(names.withColumnRenamed("t", "site"), [*keys, "site"])
    spots = points.select(*keys, F.col("t").alias("site"), "tx", "ty")
    load = homes.groupBy(*keys, "site", "transformer_id").agg(F.sum("load").alias("load"))
    transformers = load.join(spots, [*keys, "site"]).select(*keys, "transformer_id", F.col("tx").alias("lon"), F.col("ty").alias("lat"), "load", "site")
    before = sides.select(*keys, F.col("hid").alias("prev"), F.col("lon").alias("px"), F.col("lat").alias("py"))
    line = homes.join(before, [*keys, "prev"], "left").join(spots, [*keys, "site"])
    line = line.withColumn("fx", F.coalesce("px", "tx")).withColumn("fy", F.coalesce("py", "ty"))
    line = geo.with_geodesic(line, "fx", "fy", "lon", "lat", "length")
    secondary = line.select(*keys, F.coalesce(F.col("prev").cast("string"), "transformer_id").alias("from_node"), F.col("hid").cast("string").alias("to_node"), "length")
    used = transformers.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("site", "transformer_id"))).alias("s"))
    seq = used.select(*keys, F.concat(F.array(F.col("u").cast("string")), F.transform("s", lambda x: x.transformer_id), F.array(F.col("v").cast("string"))).alias("seq"))
    return {"transformers": transformers.drop("site"), "secondary": secondary, "sequences": seq}


def build(mapping: DataFrame, homes: DataFrame, edges: DataFrame, args: Secondary, base: int, by: list[str] | None = None, most_homes: int | None = None) -> dict[str, DataFrame]:
    """The whole secondary stage; also ``design`` (the raw choice) and ``failures``.

    With ``most_homes`` that of the links of up to so many homes; a link's lines do not depend on other links.
    """
    by = by or []
    linked = homes_by_edge(mapping, homes, by)
    if most_homes is not None:
        linked = linked.where(F.size("homes") <= most_homes)
    own = edges.join(linked.select(*by, "u", "v", "key"), [*by, "u", "v", "key"], "left_semi")
    sides = cut(home_sides(linked, own, by))
    points = cut(sites(own, args.separation, by))
    lines = site_homes(sides, points, args.penalty, args.nearest_homes, by)
    rows = cut(design(sides, lines, args, by))
    return assemble(rows, sides, points, base, by) | {"design": rows, "failures": failures(rows, by), "sides": sides, "sites": points}
