"""Registered queries of the network operators and the SQL that checks them.

Both engines read the derived inputs of ``sources.fixtures`` from the driver tables.  Doubles are
rounded on both sides: metres to two or three decimals, degrees to seven or eight, loads (multiples of
1/2400) to six, where no value lies halfway.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Secondary
from ..functions import geo
from ..functions.hull import bounding_box
from ..functions.lineage import cut
from ..operators import final, graph, mapping, partition, secondary
from ..sources import fixtures, readers, writers
from . import network

#: The fixture's grid is small: cells keep their substation from 26 nodes on.
CONFIG = Config(min_cell_nodes=25)
BY = ["region"]
PAD = CONFIG.miscellaneous.padding
SEC: Secondary = CONFIG.secnet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- SQL of the derived inputs -------------------------------------------------------------------

_HOURS = [f"hour{i}" for i in range(1, 25)]
_HOMES = f"select hid, region, longitude as lon, latitude as lat, greatest({', '.join(_HOURS)}) as peak, ({' + '.join(_HOURS)}) / 24e0 as load from ({fixtures.HOMES_SQL})"
_DIRECTED = fixtures.EDGES_SQL
#: One row for both directions, u < v; the later row wins.
_ROADS = f"select least(u, v) as u, greatest(u, v) as v, key, max_by(length, seq) as length, max_by(highway, seq) as highway, max_by(bare, seq) as bare, max(bent) as bent, {', '.join(f'max_by(case when u < v then {a} else {b} end, seq) as {a}' for a, b in (('ux', 'vx'), ('uy', 'vy'), ('vx', 'ux'), ('vy', 'uy')))} from ({_DIRECTED}) group by 1, 2, 3"
#: Vertices of each road, pos from 0; bent roads have a middle one unless their row lacks geometry.
_VERTICES = f"""
select u, v, key, 0 as pos, ux as x, uy as y from ({_ROADS}) union all
select u, v, key, 1, (ux + vx) / 2e0 + 0.0003e0, (uy + vy) / 2e0 + 0.0002e0 from ({_ROADS}) where bent = 1 and bare = 0 union all
select u, v, key, 2, vx, vy from ({_ROADS})
"""


def _undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.roads(spark, sf_dir)[1]


# -- sources -------------------------------------------------------------------------------------


@query(f"select hid, region, round(peak, 3) as peak, round(load, 6) as load from ({_HOMES})")
def home_peak_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.homes(spark, sf_dir).select("hid", F.col("nation").alias("region"), F.round("peak", 3).alias("peak"), F.round("load", 6).alias("load"))


@query(f"select hid, longitude, latitude, {', '.join(_HOURS)} from ({fixtures.HOMES_SQL})")
def home_profile_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.home_columns(spark, sf_dir).select("hid", "longitude", "latitude", *_HOURS)


@query(f"""
with a as (select s.sub_id, s.lon, s.lat, atan2(h.lat - s.lat, h.lon - s.lon) as t from ({fixtures.SUBSTATIONS_SQL}) s cross join (select distinct lon, lat from ({_HOMES})) h where h.lon != s.lon or h.lat != s.lat),
g as (select sub_id, lon, lat, t - lag(t) over (partition by sub_id order by t) as gap, min(t) over (partition by sub_id) + 2e0 * pi() - max(t) over (partition by sub_id) as wrap from a)
select sub_id, round(lon, 8) as lon, round(lat, 8) as lat from g group by sub_id, lon, lat having greatest(max(gap), max(wrap)) < pi() - 1e-9
""")
def substations_in_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = readers.substations_inside(fixtures.substations(spark, sf_dir), fixtures.homes(spark, sf_dir))
    return inside.select("sub_id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query(f"select round(min(lon) - 0.01e0, 8) as lon_min, round(min(lat) - 0.01e0, 8) as lat_min, round(max(lon) + 0.01e0, 8) as lon_max, round(max(lat) + 0.01e0, 8) as lat_max, count(*) as points from ({_HOMES})")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The homes' box with the usual buffer, within which roads are looked for."""
    b = bounding_box(fixtures.homes(spark, sf_dir))
    return b.select(*(F.round(c, 8).alias(c) for c in b.columns[:4]), "points")


@query(f"select u, v, key, round(length, 3) as length, highway, case when bent = 1 and bare = 0 then 3 else 2 end as points, round(ux, 8) as x0, round(uy, 8) as y0 from ({_ROADS})")
def road_undirected_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _undirected(spark, sf_dir)
    return e.select("u", "v", "key", F.round("length", 3).alias("length"), "highway", F.size("coords").alias("points"), F.round(F.col("coords")[0].x, 8).alias("x0"), F.round(F.col("coords")[0].y, 8).alias("y0"))


@query(f"select u, v, key, case when bent = 1 and bare = 0 then 3 else 2 end as points, round(ux + vx + case when bent = 1 and bare = 0 then (ux + vx) / 2e0 + 0.0003e0 else 0e0 end, 6) as sum_x from ({_DIRECTED})")
def road_fill_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readers.fill_geometry(fixtures.raw_edges(spark, sf_dir), fixtures.road_nodes(spark, sf_dir))
    return e.select("u", "v", "key", F.size("coords").alias("points"), F.round(F.aggregate("coords", F.lit(0.0), lambda a, p: a + p.x), 6).alias("sum_x"))


@query(f"""
select u, v, key, round(sum(m), 3) as metres from ({geo.geodesic_sql(
    f"select u, v, key, x, y, lead(x) over (partition by u, v, key order by pos) as x2, lead(y) over (partition by u, v, key order by pos) as y2 from ({_VERTICES})", "x", "y", "x2", "y2", "m")})
where x2 is not null group by u, v, key
""")
def edge_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.with_length(_undirected(spark, sf_dir), ["u", "v", "key"], name="metres").withColumn("metres", F.round("metres", 3))


@query(f"select u, v, key, count(*) as points, round(sum(x), 6) as sum_x, round(sum(y), 6) as sum_y from ({_VERTICES}) group by u, v, key")
def wkt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _undirected(spark, sf_dir).withColumn("coords", geo.from_wkt(geo.to_wkt(F.col("coords"))))
    total = lambda c: F.round(F.aggregate("coords", F.lit(0.0), lambda a, p: a + p[c]), 6)
    return e.select("u", "v", "key", F.size("coords").cast("long").alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


# -- mapping -------------------------------------------------------------------------------------


def _near_sql(pad: float) -> str:
    reach = f"{2 * pad!r}e0"
    box = f"select u, v, key, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2 from ({_VERTICES}) group by u, v, key"
    pair = f"select h.hid, h.lon, h.lat, b.u, b.v, b.key, p.x, p.y from ({_HOMES}) h join ({box}) b on h.lon >= b.x1 - {reach} and h.lon <= b.x2 + {reach} and h.lat >= b.y1 - {reach} and h.lat <= b.y2 + {reach} join ({_VERTICES}) p on p.u = b.u and p.v = b.v and p.key = b.key"
    return f"select hid, u, v, key, d from (select hid, u, v, key, d, row_number() over (partition by hid order by d, u, v, key) as r from (select hid, u, v, key, min(m) as d from ({geo.geodesic_sql(pair, 'lon', 'lat', 'x', 'y', 'm')}) group by hid, u, v, key)) where r = 1"


@query(f"select hid, u, v, key, round(d, 3) as dist_m from ({_near_sql(PAD)})")
def home_nearest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = mapping.nearest_edges(fixtures.homes(spark, sf_dir), _undirected(spark, sf_dir), PAD)
    return n.withColumn("dist_m", F.round("dist_m", 3))


# the second run takes in all homes that the first one leaves, and so on
_RETRY = f"""
with l0 as ({_near_sql(PAD)}), l1 as ({_near_sql(PAD * 10)}), l2 as ({_near_sql(PAD * 100)}), l3 as ({_near_sql(PAD * 1000)}),
every as (select *, 0 as pad_level from l0 union all select *, 1 from l1 union all select *, 2 from l2 union all select *, 3 from l3)
select hid, u, v, key, round(d, 3) as dist_m, pad_level from (select *, row_number() over (partition by hid order by pad_level) as r from every) where r = 1
"""
_MAPPED = f"select hid, u, v, key from ({_RETRY.replace('every as (', 'every0 as (').replace('from every)', 'from every0)')})"


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    h, e = fixtures.homes(spark, sf_dir), _undirected(spark, sf_dir)
    return h, e, mapping.map_homes(h, e, PAD, BY)


@query(_RETRY)
def home_edge_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)[2].select("hid", "u", "v", "key", F.round("dist_m", 3).alias("dist_m"), "pad_level")


@query(f"select h.hid from ({_HOMES}) h where h.hid not in (select hid from ({_near_sql(PAD)}))")
def unmapped_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, e = fixtures.homes(spark, sf_dir), _undirected(spark, sf_dir)
    return mapping.unmapped(h, mapping.nearest_edges(h, e, PAD)).select("hid")


@query(f"select u, v, key, count(*) as homes, string_agg(cast(hid as varchar), ',' order by hid) as ids from ({_MAPPED}) group by u, v, key")
def edge_to_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, _, m = _mapped(spark, sf_dir)
    return mapping.homes_by_edge(m, h, BY).select("u", "v", "key", F.size("homes").cast("long").alias("homes"), F.array_join(F.transform("homes", lambda x: x.hid.cast("string")), ",").alias("ids"))


@query(f"select 'Home(id=' || m.hid || ', lon=' || h.lon || ', lat=' || h.lat || ') -> Edge(' || m.u || ', ' || m.v || ', ' || m.key || ')' as line from ({_MAPPED}) m join ({_HOMES}) h on h.hid = m.hid")
def mapping_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole line of every mapped home."""
    h, _, m = _mapped(spark, sf_dir)
    return writers.mapping_lines(m, h).select(F.col("value").alias("line"))


# -- candidate networks --------------------------------------------------------------------------

_SEGMENTS = geo.geodesic_sql(f"select u, v, key, pos, x, y, lead(x) over (partition by u, v, key order by pos) as x2, lead(y) over (partition by u, v, key order by pos) as y2 from ({_VERTICES})", "x", "y", "x2", "y2", "m")
#: Points every 50 m: position by planar share, count by geodesic length.
_SITES = f"""
select u, v, key, i, x + t * (x2 - x) as px, y + t * (y2 - y) as py from (
  select u, v, key, i, x, y, x2, y2, before, d, (want - before) / d as t, row_number() over (partition by u, v, key, i order by pos) as r from (
    select s.*, k.i, k.i * {SEC.separation!r}e0 / s.total * s.planar as want from (
      select u, v, key, pos, x, y, x2, y2, d, sum(d) over (partition by u, v, key order by pos) - d as before, sum(m) over (partition by u, v, key) as total, sum(d) over (partition by u, v, key) as planar
      from (select *, sqrt(power(x2 - x, 2e0) + power(y2 - y, 2e0)) as d from ({_SEGMENTS}) where x2 is not null)
    ) s join (select unnest(range(0, 400)) as i) k on k.i * {SEC.separation!r}e0 < s.total
  ) where want <= before + d + 1e-15
) where r = 1
"""


@query(f"select u, v, key, i, round(px, 7) as x, round(py, 7) as y from ({_SITES})")
def interpolate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geo.interpolate(_undirected(spark, sf_dir), ["u", "v", "key"], SEC.separation)
    return p.select("u", "v", "key", F.col("i").cast("long").alias("i"), F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


#: Shoelace of the road's points and the home, relative to the first point.
_SIDES = f"""
select m.hid, m.u, m.v, m.key, h.lon, h.lat, h.load, case when sum(s.cross) + max(s.lx - s.fx) * 0 + ((max(s.lx) - max(s.fx)) * (h.lat - max(s.fy)) - (h.lon - max(s.fx)) * (max(s.ly) - max(s.fy))) > 0 then 1 else -1 end as side
from ({_MAPPED}) m join ({_HOMES}) h on h.hid = m.hid join (
  select u, v, key, fx, fy, lx, ly, case when x2 is null then 0e0 else (x - fx) * (y2 - fy) - (x2 - fx) * (y - fy) end as cross from (
    select u, v, key, x, y, lead(x) over w as x2, lead(y) over w as y2, first_value(x) over w as fx, first_value(y) over w as fy,
      last_value(x) over (partition by u, v, key order by pos rows between unbounded preceding and unbounded following) as lx, last_value(y) over (partition by u, v, key order by pos rows between unbounded preceding and unbounded following) as ly
    from ({_VERTICES}) window w as (partition by u, v, key order by pos))
) s on s.u = m.u and s.v = m.v and s.key = m.key group by m.hid, m.u, m.v, m.key, h.lon, h.lat, h.load
"""


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(home sides, sites) of all links with homes."""
    h, e, m = _mapped(spark, sf_dir)
    linked = mapping.homes_by_edge(m, h, BY)
    own = e.join(linked.select(*BY, "u", "v", "key"), [*BY, "u", "v", "key"], "left_semi")
    return secondary.home_sides(linked, own, BY), secondary.sites(own, SEC.separation, BY)


@query(f"select hid, u, v, key, side from ({_SIDES})")
def side_of_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)[0].select("hid", "u", "v", "key", "side")


_PAIRS = geo.geodesic_sql(f"with s as (select *, count(*) over (partition by u, v, key) as n from ({_SIDES}) qualify n <= {secondary.EXACT}) select a.u, a.v, a.key, a.hid as a, b.hid as b, a.lon as ax, a.lat as ay, b.lon as bx, b.lat as by_, abs(a.side - b.side) as crossing from s a join s b on a.u = b.u and a.v = b.v and a.key = b.key and a.hid < b.hid", "ax", "ay", "bx", "by_", "length")


@query(f"select u, v, key, a, b, crossing, round(length, 3) as length, round(length + {SEC.penalty!r}e0 * crossing, 3) as cost from ({_PAIRS})")
def candidate_home_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = secondary.home_pairs(_candidates(spark, sf_dir)[0], SEC.penalty, BY)
    return p.select("u", "v", "key", "a", "b", "crossing", F.round("length", 3).alias("length"), F.round("cost", 3).alias("cost"))


_LINES = geo.geodesic_sql(f"select s.hid, s.u, s.v, s.key, s.lon, s.lat, t.i as t, t.px, t.py from ({_SIDES}) s join ({_SITES}) t on s.u = t.u and s.v = t.v and s.key = t.key", "lon", "lat", "px", "py", "length")


@query(f"select u, v, key, t, hid, round(length, 3) as length, round(length + {SEC.penalty!r}e0, 3) as cost from ({_LINES})")
def transformer_home_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides, points = _candidates(spark, sf_dir)
    e = secondary.site_homes(sides, points, SEC.penalty, None, BY)
    return e.select("u", "v", "key", F.col("t").cast("long").alias("t"), "hid", F.round("length", 3).alias("length"), F.round("cost", 3).alias("cost"))


@query(f"select u, v, key, t, hid, round(length, 3) as length from (select *, row_number() over (partition by u, v, key, t order by length, hid) as r from ({_LINES})) where r <= 2")
def k_nearest_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides, points = _candidates(spark, sf_dir)
    e = secondary.site_homes(sides, points, SEC.penalty, 2, BY)
    return e.select("u", "v", "key", F.col("t").cast("long").alias("t"), "hid", F.round("length", 3).alias("length"))


# -- secondary network ---------------------------------------------------------------------------


def _stages(spark: SparkSession, sf_dir: str, upto: str, tables: tuple[str, ...] = network.SECONDARY, most_homes: int | None = None) -> dict:
    """Tables of the stages up to a name: mapping, secondary, network, partition, primary.

    Queries that end with the secondary stage may name its ``tables``, and ``most_homes`` if they are about links of up to so many homes.
    """
    h = cut(fixtures.homes(spark, sf_dir))  # every stage reads these
    nodes, edges = (cut(df) for df in fixtures.roads(spark, sf_dir))
    subs = cut(readers.substations_inside(fixtures.substations(spark, sf_dir), h)) if upto not in ("secondary", "network") else None
    x, store = network.Inputs(h, subs, nodes, edges), network.Store(spark)
    out: dict = {"inputs": x, "mapping": network.map_stage(x, CONFIG, store)}
    out |= network.secondary_stage(x, out["mapping"], CONFIG, store, tables, most_homes)
    if upto == "secondary":
        return out
    out["nodes"], out["edges"] = network.network_stage(x, out, store)
    if upto == "network":
        return out
    out["part_nodes"], out["part_edges"] = network.partition_stage(x, out["nodes"], out["edges"], CONFIG, store)
    if upto == "partition":
        return out
    out |= {f"primary_{k}": v for k, v in network.primary_stage(x, out["part_nodes"], out["part_edges"], CONFIG, store).items()}
    return out


@query(f"select u, v, key, count(*) as homes, count(*) as edges, true as hops_ok, true as rating_ok, true as degree_ok from ({_MAPPED}) group by u, v, key")
def secnet_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per link: as many lines as homes, and the rules of hops, rating and degree hold."""
    s = _stages(spark, sf_dir, "secondary")
    d = s["design"].join(s["inputs"].homes.select("hid", "load"), "hid")
    path = d.groupBy("u", "v", "key", "path").agg(F.count("*").alias("n"), F.sum("load").alias("p"), F.count_distinct("pos").alias("k"))
    ok = path.groupBy("u", "v", "key").agg(
        F.sum("n").alias("homes"), (F.max("n") <= SEC.max_hops).alias("hops_ok"), (F.max("p") <= SEC.max_rating).alias("rating_ok"), F.every(F.col("k") == F.col("n")).alias("degree_ok")
    )
    lines = s["secondary"].groupBy("u", "v", "key").agg(F.count("*").alias("edges"))
    return ok.join(lines, ["u", "v", "key"]).select("u", "v", "key", "homes", "edges", "hops_ok", "rating_ok", "degree_ok")


@query(f"select m.u, m.v, m.key, round(sum(h.load), 6) as load from ({_MAPPED}) m join ({_HOMES}) h on h.hid = m.hid group by m.u, m.v, m.key")
def transformer_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load of the transformers of each link: that of its homes."""
    t = _stages(spark, sf_dir, "secondary", ("transformers",))["transformers"]
    return t.groupBy("u", "v", "key").agg(F.round(F.sum("load"), 6).alias("load"))


@query(f"select hid, round(cost, 2) as cost from (select hid, u, v, key, min(length) + {SEC.penalty!r}e0 as cost, count(*) over (partition by u, v, key) as n from ({_LINES}) group by hid, u, v, key) where n = 1")
def lone_home_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of one home: the cheapest line is the optimum."""
    d = _stages(spark, sf_dir, "secondary", ("design",), 1)["design"]
    lone = d.groupBy("u", "v", "key").agg(F.count("*").alias("n")).where("n = 1")
    return d.join(lone, ["u", "v", "key"], "left_semi").select("hid", F.round("cost", 2).alias("cost"))


_FIRST = f"select u, v, key, hid, min(length) + {SEC.penalty!r}e0 as c from ({_LINES}) group by u, v, key, hid"
_COSTS = f"select u, v, key, a, b, length + {SEC.penalty!r}e0 * crossing as p from ({_PAIRS})"


@query(f"""
with f as (select *, count(*) over (partition by u, v, key) as n, row_number() over (partition by u, v, key order by hid) as r from ({_FIRST})), p as ({_COSTS}),
w as (select x.u, x.v, x.key, x.n, x.c as a, y.c as b, z.c as c, p.p as ab, q.p as ac, o.p as bc from f x
  left join f y on y.u = x.u and y.v = x.v and y.key = x.key and y.r = 2 left join f z on z.u = x.u and z.v = x.v and z.key = x.key and z.r = 3
  left join p on p.u = x.u and p.v = x.v and p.key = x.key and p.a = x.hid and p.b = y.hid
  left join p q on q.u = x.u and q.v = x.v and q.key = x.key and q.a = x.hid and q.b = z.hid
  left join p o on o.u = x.u and o.v = x.v and o.key = x.key and o.a = y.hid and o.b = z.hid where x.r = 1 and x.n <= 3)
select u, v, key, n as homes, round(case n when 1 then a when 2 then least(a + b, least(a, b) + ab) else
  least(a + b + c, least(a, b) + ab + c, least(a, c) + ac + b, least(b, c) + bc + a, ab + bc + least(a, c), ab + ac + least(b, c), ac + bc + least(a, b)) end, 2) as cost from w
""")
def small_link_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of the lines of every link of one to three homes; the SQL takes the cheapest of all covers by paths."""
    d = _stages(spark, sf_dir, "secondary", ("design",), 3)["design"]
    return d.groupBy("u", "v", "key").agg(F.count("*").alias("homes"), F.round(F.max("cost"), 2).alias("cost")).where("homes <= 3")


@query(f"select u, v, key, t, 'T' || cast(51999000000000000 + row_number() over (order by u, v, key, t) - 1 as varchar) as transformer_id from (select u, v, key, i as t from ({_SITES}))")
def transformer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = secondary.sites(_undirected(spark, sf_dir), SEC.separation)
    ids = secondary.number_transformers(points, 51999000000000000)
    return ids.select("u", "v", "key", F.col("t").cast("long").alias("t"), "transformer_id")


#: Every site of every road in order, between its ends: a sequence that needs no solver.
_SEQ = f"""
select u, v, key, cast(u as varchar) as node, -1 as pos from ({_ROADS}) union all select u, v, key, cast(v as varchar), 100000 from ({_ROADS}) union all
select u, v, key, 'T' || u || '_' || v || '_' || i, i from ({_SITES})
"""


def _sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sequences, sites with ids) of all roads."""
    e = _undirected(spark, sf_dir)
    points = secondary.sites(e, SEC.separation, BY).withColumn("transformer_id", F.concat(F.lit("T"), "u", F.lit("_"), "v", F.lit("_"), "t"))
    mid = points.groupBy(*BY, "u", "v", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "transformer_id"))), lambda x: x.transformer_id).alias("m"))
    seq = e.select(*BY, "u", "v", "key").join(mid, [*BY, "u", "v", "key"], "left").select(
        *BY, F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "key", F.concat(F.array(F.col("u").cast("string")), F.coalesce("m", F.array().cast("array<string>")), F.array(F.col("v").cast("string"))).alias("seq")
    )
    return seq, points


@query(f"select node as a, b from (select node, lead(node) over (partition by u, v, key order by pos) as b from ({_SEQ})) where b is not null")
def road_sequence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, _ = _sequences(spark, sf_dir)
    return seq.select(F.explode(graph.pairs("seq")).alias("p")).select(F.col("p.u").alias("a"), F.col("p.v").alias("b"))


_PLACE = f"select cast(node_id as varchar) as node, x, y from ({fixtures.NODES_SQL}) union all select 'T' || u || '_' || v || '_' || i, px, py from ({_SITES})"
_CHAIN = f"select s.highway, s.a, s.b, p.x as ax, p.y as ay, q.x as bx, q.y as by_ from (select r.highway, q.node as a, q.b from (select u, v, key, node, lead(node) over (partition by u, v, key order by pos) as b from ({_SEQ})) q join ({_ROADS}) r on r.u = q.u and r.v = q.v and r.key = q.key where q.b is not null) s join ({_PLACE}) p on p.node = s.a join ({_PLACE}) q on q.node = s.b"


@query(f"select a, b, highway, round(m, 3) as length from ({geo.geodesic_sql(_CHAIN, 'ax', 'ay', 'bx', 'by_', 'm')})")
def splice_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every road replaced by the chain of its sites."""
    nodes, edges = fixtures.roads(spark, sf_dir)
    seq, points = _sequences(spark, sf_dir)
    t = points.select(*BY, "transformer_id", F.col("tx").alias("lon"), F.col("ty").alias("lat"), F.lit(1.0).alias("load"))
    text = lambda c: F.col(c).cast("string").alias(c)
    _, spliced = graph.splice(nodes.select(*BY, text("node_id"), F.col("x").alias("lon"), F.col("y").alias("lat")), edges.select(*BY, text("u"), text("v"), "key", "highway", "length", "coords"), t, seq, BY)
    return spliced.select(F.col("u").alias("a"), F.col("v").alias("b"), "highway", F.round("length", 3).alias("length"))


# -- graph ---------------------------------------------------------------------------------------

#: Blocks of ten by ten road nodes, cut apart.
_BLOCKS = f"select u, v, key, length from ({_ROADS}) where not (v = u + 1 and u % 10 = 9) and not (v = u + 40 and floor(u / 40e0) % 10 = 9)"


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = fixtures.roads(spark, sf_dir)
    cut_off = ((F.col("v") == F.col("u") + 1) & (F.col("u") % 10 == 9)) | ((F.col("v") == F.col("u") + 40) & (F.floor(F.col("u") / 40) % 10 == 9))
    return nodes, edges.where(~cut_off)


@query(f"""
with recursive e as (select u as a, v as b from ({_BLOCKS}) union all select v, u from ({_BLOCKS})),
reach(node, root) as (select node_id, node_id from ({fixtures.NODES_SQL}) where node_id % 10 = 0 and floor(node_id / 40e0) % 10 = 0 union select e.b, reach.root from reach join e on e.a = reach.node)
select node as node_id, min(root) as component from reach group by node
""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _blocks(spark, sf_dir)
    return graph.components(nodes, edges, BY).select("node_id", "component")


_LABELLED = f"select node_id, floor(node_id / 40e0 / 10e0) * 4 + floor((node_id % 40) / 10e0) as block, x, y, case when node_id % 40 in (4, 15, 27) then 'T' else 'R' end as label from ({fixtures.NODES_SQL})"


@query(f"""
with b as (select *, count(*) over (partition by block) as n, max(case when label = 'T' then 1 else 0 end) over (partition by block) as t, min(cast(node_id as varchar)) over (partition by block) as c from ({_LABELLED})),
k as (select * from b where t = 1), r as (select *, dense_rank() over (order by n desc, c) as rank from k),
p as ({geo.geodesic_sql("select a.node_id as u, b.node_id as v, b.block, a.x as ux, a.y as uy, b.x as vx, b.y as vy from r a join r b on a.rank = 1 and b.rank > 1 and a.label = 'R' and b.label = 'R'", "ux", "uy", "vx", "vy", "m")})
select cast(u as varchar) as u, cast(v as varchar) as v, round(m, 3) as length from (select *, row_number() over (partition by block order by m, cast(u as varchar), cast(v as varchar)) as o from p) where o = 1
""")
def connect_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of roads, most of them with transformers: the ties that make them one network."""
    nodes, edges = _blocks(spark, sf_dir)
    text = lambda c: F.col(c).cast("string").alias(c)
    label = F.when((F.col("node_id") % 40).isin(4, 15, 27), "T").otherwise("R")
    n = nodes.select(*BY, text("node_id"), F.col("x").alias("lon"), F.col("y").alias("lat"), F.lit(0.0).alias("load"), label.alias("label"))
    e = edges.select(*BY, text("u"), text("v"), "key", "highway", "length", "coords")
    _, joined = graph.join_components(n, e, BY)
    return joined.join(e, ["u", "v", "key"], "left_anti").select("u", "v", F.round("length", 3).alias("length"))


def _snapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    h = fixtures.homes(spark, sf_dir)
    nodes, edges = fixtures.roads(spark, sf_dir)
    subs = readers.substations_inside(fixtures.substations(spark, sf_dir), h)
    n = nodes.select(*BY, F.col("node_id"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    return partition.snap(subs, n, PAD, BY), n, edges


_INSIDE = ORACLE_SQL["substations_in_hull"]


def _snap_sql(radius: float) -> str:
    r = f"{radius!r}e0"
    near = f"select s.sub_id, n.node_id, sqrt(power(n.x - s.lon, 2e0) + power(n.y - s.lat, 2e0)) as d from ({fixtures.SUBSTATIONS_SQL}) s join ({fixtures.NODES_SQL}) n on abs(n.x - s.lon) <= {r} and abs(n.y - s.lat) <= {r} where s.sub_id in (select sub_id from ({_INSIDE}))"
    return f"select sub_id, node_id from (select *, row_number() over (partition by sub_id order by d, node_id) as r from ({near})) where r = 1"


_SNAPPED = f"""
with s0 as ({_snap_sql(PAD)}), s1 as ({_snap_sql(PAD * 10)}), s2 as ({_snap_sql(PAD * 100)}), n as (select count(*) as n from ({_INSIDE}))
select * from s0 where (select count(*) from s0) = (select n from n) union all
select * from s1 where (select count(*) from s0) < (select n from n) and (select count(*) from s1) = (select n from n) union all
select * from s2 where (select count(*) from s1) < (select n from n)
"""


@query(f"select sub_id, node_id from ({_SNAPPED})")
def substation_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapped(spark, sf_dir)[0].select("sub_id", "node_id")


def _voronoi_sql(seeds: str) -> str:
    return f"""
select node, dist, ctr from (with recursive e as (select u as a, v as b, length as w from ({_ROADS}) union all select v, u, length from ({_ROADS})),
s(node, dist, ctr) using key (node) as (
  select node_id, 0e0, node_id from ({seeds}) union
  select x.b, x.d, x.ctr from (select e.b, min(s.dist + e.w) as d, arg_min(s.ctr, s.dist + e.w) as ctr from s join e on e.a = s.node group by e.b) x
  where not exists (select 1 from recurring.s r where r.node = x.b and r.dist <= x.d + 1e-9)
) select * from s)
"""


@query(f"select node as node_id, ctr as centre, round(dist, 3) as dist from ({_voronoi_sql(f'select distinct node_id from ({_SNAPPED})')})")
def voronoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network distance of every road node to its nearest substation's node, over all substations."""
    centres, _, edges = _snapped(spark, sf_dir)
    text = lambda c: F.col(c).cast("string").alias(c)
    v = graph.voronoi(edges.select(*BY, text("u"), text("v"), "length"), centres.select(*BY, text("node_id")), BY)
    return v.select(F.col("node_id").cast("long").alias("node_id"), F.col("centre").cast("long").alias("centre"), F.round("dist", 3).alias("dist"))


_CELLS = ORACLE_SQL["voronoi_cells"]


@query(f"select c.centre, r.u, r.v, r.key from ({_ROADS}) r join ({_CELLS}) c on c.node_id = r.u join ({_CELLS}) d on d.node_id = r.v where c.centre = d.centre")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads whose two ends are in one cell."""
    cells = voronoi_cells(spark, sf_dir).select("node_id", F.col("centre").alias("sub_id"))
    return graph.induced(_undirected(spark, sf_dir).select("u", "v", "key"), cells).select(F.col("sub_id").alias("centre"), "u", "v", "key")


@query(f"select u, v, key, max_by(highway, seq) as highway, count(*) as rows from (select u, v, key, 1 as seq, highway from ({_ROADS}) union all select u, v, key, -1, 'old' from ({_BLOCKS})) group by 1, 2, 3")
def edge_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two edge sets in which the later rows win."""
    _, old = _blocks(spark, sf_dir)
    new = fixtures.raw_edges(spark, sf_dir)
    one = readers.undirected(new, "seq").select("u", "v", "key", "highway")
    return graph.union_edges(old.select("u", "v", "key", F.lit("old").alias("highway")), one)


# -- partition, primary and final network --------------------------------------------------------


_BIG = f"select ctr as node_id from ({_voronoi_sql(f'select distinct node_id from ({_SNAPPED})')}) group by ctr having count(*) > {CONFIG.min_cell_nodes}"


@query(f"select s.sub_id, v.node as node_id, round(v.dist, 3) as dist from ({_voronoi_sql(_BIG)}) v join (select node_id, min(sub_id) as sub_id from ({_SNAPPED}) group by node_id) s on s.node_id = v.ctr")
def partition_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the road network after substations with few nodes are dropped and the cells computed anew."""
    centres, _, edges = _snapped(spark, sf_dir)
    text = lambda c: F.col(c).cast("string").alias(c)
    p = graph.partition(edges.select(*BY, text("u"), text("v"), "length"), centres.select(*BY, "sub_id", text("node_id")), BY, CONFIG.min_cell_nodes)
    return p.select("sub_id", F.col("node_id").cast("long").alias("node_id"), F.round("dist", 3).alias("dist"))


@query()
def partition_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stages(spark, sf_dir, "partition")
    return writers.partition_json(s["part_nodes"], s["part_edges"])


@query()
def community_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells split at a tenth of the usual feeder capacity: communities with their load and whether they stay too heavy."""
    s = _stages(spark, sf_dir, "partition")
    by = [*BY, "sub_id"]
    c = graph.communities(s["part_nodes"], s["part_edges"], 1.5, 10_000, by)
    own = c.join(s["part_nodes"].select(*by, "node_id", "load"), [*by, "node_id"])
    return own.groupBy("sub_id", "community").agg(F.count("*").alias("nodes"), F.round(F.sum("load"), 2).alias("load"), F.max("oversize").alias("oversize"))


@query()
def primary_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per substation: nodes, edges, feeders, transformers covered, and the state of its solutions."""
    s = _stages(spark, sf_dir, "primary")
    n = s["primary_nodes"].groupBy("sub_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("label") == "T").alias("transformers"))
    e = s["primary_edges"].groupBy("sub_id").agg(F.count("*").alias("edges"), F.count_if(F.col("label") == "feeder").alias("feeders"))
    t = s["part_nodes"].groupBy("sub_id").agg(F.count_if(F.col("label") == "T").alias("wanted"))
    st = s["primary_state"].groupBy("sub_id").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("status"), F.round(F.sum("cost"), 3).alias("cost_km"), F.round(F.sum("bound"), 3).alias("bound_km"))
    return st.join(t, "sub_id", "left").join(n, "sub_id", "left").join(e, "sub_id", "left").select("sub_id", "status", "nodes", "edges", "feeders", "transformers", "wanted", "cost_km", "bound_km")


@query(geo.geodesic_sql(f"select s.sub_id, n.node_id, q.lon, q.lat, n.x, n.y from ({_SNAPPED}) s join ({fixtures.SUBSTATIONS_SQL}) q on q.sub_id = s.sub_id join ({fixtures.NODES_SQL}) n on n.node_id = s.node_id", "lon", "lat", "x", "y", "m").replace("select * , g_m as m", "select 'S' || sub_id as source, cast(node_id as varchar) as target, 'feeder' as label, round(g_m, 3) as length", 1))
def feeder_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeder edge from every substation to its road node."""
    from ..operators.primary import feeder_edges as make

    centres, nodes, _ = _snapped(spark, sf_dir)
    by = [*BY, "sub_id"]
    roots = centres.select(*by, F.col("node_id").cast("string").alias("target"))
    places = centres.select(*by, "node_id").join(nodes, [*BY, "node_id"]).select(*by, F.col("node_id").cast("string").alias("target"), F.col("lon").alias("nx"), F.col("lat").alias("ny"))
    subs = fixtures.substations(spark, sf_dir).select(*by, F.col("lon").alias("sx"), F.col("lat").alias("sy"))
    return make(roots, places, subs, by).select("source", "target", "label", F.round("length", 3).alias("length"))


def _final(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s = _stages(spark, sf_dir, "primary")
    return final.combine(s["primary_nodes"], s["primary_edges"], s["secondary"], s["inputs"].homes, BY)


@query()
def final_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the whole network with their labels."""
    return _final(spark, sf_dir)["edges"].select("source", "target", "label", F.round("length", 3).alias("length"), geo.to_wkt(F.col("coords")).alias("geometry"))


@query(f"select 'node' as kind, 'H' as label, count(distinct hid) as n from ({_MAPPED})")
def network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The homes among the final network's nodes; every mapped home is one of them."""
    out = _final(spark, sf_dir)
    return final.summary(out["nodes"], out["edges"]).where("kind = 'node' and label = 'H'")


@query()
def final_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all nodes and edges of the final network by label."""
    out = _final(spark, sf_dir)
    return final.summary(out["nodes"], out["edges"])
