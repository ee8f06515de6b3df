"""Geometry as Column expressions: geodesic length, side of a line, interpolation, bounds, WKT.

A polyline is ``array<struct<x double, y double>>`` with x the longitude.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
#: WGS-84: semi-major axis in metres, flattening.
AXIS, FLAT = 6378137.0, 1 / 298.257223563
#: Rounds of the inverse formula; four leave under a micrometre within a county.
ROUNDS = 4


def geodesic_steps(x1: str, y1: str, x2: str, y2: str) -> list[dict[str, str]]:
    """The inverse geodesic (Vincenty) as levels of named SQL expressions; the last level defines ``g_m``, metres.

    Each level uses names of the levels before it, so that nothing is computed twice.
    Equal points give 0.
    """
    f, a = f"{FLAT!r}e0", f"{AXIS!r}e0"
    b = f"{AXIS * (1 - FLAT)!r}e0"
    levels = [
        {"g_u1": f"atan((1e0 - {f}) * tan(radians({y1})))", "g_u2": f"atan((1e0 - {f}) * tan(radians({y2})))", "g_l": f"radians({x2} - {x1})"},
        {"g_s1": "sin(g_u1)", "g_c1": "cos(g_u1)", "g_s2": "sin(g_u2)", "g_c2": "cos(g_u2)", "g_lam0": "g_l"},
    ]
    for k in range(ROUNDS):
        lam = f"g_lam{k}"
        levels += [
            {
                f"g_ss{k}": f"sqrt(power(g_c2 * sin({lam}), 2e0) + power(g_c1 * g_s2 - g_s1 * g_c2 * cos({lam}), 2e0))",
                f"g_cs{k}": f"g_s1 * g_s2 + g_c1 * g_c2 * cos({lam})",
            },
            {f"g_sg{k}": f"atan2(g_ss{k}, g_cs{k})", f"g_sa{k}": f"case when g_ss{k} = 0e0 then 0e0 else g_c1 * g_c2 * sin({lam}) / g_ss{k} end"},
            {f"g_ca{k}": f"1e0 - g_sa{k} * g_sa{k}"},
            {
                f"g_cm{k}": f"case when g_ca{k} = 0e0 then 0e0 else g_cs{k} - 2e0 * g_s1 * g_s2 / g_ca{k} end",
                f"g_cc{k}": f"{f} / 16e0 * g_ca{k} * (4e0 + {f} * (4e0 - 3e0 * g_ca{k}))",
            },
            {
                f"g_lam{k + 1}": f"g_l + (1e0 - g_cc{k}) * {f} * g_sa{k} * (g_sg{k} + g_cc{k} * g_ss{k} * (g_cm{k} + g_cc{k} * g_cs{k} * (2e0 * g_cm{k} * g_cm{k} - 1e0)))"
            },
        ]
    k = ROUNDS - 1
    levels += [
        {"g_uu": f"g_ca{k} * ({a} * {a} - {b} * {b}) / ({b} * {b})"},
        {
            "g_aa": "1e0 + g_uu / 16384e0 * (4096e0 + g_uu * (320e0 * g_uu - 768e0 - 175e0 * g_uu * g_uu))",
            "g_bb": "g_uu / 1024e0 * (256e0 + g_uu * (74e0 * g_uu - 128e0 - 47e0 * g_uu * g_uu))",
        },
        {
            "g_ds": f"g_bb * g_ss{k} * (g_cm{k} + g_bb / 4e0 * (g_cs{k} * (2e0 * g_cm{k} * g_cm{k} - 1e0) - g_bb / 6e0 * g_cm{k} * (4e0 * g_ss{k} * g_ss{k} - 3e0) * (4e0 * g_cm{k} * g_cm{k} - 3e0)))"
        },
        {"g_m": f"{b} * g_aa * (g_sg{k} - g_ds)"},
    ]
    return levels


def with_geodesic(df: DataFrame, x1: str, y1: str, x2: str, y2: str, name: str) -> DataFrame:
    """``df`` with the geodesic distance in metres between two points; null coordinates give null.

    The levels become nested projections of one generated-code stage; no UDF.
    """
    keep = df.columns
    out = df
    for level in geodesic_steps(x1, y1, x2, y2):
        out = out.selectExpr("*", *(f"{e} as {n}" for n, e in level.items()))
    return out.select(*(F.col(f"`{c}`") for c in keep if c != name), F.col("g_m").alias(name))


def geodesic_sql(source: str, x1: str, y1: str, x2: str, y2: str, name: str) -> str:
    """SQL, for the checking engine, of ``source`` (a query) with the distance.

    The same levels as materialised steps: an engine that merges projections would write each
    level out into all that use it.
    """
    steps = [f"q0 as materialized (select * from ({source}))"]
    for k, level in enumerate(geodesic_steps(x1, y1, x2, y2)):
        steps.append(f"q{k + 1} as materialized (select *, {', '.join(f'{e} as {n}' for n, e in level.items())} from q{k})")
    return f"with {', '.join(steps)} select * , g_m as {name} from q{len(steps) - 1}"


def point(x: Column | str, y: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def straight(x1: str, y1: str, x2: str, y2: str) -> Column:
    """Two-point line."""
    return F.array(point(x1, y1), point(x2, y2))


def segments(df: DataFrame, coords: str = "coords") -> DataFrame:
    """One row per segment of a polyline: ``seg`` from 0, and ``sx1, sy1, sx2, sy2``; a polyline of one point has none."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(coords) - 2),
        lambda i: F.struct(i.alias("seg"), F.col(coords)[i].alias("a"), F.col(coords)[i + 1].alias("b")),
    )
    return df.withColumn("s_", F.explode(F.when(F.size(coords) >= 2, pairs))).select(
        *df.columns, "s_.seg", F.col("s_.a.x").alias("sx1"), F.col("s_.a.y").alias("sy1"), F.col("s_.b.x").alias("sx2"), F.col("s_.b.y").alias("sy2")
    )


def with_length(df: DataFrame, keys: list[str], coords: str = "coords", name: str = "length") -> DataFrame:
    """``keys`` with the geodesic length of the polyline of each row; keys must be unique."""
    each = with_geodesic(segments(df.select(*keys, coords), coords), "sx1", "sy1", "sx2", "sy2", "m")
    return each.groupBy(*keys).agg(F.sum("m").alias(name))


def bounds(coords: Column) -> Column:
    """Struct of x1, y1, x2, y2."""
    xs, ys = F.transform(coords, lambda p: p.x), F.transform(coords, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def signed_area2(ring: Column) -> Column:
    """Twice the signed area of a closed ring, positive when counter-clockwise; points are taken from the first to lose no digits."""
    first = F.element_at(ring, 1)
    step = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1)), lambda a, b: (a.x - first.x) * (b.y - first.y) - (b.x - first.x) * (a.y - first.y))
    return F.aggregate(step, F.lit(0.0), lambda s, v: s + v)


def side_of_line(coords: Column, home: Column) -> Column:
    """1 if the ring of the road and the home runs counter-clockwise, else -1 (also on the line)."""
    return F.when(signed_area2(F.concat(coords, F.array(home))) > 0, 1).otherwise(-1)


def to_wkt(coords: Column) -> Column:
    """``LINESTRING (x y, ...)``; null stays null."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(coords, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", "), F.lit(")"))


def from_wkt(text: Column) -> Column:
    """Points of a LINESTRING; null for null, empty or other text."""
    inner = F.regexp_extract(text, r"^\s*LINESTRING\s*\((.+)\)\s*$", 1)
    pairs = F.transform(F.split(F.trim(inner), r"\s*,\s*"), lambda t: F.split(F.trim(t), r"\s+"))
    return F.when(inner != "", F.transform(pairs, lambda p: F.struct(p[0].try_cast("double").alias("x"), p[1].try_cast("double").alias("y"))))


def parse_point(text: Column) -> Column:
    """Point of a text like ``[x, y]`` or ``(x, y)``; null if it is not two numbers."""
    parts = F.split(F.regexp_replace(text, r"[\[\]()\s]", ""), ",")
    x, y = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when((F.size(parts) == 2) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def interpolate(df: DataFrame, keys: list[str], separation: float, coords: str = "coords") -> DataFrame:
    """Points along each polyline every ``separation`` metres from its start, while short of its end.

    How many there are follows the geodesic length, where they lie the share of the planar
    length in degrees.  Returns keys, ``i`` from 0, ``x``, ``y``; a line of length 0 has none.
    """
    seg = with_geodesic(segments(df.select(*keys, coords), coords), "sx1", "sy1", "sx2", "sy2", "m")
    seg = seg.withColumn("d", F.sqrt(F.pow(F.col("sx2") - F.col("sx1"), 2) + F.pow(F.col("sy2") - F.col("sy1"), 2)))
    line = seg.groupBy(*keys).agg(F.sum("m").alias("total"), F.sort_array(F.collect_list(F.struct("seg", "d", "sx1", "sy1", "sx2", "sy2"))).alias("s"))
    line = line.where("total > 0").withColumn("planar", F.aggregate("s", F.lit(0.0), lambda a, s: a + s.d))
    at = line.withColumn("i", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / separation).cast("int") - 1)))
    at = at.withColumn("want", F.col("i") * F.lit(float(separation)) / F.col("total") * F.col("planar"))
    zero = F.struct(F.lit(0.0).alias("before"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def walk(a: Column, s: Column) -> Column:
        here = a.x.isNull() & (F.col("want") <= a.before + s.d)
        t = F.when(s.d > 0, (F.col("want") - a.before) / s.d).otherwise(F.lit(0.0))
        return F.struct(
            (a.before + s.d).alias("before"), F.when(here, s.sx1 + t * (s.sx2 - s.sx1)).otherwise(a.x).alias("x"), F.when(here, s.sy1 + t * (s.sy2 - s.sy1)).otherwise(a.y).alias("y")
        )

    at = at.withColumn("p", F.aggregate("s", zero, walk)).withColumn("end", F.element_at("s", -1))
    return at.select(*keys, "i", F.coalesce("p.x", "end.sx2").alias("x"), F.coalesce("p.y", "end.sy2").alias("y"))
