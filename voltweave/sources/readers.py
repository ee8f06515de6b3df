"""Readers of the documented file contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schema
from ..functions import geo
from ..functions.hull import convex_hull, strictly_inside


def _csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """CSV by column name; missing file raises ``FileNotFoundError``, missing column ``ValueError``; empty and unreadable values are null."""
    want = [c.split()[0] for c in columns.split(", ")]
    try:
        head = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    missing = [c for c in want if c not in head.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    kinds = dict(c.split(" ", 1) for c in columns.split(", "))
    return head.select(*(F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in want))


def homes_from_columns(df: DataFrame) -> DataFrame:
    """Home table from ``hid, longitude, latitude, hour1..hour24`` (other columns stay): profile array, peak and mean load."""
    rest = [c for c in df.columns if c not in {"hid", "longitude", "latitude", *schema.HOURS}]
    out = df.select("hid", *rest, F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.array(*schema.HOURS).alias("profile"))
    return out.withColumn("peak", F.array_max("profile")).withColumn("load", F.aggregate("profile", F.lit(0.0), lambda a, v: a + v) / 24)


def load_homes(spark: SparkSession, path: str) -> DataFrame:
    """Homes of a CSV; a row with a missing or unreadable value raises ``ValueError`` with its id."""
    df = _csv(spark, path, schema.HOME_CSV)
    bad = df.where(" or ".join(f"{c} is null" for c in ["hid", "longitude", "latitude", *schema.HOURS])).select("hid").head(1)
    if bad:
        raise ValueError(f"{path}: a row with a missing value, hid {bad[0].hid}")
    return homes_from_columns(df)


def substations_inside(substations: DataFrame, homes: DataFrame) -> DataFrame:
    """Substations strictly inside the convex hull of the homes; ``ValueError`` without homes."""
    return substations.where(strictly_inside(convex_hull(homes)))


def load_substations(spark: SparkSession, path: str, homes: DataFrame) -> DataFrame:
    """``sub_id`` (text, leading zeros kept), ``lon``, ``lat``."""
    df = _csv(spark, path, schema.SUBSTATION_CSV).select(F.col("ID").alias("sub_id"), F.col("X").alias("lon"), F.col("Y").alias("lat"))
    return substations_inside(df, homes)


def fill_geometry(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``coords``; where missing, the straight line between the end nodes."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    out = edges.join(a, "u", "left").join(b, "v", "left")
    return out.withColumn("coords", F.coalesce("coords", geo.straight("ux", "uy", "vx", "vy"))).select(*edges.columns)


def undirected(edges: DataFrame, order: str) -> DataFrame:
    """One row for both directions of (u, v, key), u at most v; the last row by ``order`` gives the attributes, its geometry turned to run from u."""
    turn = F.col("u") > F.col("v")
    flat = edges.select(
        F.least("u", "v").alias("u_"), F.greatest("u", "v").alias("v_"), "key",
        F.struct(F.col(order).alias("o"), F.when(turn, F.reverse("coords")).otherwise(F.col("coords")).alias("coords"),
                 *(c for c in edges.columns if c not in {"u", "v", "key", "coords", order})).alias("s"),
    )
    last = flat.groupBy("u_", "v_", "key").agg(F.max_by("s", "s.o").alias("s"))
    rest = [c for c in edges.columns if c not in {"u", "v", "key", order}]
    return last.select(F.col("u_").alias("u"), F.col("v_").alias("v"), "key", *(F.col(f"s.{c}").alias(c) for c in rest))


def load_roads(spark: SparkSession, edges_path: str, nodes_path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, undirected edges) of the two road CSVs; empty coordinates and lengths are null, missing geometry is a straight line.

    Row order within the edge file decides between the two directions: file, then place in it.
    """
    nodes = _csv(spark, nodes_path, schema.ROAD_NODE_CSV)
    raw = _csv(spark, edges_path, schema.ROAD_EDGE_CSV).withColumn("coords", geo.from_wkt(F.col("geometry"))).drop("geometry")
    raw = fill_geometry(raw.withColumn("seq", F.monotonically_increasing_id()), nodes)
    return nodes, undirected(raw, "seq")


def clip_roads(nodes: DataFrame, edges: DataFrame, homes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roads within the homes' hull: nodes strictly inside and the edges between them; ``ValueError`` without homes or edges."""
    inside = nodes.where(strictly_inside(convex_hull(homes), "x", "y"))
    ids = inside.select("node_id")
    kept = edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi").select(*edges.columns)
    if not kept.head(1):
        raise ValueError("no road edges inside the hull of the homes")
    return inside, fill_geometry(kept, nodes)


_MAPPED = r"^\s*Home\(id=(\d+), lon=[-\d.]+, lat=[-\d.]+\)\s*->\s*Edge\((\d+), (\d+), (\d+)\)\s*$"


def read_mapping(spark: SparkSession, homes: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(hid, u, v, key) of a mapping text, and how many lines were skipped: not of the form, or of an unknown home."""
    lines = spark.read.text(path)
    got = lines.select(*(F.regexp_extract("value", _MAPPED, i).alias(c) for i, c in enumerate(("hid", "u", "v", "key"), 1)))
    good = got.where("hid != ''").select(F.col("hid").cast("long"), F.col("u").cast("long"), F.col("v").cast("long"), F.col("key").cast("int"))
    known = good.join(homes.select("hid"), "hid", "left_semi")
    return known, lines.count() - known.count()


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(u, v, key, seq): road link and its ordered nodes; lines of under four fields are skipped."""
    t = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.size(t) >= 4)
    return lines.select(t[0].cast("long").alias("u"), t[1].cast("long").alias("v"), t[2].cast("int").alias("key"), F.slice(t, F.lit(4), F.size(t) - 3).alias("seq"))


def read_transformers(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, schema.TRANSFORMER_CSV)
    return df.select("transformer_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.col("total_load").alias("load"))


def read_secondary(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schema.SECONDARY_CSV)


def read_network(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a combined network; edges without geometry get the straight line."""
    nodes = _csv(spark, nodes_path, schema.NET_NODE_CSV).select("node_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), "load", "label")
    edges = _csv(spark, edges_path, schema.NET_EDGE_CSV).select(
        F.col("from_node").alias("u"), F.col("to_node").alias("v"), "key", "highway", "length", geo.from_wkt(F.col("geometry")).alias("coords")
    )
    return nodes, fill_geometry(edges, nodes.select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y")))


def read_partitions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(part_nodes, part_edges) of a partition JSON; ``ValueError`` for other text or keys that are no numbers."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", schema.PARTITION_JSON).alias("m"))
    subs = parsed.select(F.explode("m").alias("sub_id", "p"))
    if parsed.where("m is null").head(1) or subs.where(~F.col("sub_id").rlike(r"^\d+$")).head(1):
        raise ValueError(f"{path}: not a partition file")
    nodes = subs.select("sub_id", F.explode("p.nodelist").alias("node_id", "n")).select(
        "sub_id", "node_id", F.col("n.cord")[0].alias("lon"), F.col("n.cord")[1].alias("lat"), "n.label", "n.load", "n.distance"
    )
    edge = r"^\((.+), (.+), (\d+)\)$"
    edges = subs.select("sub_id", F.explode("p.edgelist").alias("e", "a")).select(
        "sub_id", F.trim(F.regexp_extract("e", edge, 1), F.lit("'")).alias("u"), F.trim(F.regexp_extract("e", edge, 2), F.lit("'")).alias("v"),
        F.regexp_extract("e", edge, 3).cast("int").alias("key"), "a.highway", geo.from_wkt(F.col("a.geometry")).alias("coords"), "a.length",
    )
    if nodes.where("lon is null or lat is null or label is null or load is null").head(1) or edges.where("u = '' or length is null").head(1):
        raise ValueError(f"{path}: a node or edge lacks a required attribute")
    return nodes, edges


def read_primary(spark: SparkSession, nodes_glob: str, edges_glob: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all substations' files that a glob matches; nodes whose coordinates cannot be read are left out."""
    nodes = _csv(spark, nodes_glob, schema.PRIM_NODE_CSV).withColumn("p", geo.parse_point(F.col("cord"))).where("p is not null")
    edges = _csv(spark, edges_glob, schema.PRIM_EDGE_CSV).withColumn("coords", geo.from_wkt(F.col("geometry"))).drop("geometry")
    return nodes.select("node_id", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"), "label", "load", "distance"), edges
