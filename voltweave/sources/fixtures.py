"""Inputs derived from the driver tables, so that every operator runs on the given data.

The same rules are written once as SQL that both Spark and the checking engine read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from .readers import fill_geometry, homes_from_columns, undirected

_HOURS = ", ".join(f"coalesce(round(sum(case when h = {i} then s end), 3), 0e0) as hour{i + 1}" for i in range(24))
#: Homes: customers on a scattered grid, hourly loads from the events of one user each.
HOMES_SQL = f"""
select c.c_custkey as hid, c.c_nationkey as region, -77e0 + ((c.c_custkey * 7919) % 997) / 10000e0 as longitude, 38e0 + ((c.c_custkey * 104729) % 1009) / 10000e0 as latitude,
  {", ".join(f"coalesce(p.hour{i}, 0e0) as hour{i}" for i in range(1, 25))}
from customer c cross join (select count(distinct user_id) as users from events) n
left join (select user_id, {_HOURS} from (select user_id, hour(ts) as h, sum(value) as s from events group by user_id, hour(ts)) q group by user_id) p on p.user_id = c.c_custkey % n.users
"""
#: Substations: suppliers; some fall outside the homes' hull.
SUBSTATIONS_SQL = """
select cast(s_suppkey as varchar(20)) as sub_id, -77.005e0 + ((s_suppkey * 6151) % 1103) / 10000e0 as lon, 37.995e0 + ((s_suppkey * 92821) % 1109) / 10000e0 as lat from supplier
"""
#: Road nodes: parts on a grid 40 wide.
NODES_SQL = "select p_partkey as node_id, -77e0 + (p_partkey % 40) * 0.0025e0 as x, 38e0 + floor(p_partkey / 40e0) * 0.002e0 as y from part"
#: Road edges: right and upper neighbours in both directions; a third bend at a middle point, some lack geometry; lengths are irregular so that routes do not tie.
EDGES_SQL = f"""
select u, v, 0 as key, seq, w as length, case when (u + v) % 5 = 0 then 'primary' else 'residential' end as highway, ux, uy, vx, vy,
  case when (least(u, v) * 31 + greatest(u, v) * 17) % 3 = 0 then 1 else 0 end as bent, case when (u + 3 * v) % 7 = 0 then 1 else 0 end as bare
from (
  select a.node_id as u, b.node_id as v, a.x as ux, a.y as uy, b.x as vx, b.y as vy, case when a.node_id < b.node_id then a.node_id * 4 else b.node_id * 4 + 1 end + case when abs(a.node_id - b.node_id) = 40 then 2 else 0 end as seq,
    200e0 + ((least(a.node_id, b.node_id) * 7919 + greatest(a.node_id, b.node_id) * 104729) % 9973) / 100e0 + case when a.node_id > b.node_id then 0.001e0 else 0e0 end as w
  from ({NODES_SQL}) a join ({NODES_SQL}) b
    on (b.node_id = a.node_id + 1 and a.node_id % 40 < 39) or (b.node_id = a.node_id - 1 and a.node_id % 40 > 0) or b.node_id = a.node_id + 40 or b.node_id = a.node_id - 40
) e
"""


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in ("customer", "events", "supplier", "part"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def home_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The homes CSV contract: hid, longitude, latitude, hour1..hour24, and region."""
    views(spark, sf_dir)
    return spark.sql(HOMES_SQL)


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homes with profile, peak and load; one network region (0) for all, since nations overlap in space."""
    return homes_from_columns(home_columns(spark, sf_dir)).withColumnRenamed("region", "nation").withColumn("region", F.lit(0))


def substations(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(SUBSTATIONS_SQL).withColumn("sub_id", F.col("sub_id").cast("string")).withColumn("region", F.lit(0))


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(NODES_SQL)


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed road edges as a road file has them; geometry is missing on some.

    Neighbours are found by two equi-joins on shifted keys, not by the inequality form of the SQL.
    """
    n = road_nodes(spark, sf_dir)
    other = n.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    a = n.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    steps = F.array(F.when(F.col("u") % 40 < 39, F.col("u") + 1), F.when(F.col("u") % 40 > 0, F.col("u") - 1), F.col("u") + 40, F.col("u") - 40)
    e = a.withColumn("v", F.explode(F.array_compact(steps))).join(other, "v")
    low, high = F.least("u", "v"), F.greatest("u", "v")
    e = e.select(
        "u", "v", F.lit(0).alias("key"),
        (low * 4 + F.when(F.col("u") > F.col("v"), 1).otherwise(0) + F.when(high - low == 40, 2).otherwise(0)).alias("seq"),
        (F.lit(200.0) + ((low * 7919 + high * 104729) % 9973) / 100.0 + F.when(F.col("u") > F.col("v"), 0.001).otherwise(0.0)).alias("length"),
        F.when((F.col("u") + F.col("v")) % 5 == 0, "primary").otherwise("residential").alias("highway"), "ux", "uy", "vx", "vy",
        ((low * 31 + high * 17) % 3 == 0).alias("bent"), ((F.col("u") + 3 * F.col("v")) % 7 == 0).alias("bare"),
    )
    middle = geo.point((F.col("ux") + F.col("vx")) / 2 + 0.0003, (F.col("uy") + F.col("vy")) / 2 + 0.0002)
    line = F.when(F.col("bent"), F.array(geo.point("ux", "uy"), middle, geo.point("vx", "vy"))).otherwise(geo.straight("ux", "uy", "vx", "vy"))
    return e.withColumn("coords", F.when(~F.col("bare"), line)).select("u", "v", "key", "coords", "length", "highway", "seq")


def roads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, undirected edges with geometry), region 0."""
    nodes = road_nodes(spark, sf_dir)
    edges = undirected(fill_geometry(raw_edges(spark, sf_dir), nodes), "seq")
    return nodes.withColumn("region", F.lit(0)), edges.withColumn("region", F.lit(0))


