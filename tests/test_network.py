import math
import time
import tracemalloc
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltweave.config import Config, Primary, Secondary, load_config, transformer_base
from voltweave.functions import geo
from voltweave.functions.hull import convex_hull, monotone_chain
from voltweave.operators import final, graph, mapping, partition, primary, secondary
from voltweave.plans import queries
from voltweave.sources import readers, writers

P = "struct<x:double,y:double>"
EDGES = f"u long, v long, key int, coords array<{P}>, length double, highway string"


def homes_csv(path, rows, columns=None):
    head = columns or ["hid", "longitude", "latitude", *(f"hour{i}" for i in range(1, 25))]
    path.write_text("\n".join([",".join(head), *(",".join(map(str, r)) for r in rows)]) + "\n")
    return str(path)


def test_homes_csv(spark, tmp_path):
    rows = [(1, -73.935242, 40.730610, *(10 * i for i in range(1, 25))), (2, -74.006015, 40.712775, *(5 * i for i in range(1, 25)))]
    got = readers.load_homes(spark, homes_csv(tmp_path / "h.csv", rows)).orderBy("hid").collect()
    assert len(got) == 2 and (got[0].lon, got[0].lat) == (-73.935242, 40.730610)
    assert len(got[0].profile) == 24 and got[0].peak == 240 and got[0].load == 125 and got[1].load == 62.5


def test_homes_csv_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.load_homes(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        readers.load_homes(spark, homes_csv(tmp_path / "a.csv", [(1, -73.9, 40.7)], ["hid", "longitude", "latitude"]))
    with pytest.raises(ValueError):
        readers.load_homes(spark, homes_csv(tmp_path / "b.csv", [(1, -73.9, 40.7, *["x"] * 24)]))


def test_substations_strictly_inside(spark, tmp_path):
    homes = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0)], "lon double, lat double")
    (tmp_path / "s.csv").write_text("ID,X,Y\n007,1,0.5\nedge,1,0\ncorner,2,2\nout,3,1\n")
    assert [r.sub_id for r in readers.load_substations(spark, str(tmp_path / "s.csv"), homes).collect()] == ["007"]
    with pytest.raises(ValueError):
        readers.substations_inside(homes, homes.limit(0))


def test_hull_of_many_partitions(spark):
    rng = np.random.default_rng(4)
    points = [tuple(map(float, p)) for p in rng.normal(size=(3000, 2))]
    df = spark.createDataFrame(points, "lon double, lat double").repartition(130)
    assert set(convex_hull(df)) == set(monotone_chain(points))


def test_geodesic_published_value(spark):
    # Flinders Peak to Buninyong; WGS-84 and GRS80 differ by less than a millimetre here
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    df = spark.createDataFrame([(dms(144, 25, 29.52440), dms(-37, 57, 3.72030), dms(143, 55, 35.38390), dms(-37, 39, 10.15610)), (1.0, 2.0, 1.0, 2.0)], "a double, b double, c double, d double")
    got = [r.m for r in geo.with_geodesic(df, "a", "b", "c", "d", "m").collect()]
    assert abs(got[0] - 54972.271) < 1e-3 and got[1] == 0
    assert abs(secondary._distance(np.array([df.first().a, df.first().c]), np.array([df.first().b, df.first().d]))[0, 1] - got[0]) < 1e-6


def test_interpolation_counts(spark):
    degree = 1 / 110574.0  # of latitude, about a metre at the equator
    rows = [(k, [(0.0, 0.0), (0.0, n * degree)]) for k, n in ((1, 120), (2, 99), (3, 0))]
    df = spark.createDataFrame(rows, f"k int, coords array<{P}>")
    got = geo.interpolate(df, ["k"], 50.0).groupBy("k").agg(F.count("*").alias("n")).collect()
    assert {r.k: r.n for r in got} == {1: 3, 2: 2}


def test_sides(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.5, -1.0), (0.5, 0.0)], "x double, y double")
    line = F.array(geo.point(F.lit(0), F.lit(0)), geo.point(F.lit(1), F.lit(0)))
    assert [r[0] for r in df.select(geo.side_of_line(line, F.struct("x", "y"))).collect()] == [1, -1, -1]


def test_two_way_and_parallel_roads(spark):
    a, b = (0.0, 0.0), (1.0, 0.0)
    rows = [(1, 2, 0, [a, b], 5.0, "x", 1), (2, 1, 0, [b, (0.5, 1.0), a], 7.0, "y", 2), (1, 2, 1, None, None, None, 3), (4, 4, 0, [a, b, a], 1.0, "loop", 4)]
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (4, 0.0, 0.0)], "node_id long, x double, y double")
    got = {(r.u, r.v, r.key): r for r in readers.undirected(readers.fill_geometry(spark.createDataFrame(rows, EDGES + ", seq long"), nodes), "seq").collect()}
    assert len(got) == 3 and got[1, 2, 0].length == 7 and got[1, 2, 0].highway == "y"
    assert [tuple(p) for p in got[1, 2, 0].coords] == [a, (0.5, 1.0), b] and [tuple(p) for p in got[1, 2, 1].coords] == [a, b]


def road_frame(spark, rows):
    return spark.createDataFrame([(u, v, 0, c, 1.0, "r") for u, v, c in rows], EDGES)


def test_nearest_vertex_wins_over_nearest_segment(spark):
    edges = road_frame(spark, [(1, 2, [(0.0, 0.0), (0.02, 0.0)]), (3, 4, [(0.01, 0.0012), (0.01, 0.0019)])])
    home = spark.createDataFrame([(7, 0.01, 0.0005)], "hid long, lon double, lat double")
    got = mapping.nearest_edges(home, edges, 0.001).first()
    assert (got.u, got.v) == (3, 4)


def test_far_home_maps_at_a_later_run(spark):
    edges = road_frame(spark, [(1, 2, [(0.0, 0.0), (0.001, 0.0)])])
    homes = spark.createDataFrame([(1, 0.0005, 0.0), (2, 0.05, 0.0), (3, 170.0, 0.0)], "hid long, lon double, lat double")
    got = {r.hid: r.pad_level for r in mapping.map_homes(homes, edges, 0.001, max_runs=4).collect()}
    assert got == {1: 0, 2: 2, 3: None}


def small_cover(rng, m):
    cost = rng.uniform(1, 10, (m, m))
    cost = (cost + cost.T) / 2
    return cost, rng.uniform(1, 10, m), rng.uniform(1, 5, m)


def brute_cover(cost, start, load, rating, hops):
    m, best = len(load), math.inf

    def extend(left, path, total):
        nonlocal best
        if total >= best:
            return
        if not left:
            best = total
            return
        for i in sorted(left):
            rest = left - {i}
            if path and len(path) < hops and load[path].sum() + load[i] <= rating:
                extend(rest, path + [i], total + cost[path[-1], i])
            if load[i] <= rating:
                extend(rest, [i], total + start[i])

    extend(frozenset(range(m)), [], 0.0)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_exact_cover_is_the_optimum(seed):
    rng = np.random.default_rng(seed)
    cost, start, load = small_cover(rng, int(rng.integers(1, 6)))
    rating, hops = float(rng.uniform(3, 12)), int(rng.integers(1, 4))
    paths = secondary.exact_cover(cost, start, load, rating, hops)
    want = brute_cover(cost, start, load, rating, hops)
    if paths is None:
        assert want == math.inf
        return
    total = sum(start[p[0]] + sum(cost[a, b] for a, b in zip(p, p[1:])) for p in paths)
    assert abs(total - want) < 1e-9 and sorted(i for p in paths for i in p) == list(range(len(load)))
    assert secondary.tree_bound(cost, start) <= total + 1e-9


def test_links_solved_together_are_solved_alone():
    rng = np.random.default_rng(3)
    for m, rating, hops in ((1, 4.0, 2), (4, 9.0, 3), (7, 12.0, 7), (5, 9.0, 0)):
        many = [small_cover(rng, m) for _ in range(20)]
        cost, start, load = (np.stack(x) for x in zip(*many, strict=True))
        start[3, 0] = np.inf
        covers = secondary.exact_covers(cost, start, load, rating, hops)
        assert len(covers) == 20
        for x, paths in enumerate(covers):
            want = brute_cover(cost[x], start[x], load[x], rating, hops) if hops else math.inf
            got = math.inf if paths is None else sum(start[x, p[0]] + sum(cost[x, a, b] for a, b in zip(p, p[1:])) for p in paths)
            assert got == want or abs(got - want) < 1e-9
            assert paths is None or all(len(p) <= hops and load[x, p].sum() <= rating for p in paths)


@pytest.mark.parametrize("seed", range(6))
def test_savings_cover_keeps_the_rules(seed):
    rng = np.random.default_rng(seed)
    cost, start, load = small_cover(rng, 25)
    paths = secondary.savings_cover(cost, start, load, 12.0, 5)
    assert sorted(i for p in paths for i in p) == list(range(25))
    assert all(len(p) <= 5 and load[p].sum() <= 12 for p in paths)
    total = sum(start[p[0]] + sum(cost[a, b] for a, b in zip(p, p[1:])) for p in paths)
    assert secondary.tree_bound(cost, start) <= total <= start.sum() + 1e-9


def test_delaunay_small_cases():
    square = np.array([[0, 0], [1, 0], [0, 1], [1, 1.1]], float)
    assert len(secondary.delaunay(square)) == 5
    line = np.array([[0, 0], [1, 0], [2, 0], [3, 0]], float)
    assert len(secondary.delaunay(line)) == 6 and len(secondary.delaunay(np.zeros((4, 2)))) == 6
    points = np.random.default_rng(0).uniform(size=(40, 2))
    edges = secondary.delaunay(points)
    near = {(min(i, j), max(i, j)) for i in range(40) for j in [int(np.argsort(((points - points[i]) ** 2).sum(1))[1])]}
    assert near <= edges and len(edges) <= 3 * 40 - 6


def test_secondary_links_and_failures(spark):
    road = [(1, 2, [(0.0, 0.0), (0.002, 0.0)]), (3, 4, [(0.1, 0.0), (0.1, 0.0)])]
    rows = [(i, 0.0001 * i, 0.0002, 100.0) for i in range(1, 12)] + [(50, 0.001, -0.0001, 30_000.0)]
    homes = spark.createDataFrame(rows, "hid long, lon double, lat double, load double")
    edges = road_frame(spark, road)
    m = spark.createDataFrame([(h, 1, 2, 0) for h in range(1, 12)], "hid long, u long, v long, key int")
    made = secondary.build(m, homes, edges, Secondary(), 100)
    d = made["design"].collect()
    assert {r.status for r in d} == {"heuristic"} and len(d) == 11 and d[0].bound <= d[0].cost
    assert d and max(r.pos for r in d) < 10 and made["transformers"].agg(F.sum("load")).first()[0] == 1100.0
    over = spark.createDataFrame([(50, 1, 2, 0), (1, 3, 4, 0)], "hid long, u long, v long, key int")
    bad = secondary.build(over, homes, edges, Secondary(), 100)
    assert sorted((r.u, r.v) for r in bad["failures"].collect()) == [(1, 2), (3, 4)] and bad["secondary"].count() == 0


def grid(side, gap=()):
    rows = []
    for i in range(side * side):
        if i % side < side - 1:
            rows.append((i, i + 1))
        if i + side < side * side:
            rows.append((i, i + side))
    return [e for e in rows if e not in gap]


def test_voronoi_forms_agree(spark):
    edges = spark.createDataFrame([(0, str(u), str(v), 1.0 + (u * 7 + v * 13) % 5 / 10) for u, v in grid(6)], "region int, u string, v string, length double")
    centres = spark.createDataFrame([(0, "0"), (0, "35"), (0, "20")], "region int, node_id string")
    a = {r.node_id: (r.centre, round(r.dist, 6)) for r in graph.voronoi(edges, centres, ["region"]).collect()}
    b = {r.node_id: (r.centre, round(r.dist, 6)) for r in graph.voronoi_frontier(edges, centres, ["region"]).collect()}
    assert a == b and len(a) == 36
    both = edges.union(spark.createDataFrame([(1, "0", "1", 1.0), (1, "1", "2", 1.0)], edges.schema))
    seeds = centres.union(spark.createDataFrame([(1, "2")], centres.schema))
    want = {tuple(r) for r in graph.voronoi(both, seeds, ["region"]).withColumn("dist", F.round("dist", 6)).collect()}
    for most in (10, 1, 1000):  # the large region by joins, both, none
        assert {tuple(r) for r in graph.nearest_centres(both, seeds, ["region"], most).withColumn("dist", F.round("dist", 6)).collect()} == want
    one = graph.nearest_centres(edges.drop("region"), centres.drop("region"), [], 10).collect()
    assert {r.node_id: (r.centre, round(r.dist, 6)) for r in one} == a


def test_small_cell_loses_its_substation(spark):
    edges = spark.createDataFrame([(0, str(i), str(i + 1), 1.0) for i in range(20)], "region int, u string, v string, length double")
    centres = spark.createDataFrame([(0, "a", "3"), (0, "b", "3"), (0, "c", "20")], "region int, sub_id string, node_id string")
    got = graph.partition(edges, centres, ["region"], 10).collect()
    assert {r.sub_id for r in got} == {"a"} and len(got) == 21
    with pytest.raises(ValueError):
        graph.partition(edges, centres, ["region"], 100)


def test_snap_retries_for_all(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, 0.0)], "node_id long, lon double, lat double")
    subs = spark.createDataFrame([("x", 0.0001, 0.0), ("y", 0.095, 0.0)], "sub_id string, lon double, lat double")
    got = partition.snap(subs, nodes, 0.001).collect()
    assert {(r.sub_id, r.node_id, r.radius_level) for r in got} == {("x", 1, 1), ("y", 2, 1)}
    with pytest.raises(ValueError):
        partition.snap(subs, nodes.where("node_id = 1"), 0.001, max_runs=2)


def test_components_are_joined_to_the_largest(spark):
    rows = [("a", 0.0, 0.0, "R"), ("b", 0.001, 0.0, "R"), ("t", 0.002, 0.0, "T"), ("c", 0.01, 0.0, "R"), ("s", 0.011, 0.0, "T"), ("x", 5.0, 5.0, "R"), ("y", 5.1, 5.0, "R")]
    nodes = spark.createDataFrame([(n, x, y, lab, 0.0) for n, x, y, lab in rows], "node_id string, lon double, lat double, label string, load double")
    edges = spark.createDataFrame([("a", "b", 0, "r", 1.0, None), ("b", "t", 0, "r", 1.0, None), ("c", "s", 0, "r", 1.0, None), ("x", "y", 0, "r", 1.0, None)], f"u string, v string, key int, highway string, length double, coords array<{P}>")
    n, e = graph.join_components(nodes, edges)
    assert sorted(r.node_id for r in n.collect()) == ["a", "b", "c", "s", "t"]
    new = [r for r in e.collect() if r.highway == "unclassified"]
    assert [(r.u, r.v, r.key) for r in new] == [("b", "c", 0)] and e.count() == 4


def test_far_components_are_joined_or_raise(spark):
    cols = "node_id string, lon double, lat double, label string, load double"
    edges = spark.createDataFrame([("a", "b", 0, "r", 1.0, None), ("b", "t", 0, "r", 1.0, None), ("c", "s", 0, "r", 1.0, None)], f"u string, v string, key int, highway string, length double, coords array<{P}>")
    rows = [("a", 0.0, 38.0, "R", 0.0), ("b", 0.001, 38.0, "R", 0.0), ("t", 0.002, 38.0, "T", 0.0), ("c", 80.0, 38.0, "R", 0.0), ("s", 80.001, 38.0, "T", 0.0)]
    _, e = graph.join_components(spark.createDataFrame(rows, cols), edges)
    assert [(r.u, r.v) for r in e.collect() if r.highway == "unclassified"] == [("b", "c")]
    roadless = [r if r[0] != "c" else ("c", 80.0, 38.0, "T", 0.0) for r in rows]
    with pytest.raises(ValueError):
        graph.join_components(spark.createDataFrame(roadless, cols), edges)


def test_girvan_newman_splits_at_the_bridge():
    a = np.array([0, 1, 0, 3, 4, 3, 2])
    b = np.array([1, 2, 2, 4, 5, 5, 3])
    label = graph.girvan_newman(6, a, b)
    assert len(set(label[:3])) == 1 and len(set(label[3:])) == 1 and label[0] != label[3]
    flow = graph.edge_betweenness(6, a, b)
    assert flow[6] == 9 and flow.argmax() == 6
    community, over = graph.split(6, a, b, np.array([0, 0, 0, 0, 0, 9000.0]), 5.0)
    assert over.sum() == 1 and len(set(community)) > 2


def feeder(rng):
    n_r, n_t = int(rng.integers(2, 4)), int(rng.integers(1, 3))
    n = n_r + n_t
    edges = [(i, int(rng.integers(0, i)), float(rng.uniform(0.1, 1))) for i in range(1, n)]
    for _ in range(2):
        a, b = (int(x) for x in rng.integers(0, n, 2))
        if a != b and not any({a, b} == {x, y} for x, y, _ in edges):
            edges.append((a, b, float(rng.uniform(0.1, 1))))
    load = np.array([0.0] * n_r + list(rng.uniform(50, 250, n_t)))
    root = np.array(list(rng.uniform(0.1, 2, n_r)) + [np.inf] * n_t)
    return primary.Feeder(n, edges, load, root, Primary())


@pytest.mark.parametrize("seed", range(15))
def test_feeders_against_enumeration(seed):
    f = feeder(np.random.default_rng(seed))
    got, best = f.improve(), f.brute()
    if got is not None:
        assert f.faults(*got) == []
        assert f.bound() - 1e-9 <= best <= f.cost(*got) + 1e-9 <= 1.6 * best + 1e-6
    else:
        assert best == math.inf or f.load.max() > Primary().maximum_branch_flow / 2


def test_feeder_limits_hold():
    edges = [(0, 2, 0.5), (0, 3, 0.5), (1, 0, 0.2)]
    f = primary.Feeder(4, edges, np.array([0, 0, 300.0, 300.0]), np.array([1.0, 1.5, np.inf, np.inf]), Primary())
    assert f.improve() is None  # two roots are needed, but both transformers hang on node 0
    one = replace(Primary(), maximum_branch_flow=1000.0)
    got = primary.Feeder(4, edges, np.array([0, 0, 300.0, 300.0]), np.array([1.0, 1.5, np.inf, np.inf]), one).improve()
    assert got == ([0, 1], [0])


def test_summary_counts_every_label(spark, monkeypatch):
    nodes = spark.createDataFrame([("H1", "H"), ("H2", "H"), ("S1", "S"), ("1", "R"), ("T1", "T")], "node_id string, label string")
    edges = spark.createDataFrame([("a", "feeder"), ("b", "primary"), ("c", "secondary"), ("d", "secondary")], "source string, label string")
    monkeypatch.setattr(queries, "_final", lambda *_: {"nodes": nodes, "edges": edges})
    got = {tuple(r) for r in queries.QUERIES["final_summary"](spark, "").collect()}
    assert got == {("node", "H", 2), ("node", "S", 1), ("node", "R", 1), ("node", "T", 1), ("edge", "feeder", 1), ("edge", "primary", 1), ("edge", "secondary", 2)}
    assert "final_summary" not in queries.ORACLE_SQL and "network_summary" in queries.ORACLE_SQL


def test_final_network_and_files(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "S1", 0.0, 0.0, "S", 0.0, None), ("1", "9", 0.0, 1.0, "R", 0.0, 5.0), ("1", "T5", 1.0, 1.0, "T", 2.0, None)], "sub_id string, node_id string, lon double, lat double, label string, load double, distance double")
    edges = spark.createDataFrame([("1", "S1", "9", "feeder", 5.0, [(0.0, 0.0), (0.0, 1.0)]), ("1", "9", "T5", "primary", 6.0, [(0.0, 1.0), (1.0, 1.0)])], f"sub_id string, source string, target string, label string, length double, coords array<{P}>")
    homes = spark.createDataFrame([(1, 2.0, 2.0), (2, 3.0, 2.0)], "hid long, lon double, lat double")
    lines = spark.createDataFrame([("T5", "1", 1.5), ("T77", "2", 1.0)], "from_node string, to_node string, length double")
    out = final.combine(nodes.drop("sub_id"), edges.drop("sub_id"), lines, homes)
    assert sorted(r.label for r in out["edges"].collect()) == ["feeder", "primary", "secondary"]
    assert [r.node_id for r in out["unserved"].collect()] == ["H2"]
    writers.write_primary(nodes, edges, str(tmp_path / "n"), str(tmp_path / "e"))
    n, e = readers.read_primary(spark, str(tmp_path / "n"), str(tmp_path / "e"))
    assert n.count() == 3 and {len(r.coords) for r in e.collect()} == {2}
    with pytest.raises(ValueError):
        writers.write_primary(nodes.limit(2), edges, str(tmp_path / "n2"), str(tmp_path / "e2"))
    writers.write_final(out["nodes"], out["edges"], str(tmp_path / "fn"), str(tmp_path / "fe"))
    assert set(final.layers(out["nodes"], out["edges"])) == {"node_S", "node_R", "node_T", "node_H", "edge_feeder", "edge_primary", "edge_secondary"}


def test_file_round_trips(spark, tmp_path):
    homes = spark.createDataFrame([(1, -77.0, 38.0), (2, -77.5, 38.5)], "hid long, lon double, lat double")
    m = spark.createDataFrame([(1, 10, 11, 0), (2, None, None, None)], "hid long, u long, v long, key int")
    writers.write_mapping(m, homes, str(tmp_path / "m"))
    (tmp_path / "m" / "extra.txt").write_text("Home(id=9, lon=1, lat=2) -> Edge(1, 2, 3)\nnonsense\n")
    got, skipped = readers.read_mapping(spark, homes, str(tmp_path / "m"))
    assert [tuple(r) for r in got.collect()] == [(1, 10, 11, 0)] and skipped == 2
    seq = spark.createDataFrame([(1, 2, 0, ["1", "T5", "2"])], "u long, v long, key int, seq array<string>")
    writers.write_sequences(seq, str(tmp_path / "q"))
    assert readers.read_sequences(spark, str(tmp_path / "q")).first().seq == ["1", "T5", "2"]
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0, [(0.0, 0.0), (0.5, 0.5), (1.0, 0.0)], 3.0, "r"), (2, 1, 1, None, None, "r")], EDGES)
    writers.write_roads(nodes, edges, str(tmp_path / "rn"), str(tmp_path / "re"))
    _, back = readers.load_roads(spark, str(tmp_path / "re"), str(tmp_path / "rn"))
    assert {(r.u, r.v, r.key): len(r.coords) for r in back.collect()} == {(1, 2, 0): 3, (1, 2, 1): 2}
    pn = spark.createDataFrame([("1", "5", 0.0, 0.0, "R", 0.0, 2.0), ("22", "8", 0.0, 1.0, "R", 0.0, 1.0), ("3", "9", 0.0, 2.0, "R", 0.0, 4.0), ("1", "T1", 1.0, 0.0, "T", 3.0, None)], "sub_id string, node_id string, lon double, lat double, label string, load double, distance double")
    pe = spark.createDataFrame([("1", "5", "T1", 0, "r", 7.0, [(0.0, 0.0), (1.0, 0.0)])], f"sub_id string, u string, v string, key int, highway string, length double, coords array<{P}>")
    writers.write_partitions(pn, pe, str(tmp_path / "p"))
    n, e = readers.read_partitions(spark, str(tmp_path / "p"))
    assert {(r.sub_id, r.node_id, r.distance) for r in n.collect()} == {("1", "5", 2.0), ("1", "T1", writers.NO_DISTANCE), ("22", "8", 1.0), ("3", "9", 4.0)} and (e.first().u, e.first().v, e.first().key) == ("5", "T1", 0)
    writers.write_partitions(pn.limit(0), pe.limit(0), str(tmp_path / "none"))
    assert readers.read_partitions(spark, str(tmp_path / "none"))[0].count() == 0
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(ValueError):
        readers.read_partitions(spark, str(tmp_path / "bad.json"))


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("state: 51\nregion: 999\nmiscellaneous:\n  padding: 0.002\nsecnet:\n  secnet_args:\n    separation: 40.0\n    solver: x\nprimnet:\n  primnet_args:\n    max_feeder_number: 3\n")
    c = load_config(str(tmp_path / "c.yaml"))
    assert c.miscellaneous.padding == 0.002 and c.secnet.separation == 40 and c.primnet.max_feeder_number == 3 and c.secnet.max_hops == Config().secnet.max_hops
    assert transformer_base(51, 999) == 51999000000000000


def test_wkt_and_points(spark):
    df = spark.createDataFrame([("LINESTRING (0 1, 2.5 -3e-5)", "[1, 2.5]"), ("", "nope"), (None, None), ("POINT (1 2)", "(3, 4)")], "w string, c string")
    got = df.select(geo.from_wkt(F.col("w")).alias("p"), geo.parse_point(F.col("c")).alias("q")).collect()
    assert [tuple(x) for x in got[0].p] == [(0.0, 1.0), (2.5, -3e-5)] and got[1].p is None and got[2].p is None and got[3].p is None
    assert tuple(got[0].q) == (1.0, 2.5) and got[1].q is None and tuple(got[3].q) == (3.0, 4.0)


def test_roads_within_the_hull(spark):
    homes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)])], "hid long, lon double, lat double")
    nodes = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 4.0, 2.0), (4, 5.0, 5.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0, None, 9.0, "a"), (2, 3, 0, None, 9.0, "a"), (3, 4, 0, None, 9.0, "a")], "u long, v long, key int, coords array<struct<x:double,y:double>>, length double, highway string")
    inside, kept = readers.clip_roads(nodes, edges, homes)
    assert sorted(r.node_id for r in inside.collect()) == [1, 2]
    assert [(r.u, r.v, [tuple(p) for p in r.coords]) for r in kept.collect()] == [(1, 2, [(1.0, 1.0), (2.0, 2.0)])]
    with pytest.raises(ValueError):
        readers.clip_roads(nodes, edges.where("u = 3"), homes)


def test_secondary_and_network_files(spark, tmp_path):
    t = spark.createDataFrame([("T51", -77.0, 38.0, 12.5)], "transformer_id string, lon double, lat double, load double")
    e = spark.createDataFrame([("T51", "1", 10.0, 7, 8, 0), ("1", "2", 11.5, 7, 8, 0)], "from_node string, to_node string, length double, u long, v long, key int")
    writers.write_secondary(t, e, str(tmp_path / "t"), str(tmp_path / "s"))
    assert [tuple(r) for r in readers.read_transformers(spark, str(tmp_path / "t")).collect()] == [("T51", -77.0, 38.0, 12.5)]
    back = readers.read_secondary(spark, str(tmp_path / "s"))
    assert back.columns == ["from_node", "to_node", "length", "road_start", "road_end", "road_edge_key"]
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in e.collect())
    nodes = spark.createDataFrame([("1", 0.0, 0.0, 0.0, "R"), ("T51", 1.0, 1.0, 12.5, "T")], "node_id string, lon double, lat double, load double, label string")
    edges = spark.createDataFrame([("1", "T51", 0, "road", 5.0, [(0.0, 0.0), (0.5, 0.7), (1.0, 1.0)]), ("T51", "1", 1, None, 6.0, None)], "u string, v string, key int, highway string, length double, coords array<struct<x:double,y:double>>")
    writers.write_network(nodes, edges, str(tmp_path / "n"), str(tmp_path / "e"))
    n, g = readers.read_network(spark, str(tmp_path / "n"), str(tmp_path / "e"))
    assert sorted(tuple(r) for r in n.collect()) == sorted(tuple(r) for r in nodes.collect())
    got = {r.key: (r.u, r.v, r.highway, r.length, [tuple(p) for p in r.coords]) for r in g.collect()}
    assert got == {0: ("1", "T51", "road", 5.0, [(0.0, 0.0), (0.5, 0.7), (1.0, 1.0)]), 1: ("T51", "1", None, 6.0, [(1.0, 1.0), (0.0, 0.0)])}


def test_a_lost_transformer_is_refused(spark, tmp_path):
    from voltweave.operators.primary import check_trees

    nodes = spark.createDataFrame([("5", "S5"), ("5", "1"), ("5", "T1")], "sub_id string, node_id string")
    edges = spark.createDataFrame([("5", "S5", "1"), ("5", "1", "T1")], "sub_id string, source string, target string")
    wanted = spark.createDataFrame([("5", "T1")], "sub_id string, node_id string")
    check_trees(nodes, edges, wanted)
    with pytest.raises(ValueError, match="T2"):
        check_trees(nodes, edges, wanted.union(spark.createDataFrame([("5", "T2")], wanted.schema)))


def test_box_union_and_pairs(spark):
    from voltweave.functions.hull import bounding_box

    points = spark.createDataFrame([(1.0, 2.0), (3.0, -1.0)], "lon double, lat double")
    assert tuple(bounding_box(points, 0.5).first()) == (0.5, -1.5, 3.5, 2.5, 2) and bounding_box(points.limit(0)).first().lon_min is None
    old = spark.createDataFrame([("a", "b", 0, 1.0), ("b", "c", 0, 2.0)], "u string, v string, key int, length double")
    new = spark.createDataFrame([("b", "a", 0, 9.0), ("a", "b", 1, 3.0)], "u string, v string, key int, length double")
    assert sorted(tuple(r) for r in graph.union_edges(old, new).collect()) == [("a", "b", 0, 9.0, 2), ("a", "b", 1, 3.0, 1), ("b", "c", 0, 2.0, 1)]
    sides = spark.createDataFrame([(1, 2, 0, i, 0.001 * i, 0.0, 1) for i in range(11)] + [(3, 4, 0, 20 + i, 0.001 * i, 0.0, 1) for i in range(10)], "u long, v long, key int, hid long, lon double, lat double, side int")
    pairs = secondary.home_pairs(sides, 0.5)
    assert pairs.count() == 45 and pairs.where("u = 1").count() == 0  # a link of eleven homes has none


def test_command_line_builds_a_region_from_files(spark, tmp_path):
    from voltweave.__main__ import main
    from voltweave.sources import fixtures

    sf = "/root/testdata/sf0.001"
    folder = {n: f"{tmp_path}/{n}/" for n in ("load", "logs", "interim", "mapping", "secnet", "primnet")}
    (tmp_path / "load").mkdir()
    homes = fixtures.homes(spark, sf).orderBy("hid").collect()
    head = "hid,longitude,latitude," + ",".join(f"hour{i}" for i in range(1, 25))
    (tmp_path / "load" / "7-home-load.csv").write_text("\n".join([head, *(",".join(map(str, [r.hid, r.lon, r.lat, *r.profile])) for r in homes)]) + "\n")
    subs = fixtures.substations(spark, sf).collect()
    (tmp_path / "subs.csv").write_text("\n".join(["ID,X,Y", *(f"{r.sub_id},{r.lon},{r.lat}" for r in subs)]) + "\n")
    nodes, edges = fixtures.roads(spark, sf)
    writers.write_roads(nodes, edges, f"{folder['interim']}7_road_nodes.csv", f"{folder['interim']}7_road_edges.csv")
    (tmp_path / "c.yaml").write_text(
        f"state: 51\nmin_cell_nodes: 25\ninputs:\n  home_csv_dir: {folder['load']}\n  substation_csv: {tmp_path}/subs.csv\nmiscellaneous:\n  log_dir: {folder['logs']}\n"
        f"  intermediate_dir: {folder['interim']}\n  mapping_dir: {folder['mapping']}\nsecnet:\n  out_dir: {folder['secnet']}\nprimnet:\n  out_dir: {folder['primnet']}\nfigures:\n  directory: {tmp_path}/figs\n"
    )
    main(["-c", f"{tmp_path}/c.yaml", "-r", "7", "-p"])
    assert "all stages done" in (tmp_path / "logs" / "application_7.log").read_text()
    mapped, skipped = readers.read_mapping(spark, readers.load_homes(spark, f"{folder['load']}7-home-load.csv"), f"{folder['mapping']}7_map_h2r.txt")
    assert mapped.count() == len(homes) and skipped == 0
    loads = readers.read_transformers(spark, f"{folder['secnet']}7_transformers.csv").agg(F.sum("load")).first()[0]
    assert loads == pytest.approx(sum(r.load for r in homes))
    labels = {r.label for r in spark.read.option("header", True).csv(f"{folder['primnet']}7_final_edges.csv").select("label").distinct().collect()}
    assert labels == {"feeder", "primary", "secondary"} and spark.read.parquet(f"{tmp_path}/figs/7_node_H").count() == len(homes)


def test_links_of_many_homes_are_solved_in_time():
    rng = np.random.default_rng(3)
    n = 1500  # all candidate places of every home took minutes
    homes = pd.DataFrame({"link": 1, "hid": np.arange(n), "lon": -77 + rng.random(n) * 0.003, "lat": 38 + rng.random(n) * 0.003, "load": 1.0, "side": rng.choice([1, -1], n), "d0": rng.random(n) * 200})
    start = time.process_time()
    got = secondary._solve_links(homes, Secondary())
    assert time.process_time() - start < 20
    assert sorted(got["hid"]) == list(range(n)) and set(got["status"]) == {"heuristic"}
    assert got.groupby("path").size().max() <= Secondary().max_hops and got["bound"][0] <= got["cost"][0] <= homes["d0"].sum()


def test_sparse_cover_is_a_local_optimum():
    rng = np.random.default_rng(5)
    points = rng.integers(0, [12, 9], (40, 2)).astype(float)
    points = np.unique(points, axis=0)
    cost = np.full((len(points),) * 2, np.inf)
    for i, j in secondary.delaunay(points):
        cost[i, j] = cost[j, i] = np.hypot(*(points[i] - points[j]))
    start, load = rng.random(len(points)) * 5, np.ones(len(points))
    paths = secondary.savings_cover(cost, start, load, 6.0, 6)
    price = lambda own: start[own[0]] + sum(cost[a, b] for a, b in zip(own, own[1:])) if own else 0.0
    for a in paths:
        for i in a:
            rest = [k for k in a if k != i]
            for b in [[], *(p for p in paths if p is not a and len(p) < 6), rest]:
                least = min(price([*b[:at], i, *b[at:]]) for at in range(len(b) + 1))
                assert price(rest) == math.inf or price(a) - price(rest) - (least - price(b)) < 1e-6


def test_homes_box_leaves_far_roads_out(spark):
    homes = spark.createDataFrame([(1, 0.0, 38.0), (2, 0.01, 38.01)], "hid long, lon double, lat double")
    roads = spark.createDataFrame([(1, 2, 0, [(0.011, 38.0), (0.02, 38.0)], 1.0, "r"), (3, 4, 0, [(0.5, 38.0), (0.6, 38.0)], 1.0, "r"), (5, 6, 0, [(-1.0, 37.0), (1.0, 39.0)], 1.0, "r")], EDGES)
    assert sorted(r.u for r in mapping.around(homes, roads, 0.002).collect()) == [1, 5]
    mapped = mapping.map_homes(homes, roads, 0.001)
    assert sorted((r.hid, r.u, r.pad_level) for r in mapped.collect()) == [(1, 5, 0), (2, 5, 0)]


@pytest.mark.parametrize("seed", range(8))
def test_nearest_over_numbers_is_dijkstra(seed):
    rng = np.random.default_rng(seed)
    n, m = 30, 50
    u, v = rng.integers(0, n, (2, m))
    w = rng.integers(1, 4, m).astype(float) if seed % 2 else rng.random(m) + 0.01
    seeds, names = np.unique(rng.integers(0, n, 4)), np.array([f"{i:02d}" for i in range(n)])
    dist, centre = graph.nearest(u, v, w, n, seeds)
    want = graph.dijkstra(names[u], names[v], w, names[seeds].tolist())
    assert {names[i]: (pytest.approx(dist[i]), names[seeds[centre[i]]]) for i in np.flatnonzero(np.isfinite(dist))} == want


def test_cells_of_a_long_region_take_one_task():
    h, w = 5000, 40  # rounds of joins took as many rounds as the region is long
    ids = np.arange(h * w).reshape(h, w)
    u, v = np.concatenate([ids[:, :-1].ravel(), ids[:-1].ravel()]), np.concatenate([ids[:, 1:].ravel(), ids[1:].ravel()])
    start = time.process_time()
    dist, centre = graph.nearest(u, v, np.full(len(u), 100.0), h * w, np.array([0, 39]))
    assert time.process_time() - start < 20
    assert dist.max() == 100.0 * (h - 1 + 19) and (centre == 0).sum() == h * 20
    assert graph.TASK_EDGES >= 2_400_000


def test_betweenness_keeps_few_pairs():
    n = 700  # a ladder
    a = np.concatenate([np.arange(n - 2), np.arange(0, n, 2)])
    b = np.concatenate([np.arange(2, n), np.arange(1, n, 2)])
    want = graph.edge_betweenness(n, a, b)
    tracemalloc.start()
    got = graph.edge_betweenness(n, a, b, 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want) and peak < 4_000_000  # one n x n array has 3.9 MB
    assert got[n // 2 - 1] == pytest.approx(want.max(), rel=0.02)


def test_links_of_few_homes_alone_get_the_same_lines(spark):
    road = [(k, k + 1, [(0.01 * k, 0.0), (0.01 * k + 0.002, 0.0)]) for k in (1, 3, 5, 7)]
    own = [(k, i) for k, many in ((1, 1), (3, 3), (5, 4), (7, 12)) for i in range(many)]
    homes = spark.createDataFrame([(100 * k + i, 0.01 * k + 0.0001 * i, 0.0002, 100.0 + i) for k, i in own], "hid long, lon double, lat double, load double")
    m = spark.createDataFrame([(100 * k + i, k, k + 1, 0) for k, i in own], "hid long, u long, v long, key int")
    edges = road_frame(spark, road)
    whole = secondary.build(m, homes, edges, Secondary(), 100)["design"].collect()
    for most, links in ((1, {1}), (3, {1, 3}), (4, {1, 3, 5})):
        few = secondary.build(m, homes, edges, Secondary(), 100, most_homes=most)
        assert {r.u for r in few["sides"].collect()} == links  # the others never reach the solver
        assert sorted(few["design"].collect()) == sorted(r for r in whole if r.u in links)


def test_queries_of_small_links_solve_no_others(spark, monkeypatch):
    from voltweave.plans import network, queries

    asked = []
    stage = network.secondary_stage

    def told(*args):
        asked.append(args[4:])
        return stage(*args)

    monkeypatch.setattr(network, "secondary_stage", told)
    rows = queries.small_link_costs(spark, "/root/testdata/sf0.001").collect()
    assert asked == [(("design",), 3)] and rows and max(r.homes for r in rows) <= 3


def test_transformer_loads_make_no_other_table(spark, monkeypatch):
    from voltweave.plans import network, queries

    kept = []
    keep = network.Store.keep
    monkeypatch.setattr(network.Store, "keep", lambda self, name, make: kept.append(name) or keep(self, name, make))
    rows = queries.transformer_loads(spark, "/root/testdata/sf0.001").collect()
    assert kept == ["mapping", "secondary_transformers"]
    whole = queries.home_peak_load(spark, "/root/testdata/sf0.001").agg(F.sum("load")).first()[0]
    assert sum(r.load for r in rows) == pytest.approx(whole, rel=1e-6)


def strip(h, w):
    ids = np.arange(h * w).reshape(h, w)
    return h * w, np.concatenate([ids[:, :-1].ravel(), ids[:-1].ravel()]), np.concatenate([ids[:, 1:].ravel(), ids[1:].ravel()])


@pytest.mark.parametrize("seed", range(12))
def test_betweenness_by_cuts_is_that_of_all_searches(seed):
    rng = np.random.default_rng(seed)
    n, a, b = strip(int(rng.integers(4, 40)), int(rng.integers(1, 5)))
    keep = rng.random(len(a)) < 0.6 + 0.1 * (seed % 5)  # with holes, dead ends and several pieces
    far = rng.integers(0, n, (2, seed % 4))
    a, b = np.concatenate([a[keep], far[0]]), np.concatenate([b[keep], far[1]])
    a, b = rng.permutation(n)[np.array([a, b])][:, a != b]
    want = graph.edge_betweenness(n, a, b, stretch=n)  # a search from every node
    for limits in ({"stretch": 4}, {"stretch": 1, "layer": 60}, {"stretch": 3, "layer": 3, "pairs": 50}):
        assert np.allclose(graph.edge_betweenness(n, a, b, **limits), want, rtol=1e-12, atol=1e-12)
    pairs = graph._Walks(n, a, b, n * n).reach(np.arange(n), np.arange(n))[0]
    assert want.sum() == pytest.approx(pairs[pairs > 0].sum() / 2)  # a path of d edges adds one to d of them


def test_betweenness_of_a_long_strip_in_time():
    n, a, b = strip(1200, 8)
    start = time.process_time()
    flow = graph.edge_betweenness(n, a, b)
    assert time.process_time() - start < 10  # a search from every node takes several times as long
    middle = flow[1200 * 7 + 8 * 599 :][:8]  # edges along rows come first
    assert middle.sum() == pytest.approx((n / 2) ** 2) and middle.max() == pytest.approx(flow.max())


def test_betweenness_of_a_hub_keeps_few_pairs():
    n = 1500
    tracemalloc.start()
    flow = graph.edge_betweenness(n, np.zeros(n - 1, int), np.arange(1, n), 100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (flow == n - 1).all() and peak < 30_000_000  # a row of neighbours as long as the hub's for each pair: gigabytes


def test_long_cell_with_its_load_at_one_end_is_split_in_time():
    n, a, b = strip(600, 8)
    load = np.where(np.arange(n) < 320, 1000.0, 0.0)
    start = time.process_time()
    community, over = graph.split(n, a, b, load, 200.0)
    assert time.process_time() - start < 33  # a search from every node: 42 s where this takes 11 s
    assert not over.any() and 1e-3 * np.bincount(community, load).max() < 200
    inside = community[a] == community[b]
    assert len(np.unique(graph._pieces(n, a[inside], b[inside]))) == community.max() + 1  # each in one piece


@pytest.mark.parametrize("seed", range(12))
def test_busiest_edge_is_that_of_all_searches(seed):
    rng = np.random.default_rng(100 + seed)
    n, a, b = strip(int(rng.integers(8, 60)), int(rng.integers(1, 6)))
    keep = rng.random(len(a)) < 0.7 + 0.1 * (seed % 4)  # with holes, dead ends and several pieces; whole: many ties
    far = rng.integers(0, n, (2, seed % 3))
    a, b = np.concatenate([a[keep], far[0]]), np.concatenate([b[keep], far[1]])
    a, b = rng.permutation(n)[np.array([a, b])][:, a != b]
    for _ in range(4):
        flow = graph.edge_betweenness(n, a, b, stretch=n)  # a search from every node
        want = np.flatnonzero(flow >= flow.max() * (1 - 1e-9))[0]
        for limits in ({}, {"stretch": 4}, {"stretch": 1, "layer": 60}, {"stretch": 3, "layer": 3, "pairs": 50}):
            assert graph.busiest(n, a, b, **limits) == want
        a, b = np.delete(a, want), np.delete(b, want)


def test_layers_are_no_wider_than_their_spread():
    rng = np.random.default_rng(3)
    n, a, b = strip(40, 5)
    keep = rng.random(len(a)) < 0.8
    a, b = a[keep], b[keep]
    cuts = graph._Cuts(n, a, b, n * n, 4, 24)
    dist = graph._Walks(n, a, b, n * n).reach(np.arange(n), np.arange(n))[0]
    for limits in ({}, {"every": 3, "deepest": 4}):
        spread = cuts.spread(**limits)
        for k, most in enumerate(spread):
            own = cuts.order[cuts.first[k] : cuts.first[k + 1]]
            assert dist[np.ix_(own, own)].max() <= most


def test_long_strip_is_parted_by_the_paths_near_its_middle():
    n, a, b = strip(3000, 3)
    a, b = np.random.default_rng(1).permutation(n)[np.array([a, b])]
    start = time.process_time()
    label = graph.girvan_newman(n, a, b)
    assert time.process_time() - start < 7  # with the paths of all pairs counted for each edge removed: 14 s where this takes 2.2 s
    assert np.unique(label, return_counts=True)[1].tolist() == [n // 2, n // 2]


def test_components_in_a_task_and_by_rounds(spark):
    rng = np.random.default_rng(2)
    nodes = spark.createDataFrame([(r, f"n{i}") for r in (0, 1) for i in range(60)], "region int, node_id string")
    ends = [(r, *(f"n{x}" for x in rng.integers(0, 62, 2))) for r in (0, 1) for _ in range(45)]  # n60 and n61 are no nodes
    edges = spark.createDataFrame([*ends, (0, None, "n1")], "region int, u string, v string")
    want = {tuple(r) for r in graph.components(nodes, edges, ["region"], 10).collect()}
    assert {tuple(r) for r in graph.components(nodes, edges, ["region"]).collect()} == want and len(want) == 120
    n = 300_000  # one long road; rounds of joins took one for each doubling
    order = rng.permutation(n)
    assert (graph.joined(order[:-1], order[1:], n) == 0).all()


def plain_bound(f):
    """The table of all shortest distances between transformers and substation, and the smallest tree over it."""
    n, points = f.n + 1, [*f.terminals, f.n]
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in [*f.edges, *((f.n, i, c) for i, c in enumerate(f.root_cost))]:
        d[a, b] = d[b, a] = min(d[a, b], w)
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[k])
    d, total = d[np.ix_(points, points)], 0.0
    near, left = d[-1, :-1], set(range(len(points) - 1))
    while left:
        i = min(left, key=lambda k: near[k])
        total += near[i]
        left.remove(i)
        near = np.minimum(near, d[i, :-1])
    return total / 2


@pytest.mark.parametrize("seed", range(15))
def test_bound_is_half_the_smallest_tree(seed):
    rng = np.random.default_rng(seed)
    n = 40
    edges = [(i, int(rng.integers(max(0, i - 6), i)), float(rng.uniform(0, 1))) for i in range(1, n)] + [(int(a), int(a + s), float(rng.uniform(0, 1))) for a, s in rng.integers(1, 20, (30, 2))]
    load = np.where(rng.random(n) < 0.3, 100.0, 0.0)
    load[7] = 100.0
    f = primary.Feeder(n, edges, load, np.where((load > 0) | (rng.random(n) < 0.5), np.inf, rng.uniform(0, 3, n)), Primary())
    assert f.bound() == pytest.approx(plain_bound(f), rel=1e-12)
    cut_off = primary.Feeder(n + 1, edges, np.append(load, 50.0), np.append(f.root_cost, np.inf), Primary())
    assert cut_off.bound() == plain_bound(cut_off) == math.inf


def test_bound_of_many_transformers_keeps_no_table_of_pairs():
    n = 2000
    load = np.ones(n)
    load[0] = 0
    f = primary.Feeder(n, [(i, i + 1, 0.5) for i in range(n - 1)], load, np.where(load > 0, np.inf, 1.0), Primary())
    tracemalloc.start()
    bound = f.bound()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bound == pytest.approx((1 + (n - 1) * 0.5) / 2) and peak < 8_000_000  # a table of all pairs has 32 MB


def test_edges_of_a_cell_by_places():
    names = pd.Series(["a", "b", "c", "d"])
    a, b = graph.simple_edges(names, pd.Series(["c", "a", "b", "d", "d"]), pd.Series(["a", "c", "a", "d", "b"]))
    assert [*zip(a.tolist(), b.tolist(), strict=True)] == [(0, 1), (0, 2), (1, 3)]
    assert [len(x) for x in graph.simple_edges(names, names[:0], names[:0])] == [0, 0]
    with pytest.raises(KeyError):
        graph.simple_edges(names, pd.Series(["a"]), pd.Series(["x"]))
    names = pd.Series(np.char.mod("%07d", np.arange(100_000)))
    tracemalloc.start()
    a, b = graph.simple_edges(names, names[:-1], names[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 99_999 and (b == a + 1).all() and peak < 12_000_000  # a dict and a set of tuples: 18 MB
