"""Graphs that the kernel's lists used to refuse, and its arrays against its searches by heap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import requests
from ridgeline.plans import kernel, search
from ridgeline.plans.kernel import INFINITE, Graph
from tests.test_kernel import random_graph

#: A ladder without rungs, both ways: more directed edges than were searched in memory before.
NODES = 1_550_000


@pytest.fixture(scope="module")
def long_road(spark):
    way = spark.range(NODES).select(F.explode(F.array(F.struct((F.col("id") * 2).alias("did"), F.col("id").alias("u"), (F.col("id") + 1).alias("v")), F.struct((F.col("id") * 2 + 1).alias("did"), (F.col("id") + 1).alias("u"), F.col("id").alias("v")))).alias("e"))
    directed = way.select("e.*", F.lit(10).cast("long").alias("length"), (F.col("e.did") % 5).alias("elevation"))
    return directed, spark.createDataFrame([(0, 2), (60, 61)], "from_did long, to_did long")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(0, 5, 25, 1.5), (1, 40, 30, 1.5)], "request_id long, source long, target long, ratio double")


@pytest.mark.parametrize("few, many", [(0, 1), (16, 64), (1 << 30, 1 << 31)])
@pytest.mark.parametrize("seed", range(12))
def test_maps_agree_with_heaps(seed, few, many, monkeypatch):
    monkeypatch.setattr(kernel, "FEW", few)
    monkeypatch.setattr(kernel, "MANY", many)
    graph = random_graph(seed, 24 + 9 * seed, 70 + 25 * seed)
    plain = lambda found: {int(k): int(found[k]) for k in np.flatnonzero(found < INFINITE)}
    for weight in ("length", "elevation"):
        for reverse in (False, True):
            for bound in (60, INFINITE):
                assert plain(graph.map_of_nodes(1, weight, reverse, bound)) == graph.from_node(1, weight, reverse, bound)[0]
                assert plain(graph.map_of_edges(1, weight, reverse, bound)) == graph.from_edges(1, weight, reverse, bound)[0]


def test_a_graph_is_arrays_that_are_shared():
    graph = random_graph(5, 3000, 9000, 500)
    again = Graph.of(graph.columns)
    assert sum(c.nbytes for c in graph.columns) <= 44 * len(graph.did)
    assert all(a is b for a, b in zip(graph.columns, again.columns))
    assert again.from_edges(0)[0] == graph.from_edges(0)[0]


def test_ga_maximize(asked, long_road):
    """F1."""
    directed, banned = long_road
    found = search.routes(requests.of_type(asked, search.MOST, 1.5, 2, False), directed, None, epochs=2)
    got = {r.request_id: (r.found, r.length) for r in found.collect()}
    assert got[0][0] and got[1][0] and 200 <= got[0][1] <= 300 and 100 <= got[1][1] <= 150


def test_ga_maximize_turns(asked, long_road):
    """F2."""
    directed, banned = long_road
    found = search.routes(requests.of_type(asked, search.MOST, 1.5, 1, True), directed, banned, epochs=2)
    got = {r.request_id: (r.found, r.length) for r in found.collect()}
    assert got[0][0] and got[1][0] and 200 <= got[0][1] <= 300 and 100 <= got[1][1] <= 150


def test_ga_minimize(asked, long_road):
    """F3."""
    directed, banned = long_road
    found = search.routes(requests.of_type(asked, search.LEAST, 1.5, 1, False), directed, None, epochs=2)
    got = {r.request_id: (r.found, r.length) for r in found.collect()}
    assert got[0][0] and got[1][0] and got[0][1] == 200 and got[1][1] == 100


def test_min_elevation_cost(asked, long_road):
    """F4."""
    found = search.least_elevation(asked, long_road[0])
    assert {r.request_id: (r.length, r.elevation) for r in found.collect()}[0] == (200, sum(2 * k % 5 for k in range(5, 25)))


def test_min_elevation_turns(asked, long_road):
    """F5."""
    found = search.least_elevation(asked, *long_road)
    assert {r.request_id: (r.length, r.elevation) for r in found.collect()}[0] == (200, sum(2 * k % 5 for k in range(5, 25)))


def test_build_load(long_road):
    """the component that loading keeps, without banned turns."""
    directed, banned = long_road
    assert search.largest_component(directed, banned.limit(0)).count() == 2 * NODES


def test_route_batch(spark, long_road):
    """legs of several types in one call."""
    legs = spark.createDataFrame([(k, 5, 25, k, 1.5, 0, True) for k in range(3)], "request_id long, source long, target long, path_type int, ratio double, duplicates int, turns boolean")
    got = {r.request_id: (r.found, r.length) for r in search.routes(legs, *long_road, epochs=2).collect()}
    assert got[0] == (True, 200) and got[1] == (True, 200) and 200 <= got[2][1] <= 300


def test_route_function(spark, asked, long_road):
    """F8."""
    search.register(spark, "long_route", long_road[0])
    rows = spark.sql("select q.request_id, r.length from {asked} q, lateral long_route(q.source, q.target, 0, 1.0D, 0, false) r", asked=asked)
    assert {r.request_id: r.length for r in rows.collect()} == {0: 200, 1: 100}


def test_reachable_edges(asked, long_road):
    """as far beyond an end as half the bound's surplus; edge 0 leads nowhere, for 2 may not follow it."""
    got = sorted(r.did for r in search.reachable_edges(asked, *long_road).where("request_id = 0").collect())
    assert got == list(range(2, 60))


def test_farthest_node(asked, long_road):
    """F10."""
    got = {r.request_id: r.dist for r in search.farthest(search.distances(asked, long_road[0])).collect()}
    assert got == {0: 10 * (NODES - 5), 1: 10 * (NODES - 40)}


def test_shortest_path_turns(asked, long_road):
    """F11."""
    directed, banned = long_road
    found = search.routes(requests.of_type(asked, search.SHORTEST, 1.5, 1, True), directed, banned, epochs=2)
    got = {r.request_id: (r.found, r.length) for r in found.collect()}
    assert got[0][0] and got[1][0] and got[0][1] == 200 and got[1][1] == 100


def test_scc_largest(long_road):
    """edge 0 may not be followed by edge 2, nor 60 by 61; the road's other turns join all else."""
    kept = search.largest_component(*long_road)
    assert kept.count() > 2 * NODES - 70 and kept.select("did").distinct().count() == kept.count()


def test_reachable_nodes(asked, long_road):
    """as far beyond an end as half the bound's surplus."""
    got = sorted(map(tuple, search.reachable_nodes(asked, long_road[0]).collect()))
    assert got == [(0, k) for k in range(0, 31)] + [(1, k) for k in range(28, 43)]


def test_shortest_path(asked, long_road):
    """F14."""
    got = {r.request_id: (r.length, list(r.edges)) for r in search.a_star(asked, long_road[0]).collect()}
    assert got == {0: (200, [2 * k for k in range(5, 25)]), 1: (100, [2 * k + 1 for k in range(39, 29, -1)])}


def test_sssp_length(asked, long_road):
    """F15."""
    found = search.distances(asked, long_road[0], "length", False).groupBy("request_id").agg(F.count("*").alias("n"), F.sum("dist").alias("total"))
    got = {r.request_id: (r.n, r.total) for r in found.collect()}
    assert got == {k: (NODES + 1, 10 * (s * (s + 1) // 2 + (NODES - s) * (NODES - s + 1) // 2)) for k, s in ((0, 5), (1, 40))}


def test_sssp_elevation(asked, long_road):
    """F16."""
    found = search.distances(asked, long_road[0], "elevation", False).groupBy("request_id").agg(F.count("*").alias("n"), F.sum("dist").alias("total"))
    got = {r.request_id: (r.n, r.total) for r in found.collect()}
    assert got == {k: (NODES + 1, sum((2 * j + 1) % 5 * (j + 1) for j in range(s)) + sum(2 * j % 5 * (NODES - j) for j in range(s, NODES))) for k, s in ((0, 5), (1, 40))}


def test_sssp_reverse(asked, long_road):
    """F17."""
    found = search.distances(asked, long_road[0], "length", True).groupBy("request_id").agg(F.count("*").alias("n"), F.sum("dist").alias("total"))
    got = {r.request_id: (r.n, r.total) for r in found.collect()}
    assert got == {k: (NODES + 1, 10 * (s * (s + 1) // 2 + (NODES - s) * (NODES - s + 1) // 2)) for k, s in ((0, 5), (1, 40))}


def test_sssp_turns(asked, long_road):
    """on from 5 all edges are met; back over the start, too, but for those that only banned turns lead to."""
    found = search.edge_distances(asked.limit(1), *long_road).agg(F.count("*").alias("n"), F.max("dist").alias("far")).first()
    assert found.n > 2 * NODES - 70 and found.far >= 10 * (NODES - 5)
