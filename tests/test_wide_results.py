"""What a kernel call returns may be as long as the graph, whatever Spark expects of it."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import queries
from ridgeline.operators import profiles
from ridgeline.plans import build, search
from ridgeline.plans.kernel import Graph
from ridgeline.plans.storage import Store


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ring(spark):
    directed = spark.range(50).select(F.col("id").alias("did"), "id", F.col("id").alias("u"), ((F.col("id") + 1) % 50).alias("v"), F.lit(7).alias("length"), F.lit(1).alias("elevation"))
    return directed, spark.createDataFrame([], "from_did long, to_did long")


def test_scc_largest(ring):
    """the component's edges are not broadcast."""
    kept = search.largest_component(*ring)
    assert "BroadcastExchange" not in plan(kept)
    assert sorted(r.did for r in kept.collect()) == list(range(50))


def sends(monkeypatch, run) -> int:
    count, send = [], search.send
    monkeypatch.setattr(search, "send", lambda *tables: (count.append(1), send(*tables))[1])
    run()
    return len(count)


def test_ga_maximize_turns(spark, folder, monkeypatch):
    """one graph for the routes and the shortest paths beside them."""
    assert sends(monkeypatch, lambda: queries.ga_maximize_turns(spark, folder)) == 1


def test_build_load(spark, monkeypatch):
    """nor are they while a graph is loaded."""
    plans, put = {}, Store.put
    monkeypatch.setattr(Store, "put", lambda self, name, df: (plans.__setitem__(name, plan(df)), put(self, name, df))[1])
    nodes = spark.range(50).select("id", F.lit(0.5).alias("lon"), F.lit(0.5).alias("lat"), F.lit(1).alias("elevation"), F.lit("residential").alias("type"), F.lit("accept").alias("hiking"), F.lit("accept").alias("cycling"))
    edges = spark.range(49).select("id", F.lit("residential").alias("type"), F.lit(0).cast("short").alias("oneway"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(3.5).cast("float").alias("length"), F.lit(1).alias("elevation"), F.lit("accept").alias("hiking"), F.lit("accept").alias("cycling"), F.array().cast("array<struct<lon: double, lat: double>>").alias("geom"))
    turns = spark.createDataFrame([], "relation_id long, restriction string, conditional string, via_type string, from_id long, via_id long, to_id long, type_enum string")
    found = build.load({"nodes": nodes, "edges": edges, "restrictions": turns}, profiles.Profile.HIKING)
    assert found["directed"].count() == 98
    assert "BroadcastExchange" not in plans["kept"]


def test_ga_minimize(spark, folder, monkeypatch):
    """the same, and the routes are searched once."""
    found = []
    monkeypatch.setattr(queries.paths, "audit", lambda routes, *rest: found.append(routes))
    assert sends(monkeypatch, lambda: queries.ga_minimize(spark, folder)) == 1
    assert "MapInPandas" not in plan(found[0]) and found[0].count() == 6


def test_route_batch(spark, ring):
    """a search that time bounds is one search, however often its paths are read."""
    legs = spark.createDataFrame([(0, 3, 9, search.MOST, 1.5, 0, True)], "request_id long, source long, target long, path_type int, ratio double, duplicates int, turns boolean")
    found = search.routes(legs, *ring, milliseconds=1.0)
    assert "MapInPandas" not in plan(found) and [r.length for r in found.collect()] == [42]


def test_shortest_path(spark, ring, monkeypatch):
    """the graph is counted once, and its paths are searched once."""
    counted, fits = [], search.fits
    monkeypatch.setattr(search, "fits", lambda *a: (counted.append(1), fits(*a))[1])
    found = search.a_star(spark.createDataFrame([(0, 3, 9)], "request_id long, source long, target long"), ring[0])
    assert len(counted) == 1 and "MapInPandas" not in plan(found) and [r.length for r in found.collect()] == [42]


def test_columns_are_sent_narrow(ring):
    """The driver holds 32 bits of a number where they are enough."""
    assert {c.dtype.itemsize for c in search._columns(ring[0].select("did", "u", "v"))} == {4}
    assert search._columns(ring[0].select((F.col("did") + (1 << 40)).alias("did")))[0].tolist() == [k + (1 << 40) for k in range(50)]


def test_a_graph_is_built_in_little_memory():
    """The same findings: columns are not widened while a graph is built."""
    n = 200_000
    u = np.arange(n, dtype=np.int32)
    tracemalloc.start()
    graph = Graph(u, u, (u + 1) % n, u % 100, u % 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * n and graph.map_of_nodes(0).max() == int((u[:-1] % 100).sum())
