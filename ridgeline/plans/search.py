"""Path search over DataFrames of requests.

A graph whose edges number at most ``KERNEL_EDGES`` (they are counted) goes to every task as arrays, and each request
is one kernel call: requests are spread over tasks and nothing else moves. Larger graphs are searched in
DataFrame rounds over the frontier, all requests at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.plans.kernel import INFINITE, Duplicates, Graph, narrow
from ridgeline.plans.storage import Store

#: An edge has 28 to 44 bytes in a broadcast and in a worker (arrays that both halves of the search share), a search at
#: most about 100 more while it runs (estimated); as lists an edge had a few hundred, and the limit was 3,000,000.
KERNEL_EDGES = 10_000_000
#: Rows of a map that a worker sends at once.
MAP_ROWS = 1 << 17


def fits(directed: DataFrame, most: int = KERNEL_EDGES) -> bool:
    return directed.count() <= most


def fit_or_refuse(what: str, directed: DataFrame, banned: DataFrame | None) -> None:
    """Both tables are counted before anything of them goes to the driver."""
    if not fits(directed) or not (banned is None or fits(banned)):
        raise ValueError(f"{what} needs a graph of at most {KERNEL_EDGES} directed edges and banned turns; cut out the region of the requests")


def send(directed: DataFrame, banned: DataFrame | None = None):
    """A broadcast of the kernel's arrays under a name of their own; call only after fits() of both tables."""
    spark = directed.sparkSession
    edges = _columns(directed.select("did", "u", "v", F.col("length").cast("long"), F.col("elevation").cast("long")))
    pairs = np.stack(_columns(banned.select("from_did", "to_did")), 1) if banned is not None else ()
    return spark.sparkContext.broadcast((uuid.uuid4().hex, Graph(*edges, banned=pairs).columns))


def _columns(table: DataFrame) -> list[np.ndarray]:
    """Columns of whole numbers, in 32 bits where they fit; what they were read from is given back."""
    rows = table.toArrow()
    columns = [narrow(np.asarray(c.to_numpy(), np.int64)) for c in rows.columns]
    del rows
    pa.default_memory_pool().release_unused()
    return columns


def prepared(what: str, directed: DataFrame, banned: DataFrame | None = None):
    """The graph, counted and sent; for several searches over the same tables."""
    fit_or_refuse(what, directed, banned)
    return send(directed, banned)


_GRAPHS: dict[str, Graph] = {}


def received(shared) -> Graph:
    """The kernel's graph, one for each worker and broadcast."""
    name, columns = shared.value
    if name not in _GRAPHS:
        _GRAPHS.clear()
        _GRAPHS[name] = Graph.of(columns)
    return _GRAPHS[name]


def spread(requests: DataFrame) -> DataFrame:
    """Requests dealt over all cores: each is much work and few bytes."""
    spark: SparkSession = requests.sparkSession
    return requests.repartition(max(2, spark.sparkContext.defaultParallelism))


def _kernel(requests: DataFrame, shared, schema: str, one: Callable[[Graph, object], Iterator[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = received(shared)
        for batch in batches:
            for request in batch.itertuples(index=False):
                rows = list(one(graph, request))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spread(requests).mapInPandas(run, schema)


def _maps(requests: DataFrame, shared, schema: str, one: Callable[[Graph, object], tuple[np.ndarray, ...] | None]) -> DataFrame:
    """The same where a request has many rows: one gives their columns after the request's id, as arrays."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = received(shared)
        for batch in batches:
            for request in batch.itertuples(index=False):
                columns = one(graph, request)
                for k in range(0, len(columns[0]) if columns is not None else 0, MAP_ROWS):
                    part = [c[k : k + MAP_ROWS] for c in columns]
                    yield pd.DataFrame(dict(zip(names, [np.full(len(part[0]), request.request_id, np.int64), *part])))

    return spread(requests).mapInPandas(run, schema)


def distances(requests: DataFrame, directed: DataFrame, weight: str = "length", reverse: bool = False, bound: int | None = None) -> DataFrame:
    """(request_id, node, dist) for every node that a request's source reaches (or that reaches it), within bound."""
    if not fits(directed):
        return distances_in_rounds(requests, directed, weight, reverse, bound)

    def one(graph: Graph, r) -> tuple[np.ndarray, ...] | None:
        source = graph.node(r.source)
        if source is None:
            return None
        found = graph.map_of_nodes(source, weight, reverse, INFINITE if bound is None else bound)
        at = np.flatnonzero(found < INFINITE)
        return graph.nodes[at], found[at]

    return _maps(requests.select("request_id", "source"), send(directed), "request_id long, node long, dist long", one)


def edge_distances(requests: DataFrame, directed: DataFrame, banned: DataFrame, weight: str = "length", reverse: bool = False, bound: int | None = None) -> DataFrame:
    """(request_id, did, dist): the same on directed edges without banned turns; a distance holds its own edge."""
    if not fits(directed) or not fits(banned):
        return edge_distances_in_rounds(requests, directed, banned, weight, reverse, bound)

    def one(graph: Graph, r) -> tuple[np.ndarray, ...] | None:
        source = graph.node(r.source)
        if source is None:
            return None
        found = graph.map_of_edges(source, weight, reverse, INFINITE if bound is None else bound)
        at = np.flatnonzero(found < INFINITE)
        return graph.did[at], found[at]

    return _maps(requests.select("request_id", "source"), send(directed, banned), "request_id long, did long, dist long", one)


def _rounds(start: DataFrame, edges: DataFrame, bound: int | None) -> DataFrame:
    """Min-plus rounds: only states that got nearer in the last round go on. edges: (state, next, cost)."""
    store = Store(start.sparkSession, "rounds")
    settled = store.put("settled0", start.groupBy("request_id", "state").agg(F.min("dist").alias("dist")))
    frontier, turn = settled, 0
    while not frontier.isEmpty():
        turn += 1
        offered = frontier.join(edges, "state").select("request_id", F.col("next").alias("state"), (F.col("dist") + F.col("cost")).alias("dist"))
        if bound is not None:
            offered = offered.where(F.col("dist") <= bound)
        offered = offered.groupBy("request_id", "state").agg(F.min("dist").alias("dist"))
        known = settled.withColumnRenamed("dist", "old")
        frontier = store.put(f"frontier{turn}", offered.join(known, ["request_id", "state"], "left").where("old is null or dist < old").select("request_id", "state", "dist"))
        settled = store.put(f"settled{turn}", settled.unionByName(frontier).groupBy("request_id", "state").agg(F.min("dist").alias("dist")))
        if turn > 1:
            store.drop(f"frontier{turn - 1}")
        store.drop(f"settled{turn - 1}")
    return settled


def distances_in_rounds(requests: DataFrame, directed: DataFrame, weight: str = "length", reverse: bool = False, bound: int | None = None) -> DataFrame:
    tail, head = ("v", "u") if reverse else ("u", "v")
    edges = directed.select(F.col(tail).alias("state"), F.col(head).alias("next"), F.col(weight).cast("long").alias("cost"))
    known = directed.select(F.explode(F.array("u", "v")).alias("source")).distinct()
    start = requests.join(known, "source", "left_semi").select("request_id", F.col("source").alias("state"), F.lit(0).cast("long").alias("dist"))
    return _rounds(start, edges, bound).withColumnRenamed("state", "node")


def edge_distances_in_rounds(requests: DataFrame, directed: DataFrame, banned: DataFrame, weight: str = "length", reverse: bool = False, bound: int | None = None) -> DataFrame:
    from ridgeline.operators.restrictions import allowed_turns

    turns = allowed_turns(directed, banned)
    tail, head = ("to_did", "from_did") if reverse else ("from_did", "to_did")
    cost = directed.select(F.col("did").alias("next"), F.col(weight).cast("long").alias("cost"))
    edges = turns.select(F.col(tail).alias("state"), F.col(head).alias("next")).join(cost, "next")
    first = directed.select(F.col("v" if reverse else "u").alias("source"), F.col("did").alias("state"), F.col(weight).cast("long").alias("dist"))
    start = requests.join(first, "source").select("request_id", "state", "dist")
    if bound is not None:
        start = start.where(F.col("dist") <= bound)
    return _rounds(start, edges, bound).withColumnRenamed("state", "did")


def reachable_nodes(requests: DataFrame, directed: DataFrame) -> DataFrame:
    """(request_id, node): nodes on some walk from source to target within ratio times the shortest length.

    One kernel call for each request; on larger graphs two searches in rounds and a join of their distances: the detour
    through a node is known from both.
    """
    if fits(directed):

        def one(graph: Graph, r) -> tuple[np.ndarray, ...] | None:
            source, target = graph.node(r.source), graph.node(r.target)
            least = graph.from_node(source, target=target)[0].get(target) if source is not None and target is not None else None
            return None if least is None else (graph.nodes[graph.flags_of_nodes(source, target, bounded(least, r.ratio))],)

        return _maps(requests.select("request_id", "source", "target", "ratio"), send(directed), "request_id long, node long", one)
    there = distances_in_rounds(requests, directed)
    back = distances_in_rounds(requests.select("request_id", F.col("target").alias("source")), directed, reverse=True).withColumnRenamed("dist", "rest")
    both = there.join(back, ["request_id", "node"])
    return _within(both, requests, there.join(requests.select("request_id", F.col("target").alias("node")), ["request_id", "node"]).select("request_id", F.col("dist").alias("least")), F.col("dist") + F.col("rest")).select("request_id", "node")


def reachable_edges(requests: DataFrame, directed: DataFrame, banned: DataFrame) -> DataFrame:
    """(request_id, did): the same for directed edges without banned turns."""
    if fits(directed) and fits(banned):

        def one(graph: Graph, r) -> tuple[np.ndarray, ...] | None:
            source, target = graph.node(r.source), graph.node(r.target)
            dist, _, last = graph.from_edges(source, target=target) if source is not None and target is not None else ({}, {}, None)
            return None if last is None else (graph.did[graph.flags_of_edges(source, target, bounded(dist[last], r.ratio))],)

        return _maps(requests.select("request_id", "source", "target", "ratio"), send(directed, banned), "request_id long, did long", one)
    there = edge_distances_in_rounds(requests, directed, banned)
    back = edge_distances_in_rounds(requests.select("request_id", F.col("target").alias("source")), directed, banned, reverse=True).withColumnRenamed("dist", "rest")
    own = directed.select("did", F.col("length").alias("own"), "v")
    both = there.join(back, ["request_id", "did"]).join(own, "did")
    least = there.join(own, "did").join(requests.select("request_id", F.col("target").alias("v")), ["request_id", "v"]).groupBy("request_id").agg(F.min("dist").alias("least"))
    return _within(both, requests, least, F.col("dist") + F.col("rest") - F.col("own")).select("request_id", "did")


def farthest(found: DataFrame) -> DataFrame:
    """(request_id, dist): the largest distance of each request's map."""
    return found.groupBy("request_id").agg(F.max("dist").alias("dist"))


def _within(both: DataFrame, requests: DataFrame, least: DataFrame, detour) -> DataFrame:
    from ridgeline.functions.geo import max_weight

    bounds = least.join(requests.select("request_id", "ratio"), "request_id").select("request_id", max_weight("least", "ratio").alias("bound"))
    return both.join(bounds, "request_id").where(detour <= F.col("bound"))


PATHS = "request_id long, found boolean, edges array<long>, length long, elevation long, optimal boolean"

SHORTEST, LEAST, MOST = 0, 1, 2


def _route(graph: Graph, source: int, target: int, path_type: int, ratio: float, duplicates: int, turns: bool, seed: int, **options) -> tuple:
    start, end = graph.node(source), graph.node(target)
    path = graph.shortest(start, end, turns=bool(turns)) if start is not None and end is not None else None
    if path is not None and path_type == SHORTEST:
        path.optimal = True
    elif path is not None and path.edges:
        path = graph.evolve(start, end, path, bounded(path.length, ratio), path_type == MOST, Duplicates(duplicates), bool(turns), seed=seed, **options)
    if path is None:
        return False, [], None, None, None
    return True, [int(graph.did[e]) for e in path.edges], path.length, path.elevation, path.optimal


def routes(requests: DataFrame, directed: DataFrame, banned: DataFrame | None = None, offspring: int = 100, kept: int = 30, epochs: int = 10_000, least_epochs: int = 10, milliseconds: float | None = None, shared=None) -> DataFrame:
    """A path for each request (request_id, source, target, path_type, ratio, duplicates, turns).

    path_type: 0 shortest, 1 least elevation, 2 most. Every random choice comes from the request's id and type.
    shared: what prepared() gave for these tables, if they have been sent. Paths are written once: who reads them twice
    does not search twice (nor, where time bounds a search, get two answers).
    """
    shared = prepared("route search", directed, banned) if shared is None else shared

    def one(graph: Graph, r) -> Iterator[tuple]:
        seed = int(r.request_id) * 3 + int(r.path_type)
        yield r.request_id, *_route(graph, r.source, r.target, r.path_type, r.ratio, r.duplicates, r.turns, seed, offspring=offspring, kept=kept, epochs=epochs, least_epochs=least_epochs, milliseconds=milliseconds)

    needed = requests.select("request_id", "source", "target", "path_type", "ratio", "duplicates", "turns")
    return Store(needed.sparkSession, "routes").put("paths", _kernel(needed, shared, PATHS, one))


def least_elevation(requests: DataFrame, directed: DataFrame, banned: DataFrame | None = None) -> DataFrame:
    """(request_id, length, elevation, ...): the path of least elevation among what ratio leaves; turn-aware with banned."""
    shared, turns = prepared("least elevation", directed, banned), banned is not None

    def one(graph: Graph, r) -> Iterator[tuple]:
        start, end = graph.node(r.source), graph.node(r.target)
        base = graph.shortest(start, end, turns=turns) if start is not None and end is not None else None
        path = graph.least_elevation(start, end, bounded(base.length, r.ratio), turns) if base is not None else None
        if path is None:
            yield r.request_id, False, [], None, None, None
        else:
            yield r.request_id, True, [int(graph.did[e]) for e in path.edges], path.length, path.elevation, path.optimal

    return _kernel(requests.select("request_id", "source", "target", "ratio"), shared, PATHS, one)


def bounded(length: int, ratio: float) -> int:
    if ratio <= 0:
        return length
    return 2_147_483_647 if length > 2_147_483_646 / ratio else int(length * ratio)


def a_star(requests: DataFrame, directed: DataFrame) -> DataFrame:
    """Returns what the shortest-path search returns."""
    if not fits(directed):
        return shortest_in_rounds(requests, directed)
    return routes(requests.withColumns({"path_type": F.lit(SHORTEST), "ratio": F.lit(1.0), "duplicates": F.lit(0), "turns": F.lit(False)}), directed, shared=send(directed))


#: Edges of one path at most, in rounds: costs are lengths times this, plus one for each edge.
HOPS = 1 << 24


def shortest_in_rounds(requests: DataFrame, directed: DataFrame) -> DataFrame:
    """The same over DataFrames: distances by (length, edges), then all paths back from their targets, an edge a round."""
    store = Store(requests.sparkSession, "shortest")
    edges = store.put("edges", directed.select("did", "u", "v", F.col("length").cast("long").alias("length"), F.col("elevation").cast("long").alias("elevation")).withColumn("cost", F.col("length") * HOPS + 1))
    asked = store.put("asked", requests.select("request_id", "source", "target"))
    dist = store.put("dist", distances_in_rounds(asked, edges, "cost"))
    ends = asked.join(dist.withColumnRenamed("node", "target"), ["request_id", "target"])
    at, turn = store.put("at0", ends.select("request_id", F.col("target").alias("node"), "dist")), 0
    schema = "request_id long, did long, length long, elevation long, dist long"
    while not (at := at.where("dist > 0")).isEmpty():
        turn += 1
        back = at.join(edges.withColumnRenamed("v", "node"), "node").withColumn("rest", F.col("dist") - F.col("cost"))
        back = back.join(dist.select("request_id", F.col("node").alias("u"), F.col("dist").alias("rest")), ["request_id", "u", "rest"])
        step = back.groupBy("request_id").agg(F.min_by(F.struct("did", "u", "length", "elevation", "dist", "rest"), "did").alias("s")).select("request_id", "s.*")
        step = store.put(f"steps/turn={turn}", step)
        at = step.select("request_id", F.col("u").alias("node"), F.col("rest").alias("dist"))
    spark = requests.sparkSession
    steps = spark.read.schema(schema).parquet(f"{store.root}/steps") if turn else spark.createDataFrame([], schema)
    whole = steps.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist", "did"))), lambda e: e["did"]).alias("edges"), F.sum("length").alias("length"), F.sum("elevation").alias("elevation"))
    rows = asked.join(ends.select("request_id", F.lit(True).alias("found")), "request_id", "left").join(whole, "request_id", "left")
    none = F.when(F.col("found"), F.lit(0).cast("long"))
    return rows.select("request_id", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("edges", F.array().cast("array<long>")).alias("edges"), F.coalesce("length", none).alias("length"), F.coalesce("elevation", none).alias("elevation"), F.col("found").alias("optimal"))


def largest_component(directed: DataFrame, banned: DataFrame) -> DataFrame:
    """The directed edges of the largest strongly connected component (by nodes), banned turns not passed."""
    if fits(directed) and fits(banned):
        shared = send(directed, banned)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            graph = received(shared)
            for _ in batches:
                found = graph.did[graph.component()]
                for k in range(0, len(found), MAP_ROWS):
                    yield pd.DataFrame({"did": found[k : k + MAP_ROWS]})

        kept = directed.sparkSession.range(1).coalesce(1).mapInPandas(run, "did long")
    else:
        kept = component_in_rounds(directed, banned)
    return directed.join(kept.hint("merge"), "did", "left_semi")  # Spark takes what Python returns for a few rows, and would broadcast it


def component_in_rounds(directed: DataFrame, banned: DataFrame) -> DataFrame:
    """(did) of that component by colouring: labels spread forwards to a fixed point, then each colour's root collects
    backwards what reaches it; coloured components leave the graph, the rest goes on."""
    from ridgeline.operators.restrictions import allowed_turns

    store = Store(directed.sparkSession, "components")
    turns = store.put("turns", allowed_turns(directed, banned))
    left, parts, turn = store.put("left", directed.select("did")), None, 0
    while not left.isEmpty():
        turn += 1
        live = store.put(f"live{turn}", turns.join(left.withColumnRenamed("did", "from_did"), "from_did", "left_semi").join(left.withColumnRenamed("did", "to_did"), "to_did", "left_semi"))
        colour = _spread(store, f"c{turn}", left.select("did", F.col("did").alias("label")), live, "from_did", "to_did")
        same = live.join(colour.select(F.col("did").alias("from_did"), F.col("label").alias("a")), "from_did").join(colour.select(F.col("did").alias("to_did"), F.col("label").alias("b")), "to_did").where("a = b").select("from_did", "to_did")
        roots = colour.where("did = label").select("did", "label")
        own = _reach(store, f"r{turn}", roots, store.put(f"same{turn}", same))
        parts = own if parts is None else parts.unionByName(own)
        left = store.put(f"left{turn}", left.join(own, "did", "left_anti"))
        store.drop(f"live{turn}")
        store.drop(f"same{turn}")
    ends = parts.join(directed, "did").select("label", F.explode(F.array("u", "v")).alias("node"))
    best = ends.groupBy("label").agg(F.count_distinct("node").alias("n")).orderBy(F.desc("n"), "label").limit(1)
    return parts.join(best, "label", "left_semi").select("did")


def _spread(store: Store, name: str, labels: DataFrame, edges: DataFrame, tail: str, head: str) -> DataFrame:
    """The smallest label that reaches each edge."""
    changed, turn = labels, 0
    while not changed.isEmpty():
        turn += 1
        offered = edges.join(changed.withColumnRenamed("did", tail), tail).groupBy(F.col(head).alias("did")).agg(F.min("label").alias("new"))
        changed = store.put(f"{name}-changed{turn}", labels.join(offered, "did").where("new < label").select("did", F.col("new").alias("label")))
        labels = store.put(f"{name}-labels{turn}", labels.unionByName(changed).groupBy("did").agg(F.min("label").alias("label")))
        if turn > 1:
            store.drop(f"{name}-changed{turn - 1}")
            store.drop(f"{name}-labels{turn - 1}")
    return labels


def _reach(store: Store, name: str, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """What reaches each root against the edges."""
    found, new, turn = roots, roots, 0
    while not new.isEmpty():
        turn += 1
        back = edges.join(new.withColumnRenamed("did", "to_did"), "to_did").select(F.col("from_did").alias("did"), "label").distinct()
        new = store.put(f"{name}-new{turn}", back.join(found, ["did", "label"], "left_anti"))
        found = store.put(f"{name}-found{turn}", found.unionByName(new))
        if turn > 1:
            store.drop(f"{name}-new{turn - 1}")
            store.drop(f"{name}-found{turn - 1}")
    return found


ROUTE = "found boolean, edges array<long>, length long, elevation long, optimal boolean"


def register(spark: SparkSession, name: str, directed: DataFrame, banned: DataFrame | None = None, epochs: int = 10) -> None:
    """A table function for SQL: name(source, target, path_type, ratio, duplicates, turns) gives one route."""
    from pyspark.sql.functions import udtf

    shared = prepared("a route function", directed, banned)

    class Route:
        def eval(self, source: int, target: int, path_type: int, ratio: float, duplicates: int, turns: bool):
            yield _route(received(shared), source, target, path_type, ratio, duplicates, turns, 0, epochs=epochs)

    spark.udtf.register(name, udtf(Route, returnType=ROUTE))
