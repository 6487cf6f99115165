"""Operators that the query fixtures don't reach, and their odd cases."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geo, tags, wkt
from ridgeline.operators import elevation, graph, itinerary, nearest, paths, profiles, requests, restrictions
from ridgeline.operators.profiles import Profile
from ridgeline.plans import build, search
from ridgeline.sources import files, grid, osm
from ridgeline.streaming import ingest, limits


def test_profiles():
    assert profiles.road_types(Profile.TRUNK) == ("motorway", "motorway_link", "trunk", "trunk_link")
    assert profiles.road_types(Profile.LOCAL)[-2:] == ("unclassified", "residential")
    with pytest.raises(ValueError):
        profiles.road_types(Profile.ALL)


def test_wkt(spark):
    df = spark.createDataFrame([("POINT(1.5 -2)", "LINESTRING(0 0, 1 1,2.25 -3)"), ("POINT()", "nonsense"), (None, None)], "p string, l string")
    rows = df.select(wkt.parse_point(F.col("p")).alias("p"), wkt.parse_line(F.col("l")).alias("l")).collect()
    assert (rows[0].p.lon, rows[0].p.lat) == (1.5, -2.0) and len(rows[0].l) == 3
    assert rows[1].p is None and rows[1].l is None and rows[2].p is None
    text = df.limit(1).select(wkt.line_text(wkt.parse_line(F.col("l"))).alias("t")).first().t
    assert text == "LINESTRING(0 0,1 1,2.25 -3)"


def test_directions(spark):
    df = spark.createDataFrame([(1, 10, 11, 5, 1, 0), (2, 11, 12, 5, 1, 1), (3, 12, 13, 5, 1, -1), (4, 7, 7, 5, 1, 0)], "id long, u long, v long, length int, elevation int, oneway int")
    got = {r.did: (r.u, r.v) for r in graph.directed_edges(df).collect()}
    assert got == {2: (10, 11), 3: (11, 10), 4: (11, 12), 6: (12, 13), 8: (7, 7)}
    strict = {r.did: (r.u, r.v) for r in graph.directed_edges(df, strict=True).collect()}
    assert strict[7] == (13, 12) and 6 not in strict
    assert graph.directed_edges(df, open_profile=True).count() == 7


def test_distance_clamps_and_truncates(spark):
    row = spark.range(1).select(geo.distance_cm(F.lit(3.0), F.lit(4.0), F.lit(3.0), F.lit(4.0)).alias("z"), geo.distance_cm(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("h"), geo.truncate(F.lit(-1.9)).alias("t")).first()
    assert row.z < 20 and row.h == int(3.141592653589793 * 637_100_000) and row.t == -1


def test_tag_kinds(spark):
    df = spark.createDataFrame([({"a": "1", "source": "x"}, '{"a":"1","n":2}')], "m map<string,string>, j string")
    row = df.select(tags.tag(F.col("m"), "a").alias("a"), tags.tag(F.col("j"), "n", "json").alias("n"), tags.tag(F.parse_json("j"), "a", "variant").alias("v"), tags.clean(F.col("m")).alias("c")).first()
    assert (row.a, row.n, row.v, row.c) == ("1", "2", "1", {"a": "1"})


def test_nearest_far_away_and_across_the_date_line(spark):
    nodes = spark.createDataFrame([(1, 179.999, 0.0), (2, 10.0, 50.0), (3, -60.0, -80.0)], "id long, lon double, lat double")
    points = spark.createDataFrame([(7, -179.999, 0.001), (8, 11.0, 40.0), (9, 100.0, -89.0)], "point_id long, lon double, lat double")
    assert {r.point_id: r.id for r in nearest.nearest(points, nodes).collect()} == {7: 1, 8: 2, 9: 3}
    assert {(r.point_id, r.id) for r in nearest.within(points, nodes, 1000.0).collect()} == {(7, 1)}


def test_osm_ingest(spark):
    m = "struct<type:string,ref:long,role:string>"
    rel = spark.createDataFrame([(1, {"type": "restriction", "restriction": "no_left_turn"}, [("w", 5, "from"), ("n", 9, "via"), ("w", 6, "to"), ("w", 7, "to")]), (2, {"type": "restriction", "restriction": "no_u_turn"}, [("w", 5, "from"), ("r", 9, "via"), ("w", 6, "to")]), (3, {"type": "route"}, [])], f"id long, tags map<string,string>, members array<{m}>")
    rows = osm.restrictions(rel).collect()
    assert [(r.relation_id, r.from_id, r.via_id, r.to_id, r.via_type) for r in rows] == [(1, 5, 9, 7, "n")]


def test_build_from_raw_tables(spark):
    point = "struct<lon:double,lat:double>"
    raw = spark.createDataFrame(
        [(1, {"highway": "path"}, [1, 2], [(0.0, 0.0), (0.001, 0.0)]), (2, {"highway": "path", "oneway": "yes"}, [2, 3], [(0.001, 0.0), (0.002, 0.0)]), (3, {"highway": "path"}, [3, 1], [(0.002, 0.0), (0.0, 0.0)]), (4, {"highway": "motorway"}, [8, 9], [(1.0, 1.0), (1.1, 1.0)])],
        f"id long, tags map<string,string>, nodes array<long>, geom array<{point}>",
    )
    relations = spark.createDataFrame([], "id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>")
    heights = spark.createDataFrame([(0.0, 0.0, 10), (0.001, 0.0, 30), (0.002, 0.0, 5)], "lon double, lat double, elevation int")
    tables = build.derive(raw, relations, heights)
    loaded = build.load(tables, Profile.HIKING)
    assert sorted(r.id for r in loaded["nodes"].collect()) == [1, 2, 3]
    assert loaded["directed"].count() == 6
    assert {r.id: r.elevation for r in tables["edges"].where("id < 4").collect()} == {1: 20, 2: 25, 3: 5}
    assert loaded["geometry"].count() == 3


def test_rounds_agree_with_the_kernel(spark, folder):
    nodes = grid.nodes(spark, folder).where("id % 40 < 6 and id < 120")
    edges = grid.edges(nodes)
    directed = graph.directed_edges(edges)
    banned = grid.banned(directed)
    ask = spark.createDataFrame([(1, 0), (2, 43)], "request_id long, source long")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(search.distances(ask, directed).select("request_id", "node", "dist")) == key(search.distances_in_rounds(ask, directed).select("request_id", "node", "dist"))
    assert key(search.edge_distances(ask, directed, banned, bound=900).select("request_id", "did", "dist")) == key(search.edge_distances_in_rounds(ask, directed, banned, bound=900).select("request_id", "did", "dist"))


def test_component_rounds_agree_with_the_kernel(spark, folder):
    nodes = grid.nodes(spark, folder).where("id % 40 < 3 and id < 100")
    directed = graph.directed_edges(grid.edges(nodes))
    banned = grid.banned(directed)
    a = {r.did for r in search.largest_component(directed, banned).collect()}
    assert a == {r.did for r in search.component_in_rounds(directed, banned).collect()}


def test_itinerary_edits(spark):
    m = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(4)], "itinerary_id long, position int, lon double, lat double")
    order = lambda df: [r.lon for r in df.orderBy("position").collect()]
    assert order(itinerary.insert(m, 1, 9.0, 0.0)) == [0.0, 9.0, 1.0, 2.0, 3.0]
    assert order(itinerary.extract(m, 1)) == [0.0, 2.0, 3.0]
    assert order(itinerary.move(m, 0, 2)) == [1.0, 2.0, 0.0, 3.0]
    assert order(itinerary.move(m, 3, 1)) == [0.0, 3.0, 1.0, 2.0]
    assert order(itinerary.switch(m, 0, 3)) == [3.0, 1.0, 2.0, 0.0]


def test_route_to_itself_and_unreachable(spark):
    directed = spark.createDataFrame([(2, 1, 1, 2, 10, 3), (8, 4, 5, 6, 10, 3)], "did long, id long, u long, v long, length long, elevation long")
    ask = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 1, 99)], "request_id long, source long, target long")
    got = {r.request_id: (r.found, r.edges, r.length) for r in search.routes(requests.of_type(ask, search.MOST, 2.0), directed, epochs=2).collect()}
    assert got[1] == (True, [], 0) and got[2] == (True, [2], 10) and got[3][0] is False and got[4][0] is False


def test_line_turns_edges_round(spark):
    g = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0)]), (2, [(2.0, 0.0), (1.0, 0.0)])], "id long, geom array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame([(5, [2, 5])], "path_id long, edges array<long>")
    row = paths.line(paths.steps(p), g).first()
    assert [x.lon for x in row.points] == [0.0, 1.0, 2.0]


def test_admission():
    rows = pd.DataFrame([("a", 0, 100, 4), ("a", 1, 100, 4), ("b", 2, 100, 4), ("b", 3, 100, 4), ("c", 4, 50, 1), ("c", 150, 160, 5), ("a", 200, 210, 1)], columns=["ip", "start_ms", "end_ms", "legs"])
    assert limits.admit(rows).code.tolist() == [0, 1, 2, 3, -1, -3, 4]
    assert limits.admit(rows, quotas=[(1000, 150)]).code.tolist()[-1] == -2


def test_usage_stream(spark, tmp_path):
    rows = [("a", 0, 100), ("a", 150, 200), ("b", 0, 10), ("a", 260, 270)]
    spark.createDataFrame(rows, "ip string, start_ms long, end_ms long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ip string, start_ms long, end_ms long").parquet(str(tmp_path / "in"))
    q = limits.usage_stream(stream, 100).writeStream.format("memory").queryName("used").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.ip, r.start_ms): r.used_ms for r in spark.sql("select * from used").collect()}
    assert got == {("a", 0): 0, ("a", 150): 50, ("a", 260): 40, ("b", 0): 0}
    batch = limits.recent_usage(spark.createDataFrame(rows, "ip string, start_ms long, end_ms long"), 100)
    assert {(r.ip, r.start_ms): r.used_ms for r in batch.collect()} == got


def test_ingest_takes_new_files_once(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("src", "dst", "cp")]
    spark.range(3).write.parquet(where[0])
    ingest.resume(spark, *where).awaitTermination(60)
    spark.range(3, 5).write.mode("append").parquet(where[0])
    ingest.resume(spark, *where).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(where[1]).collect()) == [0, 1, 2, 3, 4]


def test_csv_and_elevation_service(spark, tmp_path):
    n = spark.createDataFrame([(1, 1.0, 2.0)], "id long, lon double, lat double")
    high = elevation.fetch(n, lambda points: [-12.7 for _ in points])
    assert high.first().elevation == -12
    files.write_nodes_csv(high, str(tmp_path / "n"))
    assert files.read_csv(spark, str(tmp_path / "n"), "id long, lon double, lat double, elevation int").first().lon == 1.0
    assert spark.createDataFrame([("a,b,",)], "l string").select(files.split_line(F.col("l")).alias("x")).first().x == ["a", "b"]


def test_edge_via_restriction(spark):
    directed = spark.createDataFrame([(2, 1, 1, 2), (4, 2, 2, 3), (5, 2, 3, 2), (6, 3, 3, 4)], "did long, id long, u long, v long")
    turns = spark.createDataFrame([("en", 1, 2, 3)], "type_enum string, from_id long, via_id long, to_id long")
    assert sorted((r.from_did, r.to_did) for r in restrictions.banned_turns(turns, directed).collect()) == [(2, 4), (4, 6)]


def test_crossing_places_hold_what_the_lists_hold(spark):
    rows = spark.createDataFrame([(p, k, d) for p in range(40) for k, d in enumerate((7, p, 7, p % 3))] + [(99, 0, 1000)], "path_id long, pos long, did long")
    listed = {(r.did, r.paths, w.path_id, pos) for r in paths.crossings(rows).collect() for w in r["where"] for pos in w.positions}
    placed = [(r.did, r.paths, r.path_id, r.pos) for r in paths.crossing_places(rows).collect()]
    assert len(placed) == len(set(placed)) and set(placed) == listed and not any(d == 1000 for d, *_ in placed)


def test_nearest_far_from_every_node(spark, monkeypatch):
    """Points degrees away from all nodes, in blocks, against brute force; poles, ties and the date line."""
    import numpy as np

    monkeypatch.setattr(nearest, "LEFT", 20)
    rng = np.random.default_rng(4)
    n = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-180, 180, 30), np.degrees(np.arcsin(rng.uniform(-1, 1, 30)))))] + [(40, 0.0, 90.0), (41, 10.0, 10.0), (42, 10.0, 10.0)]
    p = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-180, 180, 90), np.degrees(np.arcsin(rng.uniform(-1, 1, 90)))))] + [(200, 10.0, 10.0), (201, 77.0, -90.0)]
    got = {r.point_id: r.id for r in nearest.nearest(spark.createDataFrame(p, "point_id long, lon double, lat double"), spark.createDataFrame(n, "id long, lon double, lat double")).collect()}
    to = lambda a: np.stack([np.cos(np.radians(a[:, 2])) * np.cos(np.radians(a[:, 1])), np.cos(np.radians(a[:, 2])) * np.sin(np.radians(a[:, 1])), np.sin(np.radians(a[:, 2]))], 1)
    dots = to(np.array(p)) @ to(np.array(n)).T
    assert set(got) == {k for k, _, _ in p} and got[200] == 41
    place = {i: k for k, (i, _, _) in enumerate(n)}
    assert all(dots[row, place[got[k]]] >= dots[row].max() - 1e-12 for row, (k, _, _) in enumerate(p))


def test_reachable_sets_of_graphs_beyond_the_kernel(spark, folder, monkeypatch):
    directed = graph.directed_edges(grid.edges(grid.nodes(spark, folder).where("id % 40 < 5 and id < 100")))
    banned = grid.banned(directed)
    ask = spark.createDataFrame([(1, 0, 43, 1.3), (2, 44, 1, 1.0), (3, 2, 2, 2.0), (4, 0, 9999, 1.5)], "request_id long, source long, target long, ratio double")
    shown = lambda: (sorted(map(tuple, search.reachable_nodes(ask, directed).collect())), sorted(map(tuple, search.reachable_edges(ask, directed, banned).collect())))
    kernel = shown()
    monkeypatch.setattr(search, "fits", lambda graph, most=0: False)
    assert shown() == kernel and kernel[0] and kernel[1]
    with pytest.raises(ValueError):
        search.routes(requests.of_type(ask, search.MOST), directed, banned)


def test_one_worker_tells_graphs_apart(spark):
    made = lambda w: spark.createDataFrame([(2, 1, 2, w, 0), (4, 2, 3, w, 0)], "did long, u long, v long, length long, elevation long")
    ask = spark.createDataFrame([(1, 1, 3)], "request_id long, source long, target long").coalesce(1)
    assert [search.a_star(ask, made(w)).first().length for w in (1, 5, 1, 7)] == [2, 10, 2, 14]


def test_audit_sees_faults(spark):
    directed = spark.createDataFrame([(2, 1, 2, 5, 1), (4, 2, 3, 5, 1), (5, 3, 2, 5, 1), (8, 7, 8, 1, 1)], "did long, u long, v long, length long, elevation long")
    banned = spark.createDataFrame([(2, 4)], "from_did long, to_did long")
    asked = spark.createDataFrame([(k, 1, 3, 2, 1.5, 1, False) for k in range(5)], "request_id long, source long, target long, path_type int, ratio double, duplicates int, turns boolean")
    base = spark.createDataFrame([(k, True, [2, 4], 10, 2, True) for k in range(5)], search.PATHS)
    found = spark.createDataFrame([(0, True, [2, 4], 10, 2, False), (1, True, [2, 8], 6, 2, False), (2, True, [2, 4, 5, 4], 20, 4, False), (3, True, [2, 4], 11, 1, False), (4, True, [], 0, 0, False)], search.PATHS)
    got = {r.request_id: r for r in paths.audit(found, base, asked, directed).collect()}
    assert all(got[0][c] for c in ("joined", "sums_right", "in_bound", "no_worse", "policy_kept", "turns_legal"))
    assert not got[1].joined and not got[1].in_bound and not got[2].in_bound and not got[2].policy_kept and not got[3].sums_right and not got[3].no_worse and not got[4].joined
    assert not paths.audit(found, base, asked, directed, banned).where("request_id = 0").first().turns_legal


def test_late_records_count(spark, tmp_path):
    """A late record of a later batch counts what began before it; batches are files."""
    where = str(tmp_path / "in")
    schema = "ip string, start_ms long, end_ms long"
    batches = [[("a", 0, 100), ("a", 1000, 1100)], [("a", 150, 200), ("a", 1050, 1060)], [("a", 160, 170)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)
    q = limits.usage_stream(stream, 300, late_ms=2000).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.ip, r.start_ms): r.used_ms for r in spark.sql("select * from late").collect()}
    assert got == {("a", 0): 0, ("a", 1000): 0, ("a", 150): 100, ("a", 1050): 50, ("a", 160): 110}


def test_admission_is_that_of_whole_histories():
    import numpy as np

    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"ip": rng.choice(list("abc"), 400), "start_ms": rng.integers(0, 3000, 400), "legs": rng.integers(1, 6, 400)})
    rows["end_ms"] = rows.start_ms + rng.integers(1, 200, 400)
    rows = rows.drop_duplicates(["ip", "start_ms"])[["ip", "start_ms", "end_ms", "legs"]]
    quotas = [(500, 150), (2000, 400)]
    admitted, codes = [], []
    for r in rows.sort_values(["start_ms", "ip"]).itertuples():
        used = lambda w: sum(max(0, min(e, r.start_ms) - max(s, r.start_ms - w)) for ip, s, e, _ in admitted if ip == r.ip)  # noqa: E731, B023
        free = 16 - sum(n for _, _, e, n in admitted if e > r.start_ms)
        code = -3 if r.legs > 4 else -2 if any(used(w) > most for w, most in quotas) else -1 if free < 4 else len(admitted)
        codes.append(code)
        if code >= 0:
            admitted.append((r.ip, r.start_ms, r.end_ms, r.legs))
    assert limits.admit(rows, quotas).code.tolist() == codes and {-3, -2, -1} <= set(codes)


def test_unknown_heights_are_null(spark):
    n = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 5.0, 6.0)], "id long, lon double, lat double")
    got = {r.id: r.elevation for r in elevation.fetch(n, lambda points: [{2.0: 7.9, 4.0: None, 6.0: float("nan")}[lat] for lat, _ in points], batch=1).collect()}
    assert got == {1: 7, 2: None, 3: None}


def test_map_extract_in_xml(spark, tmp_path):
    (tmp_path / "map.osm").write_text("""<?xml version="1.0"?><osm>
<node id="1" lon="0.0" lat="0.0"/><node id="2" lon="0.001" lat="0.5"><tag k="highway" v="crossing"/></node><node id="3" lon="2.0" lat="1.0"/>
<way id="10"><nd ref="2"/><nd ref="1"/><nd ref="3"/><nd ref="2"/><tag k="highway" v="path"/><tag k="oneway" v="yes"/></way><way id="11"><nd ref="1"/><nd ref="2"/></way>
<relation id="5"><member type="way" ref="10" role="from"/><member type="node" ref="2" role="via"/><member type="way" ref="11" role="to"/><tag k="type" v="restriction"/><tag k="restriction" v="no_left_turn"/></relation></osm>""")
    tables = osm.read_xml(spark, str(tmp_path / "map.osm"))
    ways = {r.id: r for r in osm.ways(tables["ways"]).collect()}
    assert ways[10].nodes == [2, 1, 3, 2] and ways[10].type == "path" and ways[10].oneway == 1 and [p.lat for p in ways[10].geom] == [0.5, 0.0, 1.0, 0.5]
    assert ways[11].type == "" and {r.id: r.tags for r in tables["nodes"].collect()}[2] == {"highway": "crossing"}
    assert [(r.relation_id, r.from_id, r.via_id, r.via_type, r.to_id) for r in osm.restrictions(tables["relations"]).collect()] == [(5, 10, 2, "n", 11)]


def test_command_line(spark, tmp_path):
    from ridgeline import cli, queries

    at = lambda name: f"file://{tmp_path}/{name}"
    nodes = grid.nodes(spark, "/root/testdata/sf0.001").where("id % 40 < 8")
    point = "struct<lon:double,lat:double>"
    rows = [(int(r.id), int(r.u), int(r.v)) for r in grid.edges(nodes).collect()]
    place = {r.id: (r.lon, r.lat) for r in nodes.collect()}
    spark.createDataFrame([(i, {"highway": "path"}, [u, v], [place[u], place[v]]) for i, u, v in rows], f"id long, tags map<string,string>, nodes array<long>, geom array<{point}>").write.parquet(at("ways"))
    spark.createDataFrame([], "id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>").write.parquet(at("relations"))
    nodes.select("lon", "lat", "elevation").write.parquet(at("heights"))
    queries._batches(spark).where("batch_id in (0, 8)").write.parquet(at("requests"))
    cli.main(["build", at("ways"), at("relations"), at("heights"), at("graph"), "--profile", "hiking"])
    cli.main(["route", at("graph"), at("requests"), at("out"), "--epochs", "2"])
    got = {r.batch_id: r.response for r in spark.read.parquet(at("out")).collect()}
    assert set(got) == {0, 8} and all('"LineString"' in r for r in got.values())
    with pytest.raises(SystemExit):
        cli.main(["build"])


def test_median_split_of_ties(spark, monkeypatch):
    from ridgeline.operators import relational

    monkeypatch.setattr(relational, "BINS", 4)
    for values in ([1.0] * 7, [1.0, 2.0], [5.0], [float(k % 3) for k in range(20)], []):
        rows = [(k, v) for k, v in enumerate(values)]
        got = {r.id: r.half for r in relational.median_split(spark.createDataFrame(rows, "id long, lon double"), "lon").collect()}
        order = [i for _, i in sorted((v, i) for i, v in rows)]
        assert got == {i: int(at >= len(rows) // 2) for at, i in enumerate(order)}


def test_shortest_paths_of_graphs_beyond_the_kernel(spark, monkeypatch):
    edges = [(0, 1, 2, 5, 1), (1, 2, 1, 5, 1), (2, 2, 3, 0, 2), (3, 3, 2, 0, 2), (4, 3, 4, 5, 1), (6, 1, 4, 20, 0), (8, 5, 6, 1, 1)]
    directed = spark.createDataFrame(edges, "did long, u long, v long, length long, elevation long")
    pairs = spark.createDataFrame([(0, 1, 4), (1, 4, 1), (2, 1, 1), (3, 3, 1), (4, 5, 6)], "request_id long, source long, target long")
    shown = lambda: {r.request_id: (r.found, list(r.edges), r.length, r.elevation, r.optimal) for r in search.a_star(pairs, directed).collect()}
    kernel = shown()
    monkeypatch.setattr(search, "fits", lambda graph, most=0: False)
    assert shown() == kernel and kernel[0] == (True, [0, 2, 4], 10, 4, True)
    with pytest.raises(ValueError):
        search.least_elevation(pairs.withColumn("ratio", F.lit(1.5)), directed)
