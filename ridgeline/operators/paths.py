"""Paths as rows (path_id, pos, did, ...) or arrays of directed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(paths: DataFrame, path: str = "path_id", edges: str = "edges") -> DataFrame:
    """(path_id, pos, did), pos from 0."""
    return paths.select(path, F.posexplode(edges).alias("pos", "did"))


def running_sums(rows: DataFrame, path: str = "path_id") -> DataFrame:
    """Adds cum_length and cum_elevation, this edge included, and what is left after it."""
    so_far = Window.partitionBy(path).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(path)
    return rows.withColumns({
        "cum_length": F.sum("length").over(so_far), "cum_elevation": F.sum("elevation").over(so_far),
        "left_length": F.sum("length").over(whole) - F.sum("length").over(so_far),
    })


def totals(rows: DataFrame, path: str = "path_id") -> DataFrame:
    """Length, elevation, edges, and distinct directed and undirected edges of each path."""
    return rows.groupBy(path).agg(F.sum("length").alias("length"), F.sum("elevation").alias("elevation"), F.count("*").alias("edges"), F.count_distinct("did").alias("directed"), F.count_distinct(F.floor(F.col("did") / 2)).alias("undirected"))


def cut_before(edges: Column, index) -> Column:
    """The first ``index`` edges."""
    return F.slice(edges, F.lit(1), index if isinstance(index, Column) else F.lit(index))


def cut_after(edges: Column, index) -> Column:
    """The edges up to and with ``index``."""
    return cut_before(edges, (index if isinstance(index, Column) else F.lit(index)) + 1)


def turned(edges: Column) -> Column:
    """The edges from last to first."""
    return F.reverse(edges)


def random_cut(edges: Column, seed: Column) -> Column:
    """A front part of random length, by seed."""
    return cut_before(edges, F.pmod(F.xxhash64(seed), F.greatest(F.size(edges), F.lit(1))).cast("int"))


def last_occurrence(rows: DataFrame, path: str = "path_id", item: str = "did") -> DataFrame:
    """Adds last_pos: where the path has this edge for the last time."""
    return rows.withColumn("last_pos", F.max("pos").over(Window.partitionBy(path, item)))


def distinct_paths(paths: DataFrame, edges: str = "edges") -> DataFrame:
    return paths.dropDuplicates([edges])


def survivors(paths: DataFrame, k: int, group: str = "request_id", maximise: bool = True, tie: str = "path_id") -> DataFrame:
    """The k paths of most (or least) elevation of each group; Spark keeps k rows for each group and task at most."""
    order = [F.desc("elevation") if maximise else F.asc("elevation"), F.asc(tie)]
    return paths.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def best(paths: DataFrame, group: str = "request_id", maximise: bool = True, tie: str = "path_id") -> DataFrame:
    """The path of most (or least) elevation of each group, ties to the smaller id; by map-side combined aggregation."""
    sign = -1 if maximise else 1
    return paths.groupBy(group).agg(F.min_by(F.struct(*[c for c in paths.columns if c != group]), F.struct((F.col("elevation") * sign).alias("e"), F.col(tie).alias("t"))).alias("_p")).select(group, "_p.*")


def crossings(rows: DataFrame, path: str = "path_id") -> DataFrame:
    """(did, paths, positions): directed edges that two or more paths share, and where."""
    own = rows.groupBy("did", path).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    shared = own.groupBy("did").agg(F.count("*").alias("paths"), F.sort_array(F.collect_list(F.struct(path, "positions"))).alias("where"))
    return shared.where("paths >= 2")


def crossing_places(rows: DataFrame, path: str = "path_id") -> DataFrame:
    """(did, path, pos, paths): the same as rows, so that an edge may lie on any number of paths."""
    shared = rows.groupBy("did", path).agg(F.lit(1).alias("_n")).groupBy("did").agg(F.count("*").alias("paths")).where("paths >= 2")
    return rows.select("did", path, "pos").join(shared, "did")


def audit(found: DataFrame, shortest: DataFrame, asked: DataFrame, directed: DataFrame, banned: DataFrame | None = None) -> DataFrame:
    """What routes promise, for each one found: edges joined from source to target, sums right, length within the bound,
    elevation no worse than the shortest path's, no repeats that the policy forbids, no banned turn."""
    from ridgeline.functions.geo import max_weight

    rows = steps(found, "request_id").join(directed.select("did", "u", "v", F.col("length").alias("l"), F.col("elevation").alias("e")), "did")
    by = Window.partitionBy("request_id").orderBy("pos")
    rows = rows.withColumns({"next_u": F.lead("u").over(by), "next_did": F.lead("did").over(by)})
    if banned is not None:
        rows = rows.join(banned.select(F.col("from_did").alias("did"), F.col("to_did").alias("next_did"), F.lit(1).alias("bad")), ["did", "next_did"], "left")
    else:
        rows = rows.withColumn("bad", F.lit(None))
    whole = rows.groupBy("request_id").agg(
        F.bool_and(F.coalesce(F.col("next_u") == F.col("v"), F.lit(True))).alias("chained"), F.min_by("u", "pos").alias("first"), F.max_by("v", "pos").alias("last"), F.sum("l").alias("l"), F.sum("e").alias("e"),
        F.count("*").alias("n"), F.count_distinct("did").alias("dids"), F.count_distinct(F.floor(F.col("did") / 2)).alias("roads"), F.count("bad").alias("bans"),
    )
    base = shortest.select("request_id", F.col("length").alias("shortest"), F.col("elevation").alias("base"))
    r = found.where("found").join(base, "request_id").join(asked.select("request_id", "source", "target", "path_type", "ratio", "duplicates", "turns"), "request_id").join(whole, "request_id", "left")
    none = F.size("edges") == 0
    kept = F.when((F.col("duplicates") == 1) & ~F.col("turns"), F.col("dids") == F.col("n")).when((F.col("duplicates") == 2) & ~F.col("turns"), F.col("roads") == F.col("n")).otherwise(True)
    return r.select(
        "request_id", "shortest",
        F.when(none, F.col("source") == F.col("target")).otherwise(F.col("chained") & (F.col("first") == F.col("source")) & (F.col("last") == F.col("target"))).alias("joined"),
        ((F.col("length") == F.coalesce("l", F.lit(0))) & (F.col("elevation") == F.coalesce("e", F.lit(0)))).alias("sums_right"),
        ((F.col("length") >= F.col("shortest")) & (F.col("length") <= max_weight("shortest", "ratio"))).alias("in_bound"),
        F.when(F.col("path_type") == 2, F.col("elevation") >= F.col("base")).when(F.col("path_type") == 1, F.col("elevation") <= F.col("base")).otherwise(True).alias("no_worse"),
        F.coalesce(kept, F.lit(True)).alias("policy_kept"), (F.coalesce("bans", F.lit(0)) == 0).alias("turns_legal"),
    )


def line(rows: DataFrame, geometry: DataFrame, path: str = "path_id") -> DataFrame:
    """(path_id, points): the edges' points in order, turned round where an edge is passed backwards, joints once."""
    shaped = rows.withColumn("id", F.floor(F.col("did") / 2)).join(geometry.select("id", "geom"), "id")
    own = F.when(F.col("did") % 2 == 1, F.reverse("geom")).otherwise(F.col("geom"))
    part = F.when(F.col("pos") == 0, own).otherwise(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))))
    whole = shaped.groupBy(path).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"))
    return whole.select(path, F.flatten(F.transform("parts", lambda p: p["part"])).alias("points"))


def segments(ways: DataFrame) -> DataFrame:
    """(id, seg, lon1, lat1, lon2, lat2): a row for each pair of consecutive points."""
    pairs = F.arrays_zip(F.slice("geom", F.lit(1), F.greatest(F.size("geom") - 1, F.lit(0))).alias("a"), F.slice("geom", F.lit(2), F.greatest(F.size("geom") - 1, F.lit(0))).alias("b"))
    return ways.select("id", F.posexplode(pairs).alias("seg", "s")).select("id", "seg", F.col("s.a.lon").alias("lon1"), F.col("s.a.lat").alias("lat1"), F.col("s.b.lon").alias("lon2"), F.col("s.b.lat").alias("lat2"))


def edge_lines(directed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, lon1, lat1, lon2, lat2): each undirected edge once, by its end nodes."""
    one = directed.groupBy("id").agg(F.min_by(F.struct("u", "v"), "did").alias("e")).select("id", "e.u", "e.v")
    at = lambda end, k: nodes.select(F.col("id").alias(end), F.col("lon").alias(f"lon{k}"), F.col("lat").alias(f"lat{k}"))
    return one.join(at("u", 1), "u").join(at("v", 2), "v").select("id", "lon1", "lat1", "lon2", "lat2")


def geojson(points: Column, start_elevation: Column, end_elevation: Column, elevation: Column, length: Column, optimal: Column) -> Column:
    """A route as JSON: coordinates are [lat, lon], elevation is the gain, length is in km."""
    from ridgeline.functions.geo import cm_to_km, elevation_gain

    shape = F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lat"], p["lon"])).alias("coordinates"))
    return F.to_json(F.struct(shape.alias("GeoJSON"), elevation_gain(elevation, start_elevation, end_elevation).alias("elevation"), cm_to_km(length).alias("length"), optimal.alias("optimal")))


def empty_geojson(lon: Column, lat: Column) -> Column:
    """The route from a node to itself."""
    shape = F.struct(F.lit("Node").alias("type"), F.array(F.array(lat, lon)).alias("coordinates"))
    return F.to_json(F.struct(shape.alias("GeoJSON"), F.lit(0).alias("elevation"), F.lit(0).alias("length"), F.lit(True).alias("optimal")))
