"""From ways to directed edges and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides of at most so many rows are broadcast; the caller has counted them. Larger ones are left to the planner.
BROADCAST_ROWS = 1_000_000


def with_endpoints(ways: DataFrame) -> DataFrame:
    """u and v: the first and the last node of a way; oneway is 0 where unknown."""
    return ways.withColumns({"u": F.try_element_at("nodes", F.lit(1)), "v": F.try_element_at("nodes", F.lit(-1)), "oneway": F.coalesce("oneway", F.lit(0)).cast("short")})


def endpoints(ways: DataFrame) -> DataFrame:
    """Distinct first and last nodes."""
    return ways.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def used_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """nodes that are an end of some way."""
    return nodes.join(endpoints(ways), "id", "left_semi")


def node_table(ways: DataFrame) -> DataFrame:
    """(id, lon, lat) of end nodes. Where ways disagree the first one's start wins, then the first one's end."""
    ends = ways.select("id", F.explode(F.array(
        F.struct(F.lit(0).alias("rank"), F.col("u").alias("node"), F.try_element_at("geom", F.lit(1)).alias("at")),
        F.struct(F.lit(1).alias("rank"), F.col("v").alias("node"), F.try_element_at("geom", F.lit(-1)).alias("at")),
    )).alias("e"))
    best = ends.where("e.node is not null").groupBy(F.col("e.node").alias("id")).agg(F.min_by("e.at", F.struct("e.rank", "id")).alias("at"))
    return best.select("id", "at.lon", "at.lat")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old, and those of new whose key is not there; of equal keys in new the smallest row."""
    fresh = new.join(old.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min(F.struct(*[c for c in old.columns if c != key])).alias("_r"))
    return old.unionByName(first.select(key, "_r.*"))


def update_from(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """target with column taken from source where source has the key."""
    found = source.select(key, F.col(column).alias("_new"))
    return target.join(found, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def direction(oneway: Column, open_profile: bool = False, strict: bool = False) -> Column:
    """both, forward or reverse. As stored data are read, -1 counts as forward; strict gives it its meaning."""
    one_way = F.when(oneway == -1, "reverse").otherwise("forward") if strict else F.lit("forward")
    return F.lit("both") if open_profile else F.when(F.coalesce(oneway, F.lit(0)) == 0, "both").otherwise(one_way)


def directed_edges(edges: DataFrame, nodes: DataFrame | None = None, open_profile: bool = False, strict: bool = False) -> DataFrame:
    """(did, id, u, v, length, elevation): did is 2 id forward, 2 id + 1 reversed. A loop yields one edge.

    With nodes, edges of which an end is missing go.
    """
    if nodes is not None:
        ids = nodes.select("id").distinct()
        for end in ("u", "v"):
            edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    way = direction(F.col("oneway").cast("int"), open_profile, strict)
    forward = F.struct((F.col("id") * 2).alias("did"), F.col("u").alias("u"), F.col("v").alias("v"))
    backward = F.struct((F.col("id") * 2 + 1).alias("did"), F.col("v").alias("u"), F.col("u").alias("v"))
    sides = F.when(F.col("u") == F.col("v"), F.array(forward)).when(way == "both", F.array(forward, backward)).when(way == "reverse", F.array(backward)).otherwise(F.array(forward))
    return edges.withColumn("_e", F.explode(sides)).select("_e.did", "id", "_e.u", "_e.v", "length", "elevation")


def undirected_index(directed: DataFrame) -> DataFrame:
    """(id, up, down): the edge towards the larger node id, and its counterpart."""
    return directed.groupBy("id").agg(F.min(F.when(F.col("u") <= F.col("v"), F.col("did"))).alias("up"), F.min(F.when(F.col("u") > F.col("v"), F.col("did"))).alias("down"))


def out_degree(directed: DataFrame) -> DataFrame:
    return directed.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))


def length_cm(metres: Column) -> Column:
    """Stored metres to whole centimetres, truncated."""
    return F.floor(metres * 100).cast("int")
