"""The grid fixture: a road network over the table ``part``, by whole-number formulas (p_partkey counts from 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 40


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    part = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("int").alias("elevation"))
    return part.select("id", (F.lit(-72) + (F.col("id") % WIDTH) * 0.001).alias("lon"), (F.lit(42) + F.floor(F.col("id") / WIDTH) * 0.001).alias("lat"), "elevation")


def edges(nodes: DataFrame) -> DataFrame:
    """(id, u, v, length, elevation, oneway): even ids go right, odd ids go up."""
    right = nodes.where(F.col("id") % WIDTH != WIDTH - 1).select((F.col("id") * 2).alias("id"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), (100 + F.col("id") * 37 % 61).alias("length"), (F.col("id") % 7 == 0).cast("int").alias("oneway"), F.col("elevation").alias("eu"))
    up = nodes.select((F.col("id") * 2 + 1).alias("id"), F.col("id").alias("u"), (F.col("id") + WIDTH).alias("v"), (100 + F.col("id") * 53 % 71).alias("length"), (F.col("id") % 11 == 0).cast("int").alias("oneway"), F.col("elevation").alias("eu"))
    other = nodes.select(F.col("id").alias("v"), F.col("elevation").alias("ev"))
    return right.unionByName(up).join(other, "v").select("id", "u", "v", "length", F.abs(F.col("eu") - F.col("ev")).alias("elevation"), "oneway")


def banned(directed: DataFrame) -> DataFrame:
    """(from_did, to_did): an arbitrary thirteenth of edges may not be followed by an arbitrary fifth."""
    a = directed.where("did % 13 = 3").select(F.col("did").alias("from_did"), F.col("v").alias("at"))
    b = directed.where("did % 5 = 2").select(F.col("did").alias("to_did"), F.col("u").alias("at"))
    return a.join(b, "at").select("from_did", "to_did")


def geometry(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, u, v, geom): straight lines with a point in the middle."""
    at = lambda end: nodes.select(F.col("id").alias(end), F.struct("lon", "lat").alias(f"p{end}"))
    middle = F.struct(((F.col("pu.lon") + F.col("pv.lon")) / 2).alias("lon"), ((F.col("pu.lat") + F.col("pv.lat")) / 2).alias("lat"))
    return edges.select("id", "u", "v").join(at("u"), "u").join(at("v"), "v").select("id", "u", "v", F.array("pu", middle, "pv").alias("geom"))


#: Tags of the fixture's ways, as SQL over the way's id; both engines read the same text.
TAGS = {
    "sac_scale": "case id % 23 when 3 then 'hiking' when 9 then 'mountain_hiking' when 14 then 'difficult_alpine_hiking' end",
    "bicycle": "case id % 11 when 0 then 'yes' when 2 then 'no' when 5 then 'dismount' when 7 then 'private' end",
    "foot": "case id % 13 when 1 then 'yes' when 4 then 'no' when 8 then 'permissive' end",
    "vehicle": "case id % 17 when 6 then 'no' end",
    "access": "case id % 19 when 8 then 'private' end",
    "man_made": "case id % 29 when 5 then 'pier' end",
    "railway": "case id % 31 when 6 then 'platform' end",
    "route": "case id % 15 when 2 then 'ferry' when 11 then 'shuttle_train' end",
    "bicycle_road": "case id % 37 when 9 then 'yes' end",
    "motorroad": "case id % 27 when 4 then 'yes' end",
    "ford": "case id % 21 when 10 then 'yes' end",
    "sidewalk": "case id % 9 when 4 then 'both' when 6 then 'none' end",
}
TYPES = ("cycleway", "path", "footway", "track", "motorway", "trunk", "primary", "secondary_link", "tertiary", "residential", "unclassified", "steps", "ford", "construction", "motorway_link", "service")
TYPE_SQL = "case id % 16 " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(TYPES)) + " end"


def ways(edges: DataFrame) -> DataFrame:
    """(id, u, v, type, tags): the fixture's edges as tagged ways."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(sql).alias("value")) for k, sql in TAGS.items()])
    tags = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return edges.select("id", "u", "v", F.expr(TYPE_SQL).alias("type"), tags.alias("tags"))


def turn_relations(directed: DataFrame) -> DataFrame:
    """(relation_id, restriction, via_type, from_id, via_id, to_id): consecutive edges by formula, via their node; and
    chains of three, via the middle edge."""
    a = directed.select(F.col("did").alias("d1"), F.col("id").alias("from_id"), F.col("v").alias("n1"))
    b = directed.select(F.col("did").alias("d2"), F.col("id").alias("mid"), F.col("u").alias("n1"), F.col("v").alias("n2"))
    two = a.join(b, "n1").where("d1 % 17 = 4 and d2 % 3 = 1 and from_id <> mid")
    node = two.select((F.col("d1") * 1_000_003 + F.col("d2")).alias("relation_id"), F.when(F.col("d2") % 2 == 0, "no_left_turn").otherwise("only_straight_on").alias("restriction"), F.lit("n").alias("via_type"), "from_id", F.col("n1").alias("via_id"), F.col("mid").alias("to_id"))
    c = directed.select(F.col("did").alias("d3"), F.col("id").alias("to_id"), F.col("u").alias("n2"))
    three = two.join(c, "n2").where("d3 % 7 = 2 and to_id <> mid")
    way = three.select((F.col("d1") * 1_000_003 + F.col("d2") + F.col("d3") * 1_000_000_007).alias("relation_id"), F.lit("no_u_turn").alias("restriction"), F.lit("w").alias("via_type"), "from_id", F.col("mid").alias("via_id"), "to_id")
    return node.unionByName(way)
