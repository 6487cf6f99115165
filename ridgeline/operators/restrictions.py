"""Turn restrictions: from relations to banned pairs of directed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify(restriction: Column, via_type: Column, ways_as_edges: bool = False) -> Column:
    """nn, no, en or eo: via a node or an edge, no_* or only_*. Ingest writes ways as 'w', which only the option reads."""
    edge = via_type.isin("e", "w") if ways_as_edges else via_type == "e"
    via = F.when(via_type == "n", "n").when(edge, "e")
    rule = F.when(restriction.like("no%"), "n").when(restriction.like("only%"), "o")
    return F.concat(via, rule)


def relation_ids(restrictions: DataFrame) -> DataFrame:
    """(id, relation_ids): the relations that turn at each node, sorted."""
    return restrictions.where("via_type = 'n'").groupBy(F.col("via_id").alias("id")).agg(F.sort_array(F.collect_list("relation_id")).alias("relation_ids"))


def _turns(restrictions: DataFrame, directed: DataFrame) -> DataFrame:
    """(from_did, to_did, rule) of both kinds of via."""
    edge = lambda name: directed.select(F.col("id").alias(f"{name}_id"), F.col("did").alias(f"{name}_did"), F.col("u").alias(f"{name}_u"), F.col("v").alias(f"{name}_v"))
    rule = F.substring("type_enum", 2, 1)
    node = restrictions.where("type_enum in ('nn', 'no')").withColumn("rule", rule)
    at_node = node.join(edge("from").withColumn("via_id", F.col("from_v")), ["from_id", "via_id"]).join(edge("to").withColumn("via_id", F.col("to_u")), ["to_id", "via_id"])
    at_node = at_node.select("from_did", "to_did", "rule")
    way = restrictions.where("type_enum in ('en', 'eo')").select("from_id", "via_id", "to_id", rule.alias("rule")).distinct()
    onward = way.join(edge("via"), "via_id").join(edge("to"), "to_id").where("to_u = via_v")
    first = Window.partitionBy("from_id", "via_id", "to_id", "rule").orderBy("via_did", "to_did")
    chosen = onward.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    whole = chosen.join(edge("from"), "from_id").where("from_v = via_u")
    chain = F.explode(F.array(F.struct(F.col("from_did").alias("a"), F.col("via_did").alias("b")), F.struct(F.col("via_did").alias("a"), F.col("to_did").alias("b"))))
    at_way = whole.select(chain.alias("t"), "rule").select(F.col("t.a").alias("from_did"), F.col("t.b").alias("to_did"), "rule")
    return at_node.unionByName(at_way)


def banned_turns(restrictions: DataFrame, directed: DataFrame) -> DataFrame:
    """(from_did, to_did): no_* bans its turn; only_* bans every other edge that leaves the same node."""
    turns = _turns(restrictions, directed)
    no = turns.where("rule = 'n'").select("from_did", "to_did")
    only = turns.where("rule = 'o'").join(directed.select(F.col("did").alias("to_did"), F.col("u").alias("at")), "to_did")
    others = only.withColumnRenamed("to_did", "kept").join(directed.select(F.col("did").alias("to_did"), F.col("u").alias("at")), "at").where("to_did <> kept").select("from_did", "to_did")
    return no.unionByName(others).distinct()


def allowed_turns(directed: DataFrame, banned: DataFrame) -> DataFrame:
    """(from_did, to_did): consecutive directed edges whose turn isn't banned (U-turns count)."""
    before = directed.select(F.col("did").alias("from_did"), F.col("v").alias("at"))
    after = directed.select(F.col("did").alias("to_did"), F.col("u").alias("at"))
    return before.join(after, "at").select("from_did", "to_did").join(banned, ["from_did", "to_did"], "left_anti")


def restriction_json(node_id: Column, pairs: Column) -> Column:
    """A node and its bans as JSON: from-edge to the edges that may not follow."""
    return F.to_json(F.struct(node_id.alias("id"), F.map_from_entries(pairs).alias("restrictions")))


def node_restrictions(directed: DataFrame, banned: DataFrame) -> DataFrame:
    """(id, json) for each node at which a turn is banned."""
    at = banned.join(directed.select(F.col("did").alias("from_did"), F.col("id").alias("from_id"), F.col("v").alias("node")), "from_did").join(directed.select(F.col("did").alias("to_did"), F.col("id").alias("to_id")), "to_did")
    lists = at.groupBy("node", "from_id").agg(F.sort_array(F.collect_set("to_id")).alias("to"))
    nodes = lists.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("from_id").cast("string").alias("key"), F.col("to").alias("value")))).alias("pairs"))
    return nodes.select(F.col("node").alias("id"), restriction_json(F.col("node"), F.col("pairs")).alias("json"))
