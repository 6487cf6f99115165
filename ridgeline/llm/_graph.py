"""Connected components of an edge table, by alternating large and small stars; no edge reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


def components(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that it reaches."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = work.put(f"{name}-0", edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct())
    seen, turn = None, 0
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or state == seen:
            break
        seen, turn = state, turn + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = work.put(f"{name}-{turn}", small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        work.drop(f"{name}-{turn - 1}")
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the ids of rows (a) and columns (b) of mask as its entries do."""
    edges, left, right = [], mask.any(1), mask.any(0)
    for start in np.flatnonzero(left):
        if not left[start]:
            continue
        rows, left[start] = np.array([start]), False
        while len(rows):
            columns = np.flatnonzero(mask[rows].any(0) & right)
            right[columns] = False
            edges += [(int(a[start]), int(x)) for x in b[columns]]
            rows = np.flatnonzero(mask[:, columns].any(1) & left) if len(columns) else columns
            left[rows] = False
            edges += [(int(a[start]), int(x)) for x in a[rows]]
    return edges
