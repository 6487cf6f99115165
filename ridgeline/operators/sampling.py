"""Seeded random choices and orders: the same for equal seeds, on any number of machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows are numbered in so many ranges of the draw, side by side.
RANGES = 256


def draw(seed: int, key: Column) -> Column:
    """A row's lot: 32 hexadecimal digits that order rows at random."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def choose(rows: DataFrame, k: int, seed: int, key: str = "id") -> DataFrame:
    """k rows of equal chance; each task sends on k rows at most."""
    return rows.orderBy(draw(seed, F.col(key)), key).limit(k)


def pick(rows: DataFrame, seed: int, group: str, key: str = "id") -> DataFrame:
    """One row of each group, of equal chance, by map-side combined aggregation."""
    rest = [c for c in rows.columns if c != group]
    return rows.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(draw(seed, F.col(key)), F.col(key))).alias("_r")).select(group, "_r.*")


def shuffled(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """rows with position, a random order from 0 without gaps: lots are dealt to ranges by their first two digits, ranges
    are counted, and each numbers its own rows."""
    lots = rows.withColumn("_lot", draw(seed, F.col(key))).withColumn("_range", F.conv(F.substring("_lot", 1, 2), 16, 10).cast("int"))
    before = lots.groupBy("_range").agg(F.count("*").alias("_n")).selectExpr("_range", "sum(_n) over (order by _range) - _n as _from")  # RANGES rows
    inside = lots.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy("_lot", key)) - 1)
    return inside.join(F.broadcast(before), "_range").withColumn("position", F.col("_from") + F.col("_at")).drop("_lot", "_range", "_from", "_at")
