"""Itineraries: markers, legs between them, their totals, and results that are still valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.geo import between, distance_km


def legs(markers: DataFrame) -> DataFrame:
    """(itinerary_id, leg, lon1, lat1, lon2, lat2) from markers (itinerary_id, position, lon, lat)."""
    by = Window.partitionBy("itinerary_id").orderBy("position")
    pairs = markers.withColumns({"leg": F.row_number().over(by) - 1, "lon2": F.lead("lon").over(by), "lat2": F.lead("lat").over(by)})
    return pairs.where("lon2 is not null").select("itinerary_id", "leg", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "lon2", "lat2")


def _renumbered(markers: DataFrame, order: Column) -> DataFrame:
    by = Window.partitionBy("itinerary_id").orderBy(order, "position")
    return markers.withColumn("_p", (F.row_number().over(by) - 1).cast("int")).drop("position").withColumnRenamed("_p", "position").select("itinerary_id", "position", "lon", "lat")


def insert(markers: DataFrame, at: int, lon: float, lat: float) -> DataFrame:
    """A marker comes to stand at a position of every itinerary."""
    moved = markers.withColumn("position", F.when(F.col("position") >= at, F.col("position") + 1).otherwise(F.col("position")).cast("int"))
    new = markers.select("itinerary_id").distinct().select("itinerary_id", F.lit(at).alias("position"), F.lit(lon).alias("lon"), F.lit(lat).alias("lat"))
    return _renumbered(moved.unionByName(new), F.col("position"))


def extract(markers: DataFrame, at: int) -> DataFrame:
    return _renumbered(markers.where(F.col("position") != at), F.col("position"))


def move(markers: DataFrame, start: int, to: int) -> DataFrame:
    place = F.when(F.col("position") == start, F.lit(to + (0.5 if to > start else -0.5))).otherwise(F.col("position").cast("double"))
    return _renumbered(markers, place)


def switch(markers: DataFrame, a: int, b: int) -> DataFrame:
    return _renumbered(markers, F.when(F.col("position") == a, b).when(F.col("position") == b, a).otherwise(F.col("position")))


def totals(results: DataFrame, group: str = "itinerary_id") -> DataFrame:
    """Legs, length and gain by path type, over results that are up to date; and the longest leg."""
    return results.where("up_to_date").groupBy(group, "path_type").agg(F.count("*").alias("legs"), F.sum("length").alias("length"), F.sum("gain").alias("gain"), F.max("length").alias("longest"))


def still_needed(requests: DataFrame, results: DataFrame, digits: int = 5) -> DataFrame:
    """Requests without a result for the same ends (at so many decimals), type and ratio."""
    names = ("lon1", "lat1", "lon2", "lat2")
    rounded = lambda df: df.withColumns({f"_{n}": F.round(F.col(n), digits) for n in names})
    keys = [*(f"_{n}" for n in names), "path_type", "ratio"]
    return rounded(requests).join(rounded(results).select(*keys).distinct(), keys, "left_anti").drop(*(f"_{n}" for n in names))


def same_place(lon1: Column, lat1: Column, lon2: Column, lat2: Column, digits: int = 5) -> Column:
    return (F.round(lon1, digits) == F.round(lon2, digits)) & (F.round(lat1, digits) == F.round(lat2, digits))


def too_far(seconds: Column, turns: Column, km: Column) -> Column:
    """Whether a request asks for more than its time allows: 17 km a second (twice that for turns) up to a minute."""
    return (seconds <= 60) & (seconds * 17 * (turns.cast("int") + 1) < km)


def leg_distance(rows: DataFrame) -> DataFrame:
    return rows.withColumn("km", distance_km("lon1", "lat1", "lon2", "lat2"))


def markers_every(rows: DataFrame, every: int, path: str = "path_id") -> DataFrame:
    """(path_id, mark, lon, lat): points each ``every`` units along a path of segments (pos, length, lon1, lat1, lon2, lat2)."""
    so_far = Window.partitionBy(path).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("to", F.sum("length").over(so_far)).withColumn("from", F.col("to") - F.col("length"))
    first, last = (F.floor(F.col("from") / every) + 1).cast("long"), F.floor(F.col("to") / every).cast("long")
    marks = ends.where(last >= first).withColumn("mark", F.explode(F.sequence(first, last)))
    share = (F.col("mark") * every - F.col("from")) / F.col("length")
    return marks.select(path, "mark", between("lon1", "lon2", share).alias("lon"), between("lat1", "lat2", share).alias("lat"))
