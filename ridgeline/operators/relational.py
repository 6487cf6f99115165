"""Pages, counts and markers of tables that are taken piece by piece."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a page.
PAGE = 100_000


def page(rows: DataFrame, after, size: int = PAGE, key: str = "id") -> DataFrame:
    """The next rows by key."""
    return rows.where(F.col(key) > after).orderBy(key).limit(size)


def row_count(rows: DataFrame, after=None, key: str = "id") -> DataFrame:
    return (rows if after is None else rows.where(F.col(key) > after)).agg(F.count("*").alias("n"))


def point_total(ways: DataFrame, after=None, key: str = "id") -> DataFrame:
    return (ways if after is None else ways.where(F.col(key) > after)).agg(F.coalesce(F.sum(F.size("geom")), F.lit(0)).cast("long").alias("n"))


def last_key(rows: DataFrame, key: str = "id") -> DataFrame:
    """Where to go on: the largest key, -1 for none."""
    return rows.agg(F.coalesce(F.max(key), F.lit(-1)).cast("long").alias("last"))


def spread(points: DataFrame) -> DataFrame:
    """Centroid, summed squared distance from it along each axis, and the axis of larger spread."""
    stats = points.agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), (F.var_pop("lon") * F.count("lon")).alias("lon_spread"), (F.var_pop("lat") * F.count("lat")).alias("lat_spread"))
    return stats.withColumn("axis", F.when(F.col("lon_spread") > F.col("lat_spread"), "lon").otherwise("lat"))


#: Bins in which a median is looked for before its own bin is sorted.
BINS = 65_536


def median_split(points: DataFrame, axis: str) -> DataFrame:
    """points with half: 0 for the smaller half by (axis, id), 1 for the rest. Points are counted in bins along the axis;
    only the bin of the median is sorted."""
    low, high, n = points.agg(F.min(axis), F.max(axis), F.count("*")).first()
    if not n:
        return points.withColumn("half", F.lit(0))
    width = (high - low) / BINS or 1.0
    binned = points.withColumn("_bin", F.least(F.floor((F.col(axis) - low) / width), F.lit(BINS - 1)).cast("int"))
    counts = binned.groupBy("_bin").agg(F.count("*").alias("k")).orderBy("_bin").collect()  # BINS rows at most
    before, middle = 0, None
    for r in counts:
        if before + r.k > n // 2:
            middle = r._bin
            break
        before += r.k
    order = F.row_number().over(Window.partitionBy("_bin").orderBy(axis, "id"))
    inner = binned.where(F.col("_bin") == middle).withColumn("half", (order > n // 2 - before).cast("int"))
    return binned.where(F.col("_bin") != middle).withColumn("half", (F.col("_bin") > middle).cast("int")).unionByName(inner).drop("_bin")


def radius(points: DataFrame, lon, lat) -> DataFrame:
    """Centimetres from a centre to the farthest point."""
    from ridgeline.functions.geo import distance_cm

    return points.agg(F.max(distance_cm("lon", "lat", F.lit(lon), F.lit(lat))).alias("radius_cm"))


def cells(points: DataFrame, size: float) -> DataFrame:
    """points with their grid cell: what a partitioned spatial layout is clustered by."""
    return points.withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)})
