"""Tables on disk: Parquet, and CSV with fixed decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id BIGINT, lon DOUBLE, lat DOUBLE, type STRING, elevation INT, relation_ids ARRAY<BIGINT>, cycling STRING, hiking STRING"
EDGES = "id BIGINT, type STRING, oneway SMALLINT, nodes ARRAY<BIGINT>, relation_ids ARRAY<BIGINT>, geom ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>, tags MAP<STRING, STRING>, u BIGINT, v BIGINT, length FLOAT, elevation INT, cycling STRING, hiking STRING"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table in key ranges, read side by side."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, clustered by a column if one is named."""
    (df.repartitionByRange(by).sortWithinPartitions(by) if by else df).write.mode("overwrite").parquet(path)


def fixed(x: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.col(x).cast("double")).alias(x)


def write_nodes_csv(nodes: DataFrame, path: str) -> None:
    nodes.select("id", fixed("lon", 7), fixed("lat", 7), "elevation").write.mode("overwrite").csv(path, header=True)


def write_edges_csv(edges: DataFrame, path: str) -> None:
    edges.select("id", "u", "v", "oneway", fixed("length", 5), "elevation").write.mode("overwrite").csv(path, header=True)


def write_segments_csv(segments: DataFrame, path: str) -> None:
    segments.write.mode("overwrite").csv(path, header=True)


def split_line(line: Column) -> Column:
    """A line's fields by commas; no quotes, and an empty last field is dropped."""
    parts = F.split(line, ",")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)
