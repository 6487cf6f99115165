"""Well-known text of points and lines, to and from struct(lon, lat)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?"


def _pair(text: Column) -> Column:
    parts = F.split(F.trim(text), r"\s+")
    return F.struct(F.get(parts, F.lit(0)).cast("double").alias("lon"), F.get(parts, F.lit(1)).cast("double").alias("lat"))


def parse_point(text: Column) -> Column:
    """struct(lon, lat), or null for anything but POINT(x y)."""
    inside = F.regexp_extract(text, rf"^\s*POINT\s*\(\s*({_NUMBER}\s+{_NUMBER})\s*\)\s*$", 1)
    return F.when(F.length(inside) > 0, _pair(inside))


def parse_line(text: Column) -> Column:
    """array<struct(lon, lat)>, or null for anything but LINESTRING(x y, ...)."""
    inside = F.regexp_extract(text, rf"^\s*LINESTRING\s*\(\s*({_NUMBER}\s+{_NUMBER}(?:\s*,\s*{_NUMBER}\s+{_NUMBER})*)\s*\)\s*$", 1)
    return F.when(F.length(inside) > 0, F.transform(F.split(inside, ","), _pair))


def _text(point: Column, digits: int) -> Column:
    number = lambda x: F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.concat_ws(" ", number(point["lon"]), number(point["lat"]))


def point_text(point: Column, digits: int = 10) -> Column:
    return F.concat(F.lit("POINT("), _text(point, digits), F.lit(")"))


def line_text(points: Column, digits: int = 10) -> Column:
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(points, lambda p: _text(p, digits)), ","), F.lit(")"))
