"""python -m ridgeline.cli build|route ...: builds a profile's graph, or answers a table of requests."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ridgeline.operators.profiles import Profile
from ridgeline.operators.requests import batch
from ridgeline.plans import build


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    todo = parser.add_subparsers(dest="what", required=True)
    make = todo.add_parser("build", help="ways, relations, heights -> nodes, directed, banned, geometry")
    for name in ("ways", "relations", "heights", "out"):
        make.add_argument(name)
    make.add_argument("--profile", default="hiking", choices=[p.value for p in Profile])
    ask = todo.add_parser("route", help="a built graph and batches of requests -> responses")
    for name in ("graph", "requests", "out"):
        ask.add_argument(name)
    ask.add_argument("--seconds", type=float, default=None, help="time for one search; without it epochs alone decide")
    ask.add_argument("--epochs", type=int, default=100)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"ridgeline {given.what}").getOrCreate()
    read = spark.read.parquet
    if given.what == "build":
        tables = build.derive(read(given.ways), read(given.relations), read(given.heights))
        for name, df in build.load(tables, Profile(given.profile)).items():
            df.write.mode("overwrite").parquet(f"{given.out}/{name}")
    else:
        parts = {n: read(f"{given.graph}/{n}") for n in ("nodes", "directed", "geometry", "banned")}
        limit = None if given.seconds is None else given.seconds * 900
        batch(read(given.requests), parts["nodes"], parts["directed"], parts["geometry"], parts["banned"], epochs=given.epochs, milliseconds=limit).write.mode("overwrite").parquet(given.out)


if __name__ == "__main__":
    main()
