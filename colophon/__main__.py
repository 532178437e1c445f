"""python -m colophon QUERY DATA OUT [--overwrite]: runs a query of the catalogue and writes Parquet; without arguments lists the queries."""

from __future__ import annotations

import argparse
from collections.abc import Callable


def run(found: dict[str, Callable], name: str) -> None:
    """Runs one of the queries by the arguments of the command line."""
    parser = argparse.ArgumentParser(prog=name, description="Runs a query and writes Parquet; without arguments lists the queries.")
    parser.add_argument("query", nargs="?", choices=sorted(found))
    parser.add_argument("data", nargs="?", help="folder of the Parquet tables")
    parser.add_argument("out", nargs="?", help="folder of the result")
    parser.add_argument("--overwrite", action="store_true")
    given = parser.parse_args()
    if not given.query:
        print("\n".join(sorted(found)))
        return
    if not given.data or not given.out:
        parser.error("data and out are needed")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"{name} {given.query}").getOrCreate()
    found[given.query](spark, given.data).write.mode("overwrite" if given.overwrite else "errorifexists").parquet(given.out)


if __name__ == "__main__":
    from colophon.plans import catalog

    run(catalog.queries(), "colophon")
