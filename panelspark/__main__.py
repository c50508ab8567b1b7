"""Run a registered query from the command line: ``python -m panelspark list`` or ``... run QUERY FOLDER OUT``.

With ``spark-submit`` the session's own settings hold; on a cluster name ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from panelspark import catalog


def main(args: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="panelspark", description=__doc__.splitlines()[0])
    todo = parser.add_subparsers(dest="todo", required=True)
    todo.add_parser("list", help="names of the queries; * for those with SQL")
    run = todo.add_parser("run", help="write a query's result as Parquet")
    run.add_argument("query")
    run.add_argument("folder", help="where NAME.parquet stands for each table")
    run.add_argument("out")
    told = parser.parse_args(args)
    catalog.load()
    if told.todo == "list":
        print("\n".join(f"{q} *" if q in catalog.ORACLES else q for q in sorted(catalog.QUERIES)))
        return 0
    if told.query not in catalog.QUERIES:
        parser.error(f"no query {told.query}")
    catalog.QUERIES[told.query](SparkSession.builder.getOrCreate(), told.folder).write.mode("overwrite").parquet(told.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
