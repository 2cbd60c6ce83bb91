"""Jobs on the command line: list the registered queries, run them into Parquet, or hold them against their SQL.

    python -m skerry list
    python -m skerry run --sf DIR --out DIR [NAME ...]
    python -m skerry check --sf DIR [NAME ...]

A run leaves out the queries whose results are in the folder as a whole, so a job that was stopped goes on where it was.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from skerry.plans import registry
from skerry.sources.tables import materialise


def run(spark: SparkSession, names: Iterable[str], sf_dir: str, out: str) -> dict[str, float]:
    """Seconds by query; results that are there already take none."""
    took = {}
    for name in names:
        began = time.perf_counter()
        materialise(lambda name=name: registry.queries()[name](spark, sf_dir), spark, f"{out}/{name}")
        took[name] = time.perf_counter() - began
    return took


def check(spark: SparkSession, names: Iterable[str], sf_dir: str) -> dict[str, str]:
    """By query: equal, differs, or no SQL. Rows are compared as they are, in any order."""
    import duckdb

    con, status = duckdb.connect(), {}
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    for name in names:
        text = registry.oracle_sql().get(name)
        if text is None:
            status[name] = "no SQL"
            continue
        want, got = con.sql(text), registry.queries()[name](spark, sf_dir)
        columns = sorted(want.columns)
        rows = [sorted((tuple(r[c] for c in columns) for r in x), key=str) for x in ((dict(zip(want.columns, r, strict=True)) for r in want.fetchall()), (r.asDict() for r in got.collect()))]
        status[name] = "equal" if sorted(got.columns) == columns and rows[0] == rows[1] else "differs"
    return status


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skerry", description=__doc__.splitlines()[0])
    parser.add_argument("job", choices=("list", "run", "check"))
    parser.add_argument("names", nargs="*", help="queries; all if none is given")
    parser.add_argument("--sf", help="folder of the tables")
    parser.add_argument("--out", help="folder of the results")
    given = parser.parse_args(args)
    names = given.names or sorted(registry.queries())
    if unknown := set(names) - set(registry.queries()):
        parser.error(f"no such query: {', '.join(sorted(unknown))}")
    if given.job == "list":
        print("\n".join(f"{name}{'' if name in registry.oracle_sql() else '  (no SQL)'}" for name in names))
        return 0
    if not given.sf or given.job == "run" and not given.out:
        parser.error("--sf, and for run --out, are needed")
    spark = SparkSession.builder.appName("skerry").getOrCreate()
    if given.job == "run":
        for name, seconds in run(spark, names, given.sf, given.out).items():
            print(f"{name}  {seconds:.1f} s")
        return 0
    status = check(spark, names, given.sf)
    print("\n".join(f"{name}  {s}" for name, s in status.items()))
    return int("differs" in status.values())


if __name__ == "__main__":
    sys.exit(main())
