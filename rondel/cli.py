"""Commands on tables and folders of runs; a command that finds faults prints them and ends with 1.

``queries`` lists the queries, ``run NAME TABLES [OUT]`` runs one, ``profile NAME`` prints settings, ``profiles`` their names. ``report OUTCOMES`` prints
reach metrics of a Parquet table, ``resume STEPS`` where each chain goes on. ``seal ROOT OUT`` stores the digests of a folder's files, ``verify ROOT SEAL``
compares them, ``check-files ROOT MANIFEST`` holds files against a CSV of path and sha256, ``diagnose ROOT`` sums up saved calls and steps.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMANDS = {
    "queries": (), "run": ("name", "tables", "out?"), "profile": ("name",), "profiles": (), "report": ("outcomes",), "resume": ("steps",), "seal": ("root", "out"), "verify": ("root", "seal"), "check-files": ("root", "manifest"), "diagnose": ("root",),
}


def _faults(found: DataFrame) -> int:
    """Print up to 1,000 faults; 1 if there are any."""
    rows = found.take(1000)
    for row in rows:
        print("\t".join("" if x is None else str(x) for x in row))
    return int(bool(rows))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rondel", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, fields in COMMANDS.items():
        command = commands.add_parser(name)
        for f in fields:
            command.add_argument(f.rstrip("?"), nargs="?" if f.endswith("?") else None)
    chosen = parser.parse_args(arguments)
    from rondel import queries, registry
    from rondel.operators import outcomes, replay
    from rondel.sources import checked, evidence, tables

    if chosen.command == "queries":
        print("\n".join(sorted(queries.QUERIES)))
        return 0
    if chosen.command == "profile":
        print(json.dumps(registry.profile(chosen.name), indent=2))
        return 0
    if chosen.command == "profiles":
        print("\n".join(sorted(registry.PROFILES)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if chosen.command == "run":
        found = queries.QUERIES[chosen.name](spark, chosen.tables)
        if chosen.out:
            found.write.parquet(chosen.out)
        else:
            found.show(100, False)
    elif chosen.command == "report":
        print(tables.markdown(outcomes.reach_metrics(spark.read.parquet(chosen.outcomes), "route").orderBy("route")))
    elif chosen.command == "resume":
        replay.resume_plan(spark.read.parquet(chosen.steps), F.col("status").isNotNull()).orderBy("trial").show(1000, False)
    elif chosen.command == "seal":
        evidence.seal(spark, chosen.root).write.parquet(chosen.out)
    elif chosen.command == "verify":
        return _faults(evidence.seal_faults(spark, chosen.root, spark.read.parquet(chosen.seal)))
    elif chosen.command == "check-files":
        return _faults(checked.checked_files(spark, chosen.root, tables.csv(spark, chosen.manifest)).drop("content").filter("status <> 'ok'"))
    else:
        checked.call_diagnostics(spark, chosen.root).show(truncate=False)
        checked.step_diagnostics(spark, chosen.root).show(1000, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
