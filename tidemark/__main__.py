"""Command line: python -m tidemark ACTION INPUT OUTPUT RUN_ID, or smoke INPUT.

INPUT is a folder of tables or, for the actions that need accesses only, a raw log as
kind:path, such as csv:/data/logs (csv, json, orc, parquet).

One argument that ends in .toml, .yaml or .yml names a file with these as action, input,
output and run_id, and Spark settings in a table called spark. YAML needs PyYAML.
"""

from __future__ import annotations

import sys
import tomllib

from pyspark.sql import SparkSession

from tidemark.plans import experiments


def configured(path: str) -> tuple[list[str], dict[str, str]]:
    """(arguments, Spark settings) of a configuration file."""
    with open(path, "rb") as f:
        if path.endswith(".toml"):
            given = tomllib.load(f)
        else:
            import yaml  # an optional package

            given = yaml.safe_load(f)
    if not isinstance(given, dict):
        raise ValueError(f"{path}: no table of settings")
    settings = {k: str(v) for k, v in (given.pop("spark", None) or {}).items()}
    names = ("action", "input", "output", "run_id")
    if unknown := set(given) - set(names):
        raise ValueError(f"{path}: unknown keys {', '.join(sorted(unknown))}")
    return [str(given[n]) for n in names if n in given], settings


def main(args: list[str]) -> int:
    settings: dict[str, str] = {}
    if len(args) == 1 and args[0].endswith((".toml", ".yaml", ".yml")):
        args, settings = configured(args[0])
    if len(args) not in (2, 4) or (args[0] == "smoke") != (len(args) == 2):
        print(f"{__doc__}\nActions: smoke, {', '.join(experiments.ACTIONS)}")
        return 2
    spark = SparkSession.builder.appName(f"tidemark {args[0]}").config(map=settings).getOrCreate()
    if args[0] == "smoke":
        rows = experiments.smoke(spark, args[1]).collect()
        print(*[f"{r.table}: {'ok' if r.has_rows else 'empty'}" for r in rows], sep="\n")
        needs = experiments.dependencies(spark).collect()
        print(*[f"{r.package}: driver {r.driver}, workers {', '.join(r.workers) or None}" for r in needs], sep="\n")
        return int(not (all(r.has_rows for r in rows) and all(r.same for r in needs)))
    print(*experiments.run(spark, *args), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
