"""Command line: ``python -m tarnql query SQL``, ``zonemap FILE``, ``help``, or just SQL."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import EngineError
from .operators.order import CHUNK
from .output import write_table
from .plans.planner import sql
from .sources.zonemap import generate_zone_map, save_zone_map

USAGE = """Usage:
  python -m tarnql query "SELECT name, age FROM `users.csv` WHERE age > 25 LIMIT 10"
  python -m tarnql q     "SELECT category, SUM(amount) FROM `sales.csv` GROUP BY category"
  python -m tarnql zonemap data.csv      (or zm) write data.zonemap.json
  python -m tarnql "SELECT * FROM `data.csv`"
  python -m tarnql help
Options: -sort-chunk-size N   checked and otherwise left to Spark (default 1000)"""


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarnql", add_help=False)
    parser.add_argument("-sort-chunk-size", "--sort-chunk-size", type=int, default=CHUNK, dest="chunk")
    parser.add_argument("words", nargs="*")
    args = parser.parse_args(argv)
    if not args.words or args.words[0] == "help":
        print(USAGE)
        return 0 if args.words else 1
    command, rest = args.words[0], args.words[1:]
    if command in ("query", "q", "zonemap", "zm") and not rest:
        print(USAGE, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("tarnql").getOrCreate()
    try:
        if command in ("zonemap", "zm"):
            zm = generate_zone_map(spark, rest[0])
            print(zm.summary())
            print(f"Saved {save_zone_map(zm)}")
        else:
            text = " ".join(rest if command in ("query", "q") else args.words)
            write_table(sql(spark, text, chunk=args.chunk))
    except (EngineError, OSError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
