"""python -m kinetrail --config run.ini [--validate-config] [--list-measures] [--threads N] [--version]"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    from .plans import run as runs
    from .plans.measures import REGISTRY

    parser = argparse.ArgumentParser(prog="kinetrail")
    parser.add_argument("--config")
    parser.add_argument("--threads", default="*")
    parser.add_argument("--list-measures", action="store_true")
    parser.add_argument("--validate-config", action="store_true")
    parser.add_argument("--version", action="version", version=runs.VERSION)
    args = parser.parse_args(argv)
    if args.list_measures:
        print("\n".join(sorted(REGISTRY)))
        return 0
    if not args.config:
        parser.error("--config is required")
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("kinetrail")
    spark = SparkSession.getActiveSession() or builder.master(f"local[{args.threads}]").getOrCreate()
    try:
        if args.validate_config:
            for m in runs.validate(spark, args.config)["measures"]:
                print(m["instance"], m["type"], m["schema"])
        else:
            runs.run(spark, args.config)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
