"""A small shell over :class:`millrace.ask.Assistant`: ``python -m millrace.cli FOLDER [--exec] [QUESTION]``."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("folder", help="folder of the tables, one Parquet each")
    p.add_argument("question", nargs="*", help="a question; without one, questions are read line by line")
    p.add_argument("--exec", action="store_true", help="run the SQL (default: only show it)")
    p.add_argument("--sql", action="store_true", help="the input is SQL already")
    p.add_argument("--tenant", type=int, help="the tenant whose rows may be seen")
    p.add_argument("--all-tenants", action="store_true", help="rows of all tenants may be seen")
    args = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from .ask import Assistant
    from .catalog import driver_catalog
    from .sqlx.execute import Engine

    spark = SparkSession.builder.appName("millrace").getOrCreate()
    engine = Engine(spark, driver_catalog(), lambda t: spark.read.parquet(f"{args.folder}/{t}.parquet"), args.all_tenants)
    assistant, run = Assistant(engine), args.exec
    for line in [" ".join(args.question)] if args.question else sys.stdin:
        line = line.strip()
        if line in (":quit", ":q"):
            break
        if line in (":exec", ":dry"):
            run = line == ":exec"
        elif line == ":help":
            print(":exec :dry :help :quit, or a question")
        elif line:
            if args.sql:
                r = engine.execute_query(line, args.tenant)
                print(r.verdict.message if not r.verdict.passed else f"{r.row_count} rows")
                for row in r.rows[:100]:
                    print(row)
                continue
            a = assistant.ask(line, args.tenant, dry=not run)
            print(a.error or a.sql)
            for row in a.result.rows[:100] if a.result else []:
                print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
