"""python -m oroflow NAME INPUT [OUTPUT]: run a registered query over a folder of Parquet tables; show it or write it."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from . import catalog

    every = catalog.queries()
    if len(args) < 2 or args[0] not in every:
        print(__doc__, "\nqueries:", *sorted(every), sep="\n  ")
        return 2
    out = every[args[0]](SparkSession.builder.appName("oroflow").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args[1])
    if len(args) > 2:
        out.write.mode("errorifexists").parquet(args[2])
    else:
        out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
