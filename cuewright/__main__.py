"""``python -m cuewright qa FILE`` and ``python -m cuewright evaluate REFERENCE FILE``, each with ``--json``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.operators import evaluate, quality
from cuewright.session import ship_package
from cuewright.sources.srt import load_srt


def main() -> None:
    parser = argparse.ArgumentParser(prog="cuewright")
    parser.add_argument("command", choices=["qa", "evaluate"])
    parser.add_argument("files", nargs="+")
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args()
    if len(args.files) != {"qa": 1, "evaluate": 2}[args.command]:
        parser.error("qa takes one file, evaluate two")
    spark = SparkSession.builder.appName("cuewright").config("spark.ui.enabled", "false").getOrCreate()
    ship_package(spark)
    # Every file is one film here, whatever its path.
    tables = [load_srt(spark, f).withColumn("film", F.lit(0)) for f in args.files]
    out: DataFrame = quality.score(tables[0]) if args.command == "qa" else evaluate.compare(*tables)
    for row in out.drop("film").collect():
        if args.json:
            print(json.dumps(row.asDict()))
        else:
            print("\n".join(f"{k:28} {v}" for k, v in row.asDict().items()))


if __name__ == "__main__":
    main()
