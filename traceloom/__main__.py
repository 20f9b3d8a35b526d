"""python -m traceloom list | run NAME FOLDER [--to PATH] | explain NAME FOLDER | generate COUNT PATH"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from traceloom.plans import catalogue
from traceloom.sources import jsonl


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("traceloom")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        one = sub.add_parser(name)
        one.add_argument("name", choices=sorted(catalogue.QUERIES))
        one.add_argument("folder")
        if name == "run":
            one.add_argument("--to")
    made = sub.add_parser("generate")
    made.add_argument("count", type=int)
    made.add_argument("path")
    a = p.parse_args(argv)
    if a.what == "list":
        print(*sorted(catalogue.QUERIES), sep="\n")
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.what == "generate":
        jsonl.written(jsonl.generated(spark, a.count), a.path)
        return 0
    df = catalogue.QUERIES[a.name](spark, a.folder)
    if a.what == "explain":
        df.explain("formatted")
    elif a.to:
        df.write.parquet(a.to)
    else:
        df.show(50, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
