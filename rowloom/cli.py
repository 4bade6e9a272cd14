"""python -m rowloom.cli A.csv B.csv [-o OUT]: multiply two files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from rowloom.model import Matrix, Vector
from rowloom.operators import algebra, stats
from rowloom.sources import exists, load_matrix, load_vector, operation_of, save_matrix, save_vector, sniff


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rowloom", description="Multiply two matrix or vector files.")
    p.add_argument("files", nargs="*", help="the two operands")
    p.add_argument("-a", "--input-a")
    p.add_argument("-b", "--input-b")
    p.add_argument("-o", "--output")
    p.add_argument("--master", default=None)
    p.add_argument("--memory", default=None, help="spark.executor.memory and, in local mode, the driver's")
    p.add_argument("--log-level", default="ERROR")
    p.add_argument("--strategy", default="adaptive")
    p.add_argument("--format", dest="layout", default="auto", choices=["auto", "coo", "csr", "csc", "dense"])
    p.add_argument("--vector-type", default="auto", choices=["auto", "sparse", "dense"])
    p.add_argument("--no-preview", action="store_true")
    p.add_argument("--no-stats", action="store_true")
    return p


def load(spark: SparkSession, path: str, kind: str, args: argparse.Namespace) -> Matrix | Vector:
    if kind == "vector":
        return load_vector(spark, path, args.vector_type == "sparse", args.vector_type == "dense")
    m = load_matrix(spark, path, force_dense=args.layout == "dense", force_sparse=args.layout in ("coo", "csr", "csc"))
    return m.to(args.layout) if args.layout in ("csr", "csc") else m


def run(spark: SparkSession, args: argparse.Namespace) -> Matrix | Vector:
    a, b = args.input_a or args.files[0], args.input_b or args.files[-1]
    for path in (a, b):
        if not exists(spark, path):
            raise FileNotFoundError(f"no file {path}")
    kinds = sniff(spark, a), sniff(spark, b)
    operation_of(*kinds)
    result = algebra.dispatch(load(spark, a, kinds[0], args), load(spark, b, kinds[1], args), args.strategy)
    vector = isinstance(result, Vector)
    df = (result.df if vector else result.coo()).persist()  # one evaluation for the count, the files and the summary
    try:
        print(f"{kinds[0]} times {kinds[1]}: {df.count()} entries")
        if args.output:
            (save_vector if vector else save_matrix)(df, args.output)
        if not args.no_preview:
            df.orderBy(*(["idx"] if vector else ["row", "col"])).limit(10).show(truncate=False)
        if not args.no_stats:
            (stats.vector_stats if vector else stats.matrix_stats)(df).show(truncate=False)
    finally:
        df.unpersist()
    return result


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if len([x for x in (args.input_a, args.input_b, *args.files) if x]) != 2:
        p.print_usage()
        return 1
    builder = SparkSession.builder.appName("rowloom")
    if args.master:
        builder = builder.master(args.master)
    if args.memory:
        builder = builder.config("spark.executor.memory", args.memory).config("spark.driver.memory", args.memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(args.log_level)
    try:
        run(spark, args)
    except Exception as e:  # noqa: BLE001 - the command line reports and returns a status
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
