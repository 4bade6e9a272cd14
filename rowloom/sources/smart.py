"""Looking at a file before loading it."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rowloom.model import SPARSE_ABOVE, EmptyInputError, Matrix, Vector
from rowloom.operators.stats import dimensions
from rowloom.sources import csv


def load_matrix(spark: SparkSession, path: str, force_sparse: bool = False, force_dense: bool = False) -> Matrix:
    """Shape, count and sparsity in one job; sparse above the threshold, dense otherwise; force_sparse wins."""
    df = csv.load_sparse_matrix(spark, path)
    d = dimensions(df).first()
    if not d.nnz:
        raise EmptyInputError(f"no entries in {path}")
    sparse = force_sparse or (not force_dense and d.sparsity > SPARSE_ABOVE)
    return Matrix(df, d.num_rows, d.num_cols, "coo" if sparse else "dense")


def load_vector(spark: SparkSession, path: str, force_sparse: bool = False, force_dense: bool = False) -> Vector:
    """Read strictly, zeros included and counted as entries."""
    df = csv.load_dense_vector(spark, path)
    d = df.agg(F.max("idx").alias("top"), F.count(F.lit(1)).alias("n")).first()
    if not d.n:
        raise EmptyInputError(f"no entries in {path}")
    size = d.top + 1
    sparse = force_sparse or (not force_dense and 1.0 - d.n / size > SPARSE_ABOVE)
    return Vector(df, size, "sparse" if sparse else "dense")


def sniff(spark: SparkSession, path: str) -> str:
    """'vector' for lines of two fields, 'matrix' for three."""
    lines = spark.read.text(path)
    low = F.lower(F.trim("value"))
    lines = lines.where((low != "") & ~low.startswith("row") & ~low.startswith("index") & ~low.startswith("i,"))
    first = lines.limit(5).take(1)
    if not first:
        raise EmptyInputError(f"no data lines in {path}")
    fields = len(first[0][0].split(","))
    if fields not in (2, 3):
        raise ValueError(f"{path} has {fields} fields; 2 make a vector and 3 a matrix")
    return {2: "vector", 3: "matrix"}[fields]


def operation_of(kind_a: str, kind_b: str) -> str:
    if kind_a == kind_b == "vector":
        raise ValueError("vector times vector is not supported")
    return f"{kind_a}-{kind_b}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def discover(spark: SparkSession, folder: str, category: str | None = None) -> list[dict]:
    """Pairs sparse_matrix_RxC*.csv with dense_vector_N*.csv where N is the matrix's number of columns, of one size category or all."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    names = sorted(f.getPath().getName() for f in listed)
    vectors = {int(m[1]): n for n in reversed(names) if (m := re.fullmatch(r"dense_vector_(\d+).*\.csv", n))}
    found = []
    for name in names:
        if m := re.fullmatch(r"sparse_matrix_(\d+)x(\d+).*\.csv", name):
            rows, cols = int(m[1]), int(m[2])
            size = "small" if rows < 1000 else "medium" if rows < 10000 else "large" if rows < 20000 else "extra-large"
            if cols in vectors and category in (None, size):
                found.append({"matrix": f"{folder}/{name}", "vector": f"{folder}/{vectors[cols]}", "rows": rows, "cols": cols, "category": size})
    return found
