"""Containers: a DataFrame plus its shape.

Everything is a relation keyed by bigint indices with double values:

* matrix in layout ``coo`` or ``dense``: (row, col, value); ``csr``: (row, col_indices, values); ``csc``: (col, row_indices, values)
* vector: (idx, value), kind ``dense`` or ``sparse``
* 3-way tensor: (i, j, k, value); N-way: (indices array, value)
* factor matrix in long form: (idx, r, value)
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import not_zero

LAYOUTS = ("coo", "csr", "csc", "dense")
#: Strictly above this share of absent cells a matrix or vector counts as sparse.
SPARSE_ABOVE = 0.90

COO_SCHEMA = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("value", T.DoubleType())])
VECTOR_SCHEMA = T.StructType([T.StructField("idx", T.LongType()), T.StructField("value", T.DoubleType())])
TENSOR_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in "ijk"] + [T.StructField("value", T.DoubleType())])


def as_coo(df: DataFrame) -> DataFrame:
    """Project to the canonical matrix columns and types."""
    return df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))


def as_vector(df: DataFrame) -> DataFrame:
    return df.select(F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))


class EmptyInputError(ValueError):
    """Raised where a shape has to be inferred from no entries."""


@dataclass(frozen=True)
class Vector:
    df: DataFrame
    size: int
    kind: str = "dense"

    @classmethod
    def of(cls, df: DataFrame, size: int | None = None, kind: str = "dense") -> Vector:
        """size defaults to the largest index plus one, found in one job."""
        df = as_vector(df)
        if size is None:
            size = df.agg(F.max("idx")).first()[0]
            if size is None:
                raise EmptyInputError("cannot infer the size of an empty vector")
            size += 1
        return cls(df, int(size), kind)

    @cached_property
    def nnz(self) -> int:
        return self.df.count()

    @property
    def sparsity(self) -> float:
        return 1.0 - self.nnz / self.size if self.size else 0.0

    @property
    def is_sparse(self) -> bool:
        return self.sparsity > SPARSE_ABOVE

    def preview(self, n: int = 10) -> DataFrame:
        return self.df.orderBy("idx").limit(n)


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    num_rows: int
    num_cols: int
    layout: str = "coo"

    @classmethod
    def of(cls, df: DataFrame, num_rows: int | None = None, num_cols: int | None = None, layout: str = "coo") -> Matrix:
        """Shape defaults to the largest indices plus one, as far as entries go (trailing empty rows are unknown)."""
        df = as_coo(df)
        if num_rows is None or num_cols is None:
            top = df.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
            if top.r is None:
                raise EmptyInputError("cannot infer the shape of an empty matrix")
            num_rows, num_cols = num_rows or top.r + 1, num_cols or top.c + 1
        if layout not in ("coo", "dense"):
            return cls(df, int(num_rows), int(num_cols)).to(layout)
        return cls(df, int(num_rows), int(num_cols), layout)

    @property
    def shape(self) -> tuple[int, int]:
        return self.num_rows, self.num_cols

    @cached_property
    def nnz(self) -> int:
        if self.layout in ("csr", "csc"):
            return self.df.agg(F.coalesce(F.sum(F.size("values").cast("long")), F.lit(0))).first()[0]
        return self.df.count()

    @property
    def sparsity(self) -> float:
        cells = self.num_rows * self.num_cols
        return 1.0 - self.nnz / cells if cells else 0.0

    @property
    def is_sparse(self) -> bool:
        return self.sparsity > SPARSE_ABOVE

    def coo(self) -> DataFrame:
        """The entries as (row, col, value), whatever the layout."""
        from rowloom.operators import layout

        return layout.unpack(self.df, self.layout)

    def to(self, target: str) -> Matrix:
        """Convert the layout; dense to sparse drops zeros, other conversions keep every entry."""
        from rowloom.operators import layout

        if target not in LAYOUTS:
            raise ValueError(f"unknown layout {target!r}")
        if target == self.layout:
            return self
        entries = self.coo()
        if self.layout == "dense":
            entries = entries.where(not_zero("value"))
        if target == "dense":
            return Matrix(layout.fill(entries, self.num_rows, self.num_cols), self.num_rows, self.num_cols, "dense")
        return Matrix(layout.pack(entries, target), self.num_rows, self.num_cols, target)

    def transpose(self) -> Matrix:
        """Swap indices; no shuffle. CSR and CSC turn into each other by renaming."""
        if self.layout == "csr":
            df = self.df.select(F.col("row").alias("col"), F.col("col_indices").alias("row_indices"), "values")
            return Matrix(df, self.num_cols, self.num_rows, "csc")
        if self.layout == "csc":
            df = self.df.select(F.col("col").alias("row"), F.col("row_indices").alias("col_indices"), "values")
            return Matrix(df, self.num_cols, self.num_rows, "csr")
        df = self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
        return replace(self, df=df, num_rows=self.num_cols, num_cols=self.num_rows)

    T = property(transpose)

    def slice(self, row_from: int, row_to: int, col_from: int, col_to: int) -> Matrix:
        """Half-open ranges, rebased to zero; the range filters reach a Parquet scan below."""
        df = self.coo().where(F.col("row").between(row_from, row_to - 1) & F.col("col").between(col_from, col_to - 1))
        df = df.select((F.col("row") - F.lit(row_from)).alias("row"), (F.col("col") - F.lit(col_from)).alias("col"), "value")
        return Matrix(df, max(0, row_to - row_from), max(0, col_to - col_from), "dense" if self.layout == "dense" else "coo")

    def multiply(self, other: Matrix | Vector, strategy: str = "adaptive", strict: bool = True) -> Matrix | Vector:
        from rowloom.operators import algebra

        return algebra.multiply(self, other, strategy, strict)

    def add(self, other: Matrix, strict: bool = True) -> Matrix:
        from rowloom.operators import algebra

        return algebra.add(self, other, strict)

    __matmul__ = __mul__ = multiply
    __add__ = add

    def preview(self, n: int = 10) -> DataFrame:
        return self.coo().orderBy("row", "col").limit(n)


@dataclass(frozen=True)
class SparseTensor:
    """An N-way tensor; df is (i, j, k, value) for order 3 and (indices, value) otherwise."""

    df: DataFrame
    dims: tuple[int, ...]

    @classmethod
    def of(cls, df: DataFrame, dims: tuple[int, ...] | None = None) -> SparseTensor:
        if dims is None:
            top = df.agg(*(F.max(c).alias(c) for c in "ijk")).first()
            if top.i is None:
                raise EmptyInputError("cannot infer the dimensions of an empty tensor")
            dims = tuple(int(top[c]) + 1 for c in "ijk")
        return cls(df, tuple(dims))

    @property
    def order(self) -> int:
        return len(self.dims)

    def indices(self) -> list:
        """A Column for each mode's index."""
        if "indices" in self.df.columns:
            return [F.col("indices")[m] for m in range(self.order)]
        return [F.col(c) for c in "ijk"]

    @cached_property
    def nnz(self) -> int:
        return self.df.count()

    @property
    def total_elements(self) -> int:
        total = 1
        for d in self.dims:
            total *= d
        return total

    @property
    def sparsity(self) -> float:
        return 1.0 - self.nnz / self.total_elements if self.total_elements else 0.0


@dataclass(frozen=True)
class FactorMatrix:
    """Long form (idx, r, value)."""

    df: DataFrame
    num_rows: int
    rank: int
