"""The user-facing algebra: shape checks and dispatch over the strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import not_zero
from rowloom.model import Matrix, Vector
from rowloom.operators import strategy as S


class ShapeError(ValueError):
    """Raised when two operands do not fit."""


def multiply(a: Matrix, b: Matrix | Vector, strategy: str = "adaptive", strict: bool = True) -> Matrix | Vector:
    """Matrix times vector or matrix.

    Rows without a matching inner index are absent from the result. Sparse times sparse drops values under the
    zero tolerance; every product with a dense operand, and every matrix-vector product, keeps exact zeros.
    """
    if isinstance(b, Vector):
        if strict and a.num_cols != b.size:
            raise ShapeError(f"{a.num_rows}x{a.num_cols} matrix times vector of {b.size}")
        return Vector(S.spmv(a.df, b.df, layout=a.layout, strategy=strategy, size=b.size), a.num_rows, "sparse")
    if strict and a.num_cols != b.num_rows:
        raise ShapeError(f"{a.num_rows}x{a.num_cols} times {b.num_rows}x{b.num_cols}")
    dense = "dense" in (a.layout, b.layout)
    df = S.spmm(a.df, b.coo(), layout=a.layout, strategy=strategy, drop_zeros=not dense)
    return Matrix(df, a.num_rows, b.num_cols, "dense" if dense else "coo")


def vector_times_matrix(v: Vector, a: Matrix, strategy: str = "adaptive", strict: bool = True) -> Vector:
    """v A, as the transpose times v; the transpose is a renaming."""
    if strict and a.num_rows != v.size:
        raise ShapeError(f"vector of {v.size} times {a.num_rows}x{a.num_cols} matrix")
    return multiply(a.transpose(), v, strategy, strict=False)


def dispatch(a: Matrix | Vector, b: Matrix | Vector, strategy: str = "adaptive") -> Matrix | Vector:
    """What a product of two loaded operands means; vector times vector has no meaning here."""
    if isinstance(a, Matrix):
        return multiply(a, b, strategy)
    if isinstance(b, Matrix):
        return vector_times_matrix(a, b, strategy)
    raise ValueError("vector times vector is not supported")


def add(a: Matrix, b: Matrix, strict: bool = True) -> Matrix:
    """Sum by cell; zeros stay. A sparse left operand takes a dense right one without its zeros."""
    if strict and a.shape != b.shape:
        raise ShapeError(f"{a.shape} plus {b.shape}")
    right = b.coo()
    if a.layout != "dense" and b.layout == "dense":
        right = right.where(not_zero("value"))
    both = a.coo().unionByName(right)
    df = both.groupBy("row", "col").agg(F.sum("value").alias("value"))
    return Matrix(df, a.num_rows, a.num_cols, "dense" if a.layout == "dense" else "coo")


def spmv(a: DataFrame, x: DataFrame, layout: str = "coo", strategy: str = "adaptive") -> DataFrame:
    """DataFrame form without shapes: (idx, value)."""
    return S.spmv(a, x, layout=layout, strategy=strategy)


def spmm_sparse(a: DataFrame, b: DataFrame, layout: str = "coo", strategy: str = "adaptive") -> DataFrame:
    return S.spmm(a, b, layout=layout, strategy=strategy, drop_zeros=True)


def spmm_dense(a: DataFrame, b: DataFrame, layout: str = "coo", strategy: str = "adaptive") -> DataFrame:
    return S.spmm(a, b, layout=layout, strategy=strategy, drop_zeros=False)
