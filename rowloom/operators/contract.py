"""The four products that a matrix layout offers, as a protocol that other engines can implement too."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from rowloom.operators import algebra
from rowloom.operators.strategy import spmv


@runtime_checkable
class MatrixOperations(Protocol):
    """Products of a matrix in some layout; vectors are (idx, value), right-hand matrices and results (row, col, value)."""

    def spmv(self, a: DataFrame, x: DataFrame) -> DataFrame: ...

    def spmv_sparse(self, a: DataFrame, x: DataFrame) -> DataFrame: ...

    def spmm_dense(self, a: DataFrame, b: DataFrame) -> DataFrame: ...

    def spmm_sparse(self, a: DataFrame, b: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class LayoutOperations:
    """The protocol for a layout and a strategy of this engine."""

    layout: str = "coo"
    strategy: str = "adaptive"

    def spmv(self, a: DataFrame, x: DataFrame) -> DataFrame:
        return spmv(a, x, self.layout, self.strategy)

    def spmv_sparse(self, a: DataFrame, x: DataFrame) -> DataFrame:
        """The same join: indices absent from a sparse vector have no partner."""
        return spmv(a, x, self.layout, self.strategy)

    def spmm_dense(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return algebra.spmm_dense(a, b, self.layout, self.strategy)

    def spmm_sparse(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return algebra.spmm_sparse(a, b, self.layout, self.strategy)
