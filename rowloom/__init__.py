"""Rowloom: sparse linear algebra, small-order tensors and corpus operators as Spark relations."""

from rowloom.model import FactorMatrix, Matrix, SparseTensor, Vector

__all__ = ["FactorMatrix", "Matrix", "SparseTensor", "Vector"]
