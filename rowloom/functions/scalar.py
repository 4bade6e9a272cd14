"""Scalar predicates shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: magnitudes below this count as zero wherever an operator drops zeros.
ZERO_TOLERANCE = 1e-10
#: Largest index that a bigint column holds.
MAX_INDEX = 2**63 - 1


def is_zero(value: Column | str) -> Column:
    """True for magnitudes under the tolerance; NaN is not zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.abs(value) < F.lit(ZERO_TOLERANCE)


def not_zero(value: Column | str) -> Column:
    return ~is_zero(value)


def checked_product(*sizes: int) -> int:
    """The product of dimension sizes, refused where a bigint index could not address it."""
    total = 1
    for size in sizes:
        total *= int(size)
    if total - 1 > MAX_INDEX:
        raise OverflowError(f"index space {'x'.join(map(str, sizes))} exceeds a 64-bit index")
    return total
