"""Rewrites that Catalyst does not make: product order, layout and strategy choice."""

from __future__ import annotations

from rowloom.model import SPARSE_ABOVE, Matrix, Vector
from rowloom.operators import algebra
from rowloom.operators.strategy import small_enough


def choose_layout(m: Matrix) -> str:
    return "coo" if m.sparsity > SPARSE_ABOVE else "dense"


def choose_strategy(m: Matrix, x: Vector) -> str:
    """Packed columns join best as they are; a vector of checked size is broadcast; AQE decides the rest."""
    if m.layout == "csc":
        return "colwise"
    return "broadcast" if small_enough(x.df) else "adaptive"


def chain_order(shapes: list[tuple[int, int]], densities: list[float]) -> tuple:
    """The cheapest bracketing of a chain as nested tuples of positions.

    Dynamic programme over the expected number of scalar products, with densities combined as for random patterns.
    """
    n = len(shapes)
    best: dict[tuple[int, int], tuple[float, float, object]] = {(k, k): (0.0, densities[k], k) for k in range(n)}
    for width in range(2, n + 1):
        for a in range(n - width + 1):
            b = a + width - 1
            options = []
            for cut in range(a, b):
                left, right = best[a, cut], best[cut + 1, b]
                inner = shapes[cut][1]
                products = shapes[a][0] * inner * shapes[b][1] * left[1] * right[1]
                density = 1.0 - (1.0 - min(1.0, left[1] * right[1])) ** inner
                options.append((left[0] + right[0] + products, density, (left[2], right[2])))
            best[a, b] = min(options, key=lambda o: o[0])
    return best[0, n - 1][2]


def chain(operands: list[Matrix | Vector]) -> Matrix | Vector:
    """Multiply a chain, for instance A, B, v, in the cheapest order: (A B) v becomes A (B v)."""
    shapes = [(o.num_rows, o.num_cols) if isinstance(o, Matrix) else (o.size, 1) for o in operands]
    densities = [max(1e-12, 1.0 - o.sparsity) for o in operands]

    def build(node):
        if isinstance(node, int):
            return operands[node]
        return algebra.multiply(build(node[0]), build(node[1]))

    return build(chain_order(shapes, densities))
