"""Physical variants of one identity: equi-join on the inner index, then a grouped sum on the output index.

Every variant of a family returns the same relation. ``adaptive`` leaves join choice, partial aggregation, partition
counts and skew to Catalyst and AQE and is the default; the others exist so that a plan shape can be asked for by name.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import not_zero
from rowloom.operators.layout import unpack

SPMV = {
    "coo": ("baseline", "copartition", "inpartition", "both", "balanced", "caching", "broadcast", "adaptive"),
    "csr": ("baseline", "copartition", "inpartition", "rowwise", "broadcast", "adaptive"),
    "csc": ("baseline", "copartition", "inpartition", "colwise", "broadcast", "adaptive"),
}
SPMM = {
    "coo": ("baseline", "copartition", "inpartition", "block", "caching", "broadcast", "adaptive"),
    "csr": ("baseline", "copartition", "inpartition", "rowwise", "broadcast", "adaptive"),
    "csc": ("baseline", "copartition", "inpartition", "colwise", "broadcast", "adaptive"),
}
ALIASES = {"mapsidejoin": "broadcast", "co-partitioning": "copartition", "in-partition": "inpartition"}

#: A side is broadcast on request only if it has at most this many rows (about 200 MB of pairs).
BROADCAST_ROWS = 8_000_000
#: The row kernel holds the whole vector as one array up to this length.
ROW_KERNEL_SIZE = 1_000_000
BLOCK = 100
#: Entries of one tile, and products of a pair of tiles held at once.
TILE_ENTRIES, PRODUCTS = 1 << 16, 1 << 20


def _name(strategy: str, table: dict, layout: str) -> str:
    strategy = ALIASES.get(strategy.lower(), strategy.lower())
    layout = "coo" if layout == "dense" else layout
    if strategy not in table[layout]:
        raise ValueError(f"strategy {strategy!r} is not one of {', '.join(table[layout])} for layout {layout}")
    return strategy


def _parts(df: DataFrame, factor: int = 2) -> int:
    """Explicit partition counts follow the session and the planner's size estimate, not the machine."""
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    return max(factor * parallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), optimal_partitions(estimated_bytes(df), parallelism))


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a relation's size; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Checks a side's size by counting no more than rows + 1 of its rows."""
    return df.limit(rows + 1).count() <= rows


def _broadcast(df: DataFrame) -> DataFrame:
    """Hint a side whose size is checked; a larger one goes to Catalyst without a hint."""
    return F.broadcast(df) if small_enough(df) else df


def _salted_sum(products: DataFrame, keys: list[str]) -> DataFrame:
    """Two-step sum for hot output keys: a random-free salt from the inner index, then the final sum."""
    salted = products.groupBy(*keys, (F.pmod(F.xxhash64("inner"), F.lit(16))).alias("salt")).agg(F.sum("value").alias("value"))
    return salted.groupBy(*keys).agg(F.sum("value").alias("value"))


_held: list[DataFrame] = []


def release_caches() -> None:
    """Give back the memory of the operands that the last product with the caching strategy holds."""
    while _held:
        _held.pop().unpersist()


def _cached(*operands: DataFrame) -> list[DataFrame]:
    """Operands kept by executors until the next such product or release_caches(); a plan that lost them computes them again."""
    release_caches()
    _held.extend(x.persist(StorageLevel.MEMORY_AND_DISK) for x in operands)
    return list(_held)


def spmv(a: DataFrame, x: DataFrame, layout: str = "coo", strategy: str = "adaptive", size: int | None = None) -> DataFrame:
    """y[i] = sum_j A[i,j] x[j] as (idx, value); rows without a match are absent and exact zeros are kept."""
    strategy = _name(strategy, SPMV, layout)
    if layout == "csc":
        return _spmv_packed_columns(a, x, strategy)
    if layout == "csr" and strategy == "rowwise" and (found := _row_kernel(a, x, size)) is not None:
        return found
    entries = unpack(a, layout)
    x = x.select(F.col("idx").alias("inner"), F.col("value").alias("x"))
    entries = entries.select("row", F.col("col").alias("inner"), "value")
    n = _parts(entries)
    if strategy in ("copartition", "inpartition", "both", "caching"):
        entries, x = entries.repartition(n, "inner"), x.repartition(n, "inner")
    elif strategy == "balanced":
        entries = entries.repartition(_parts(entries, 3), "row")
    elif strategy == "broadcast":
        x = _broadcast(x)
    if strategy == "caching":
        entries, x = _cached(entries, x)
    products = entries.join(x, "inner").select(F.col("row").alias("idx"), "inner", (F.col("value") * F.col("x")).alias("value"))
    if strategy == "balanced":
        return _salted_sum(products, ["idx"])
    return products.groupBy("idx").agg(F.sum("value").alias("value"))


def _spmv_packed_columns(a: DataFrame, x: DataFrame, strategy: str) -> DataFrame:
    """Joins one record for each column, and only then takes entries apart: the join moves columns, not entries."""
    x = x.select(F.col("idx").alias("col"), F.col("value").alias("x"))
    if strategy in ("copartition", "inpartition"):
        a, x = a.repartition(_parts(a), "col"), x.repartition(_parts(a), "col")
    elif strategy == "broadcast":
        x = _broadcast(x)
    joined = a.join(x, "col").select("x", F.inline(F.arrays_zip("row_indices", "values")))
    products = joined.select(F.col("row_indices").alias("idx"), (F.col("values") * F.col("x")).alias("value"))
    return products.groupBy("idx").agg(F.sum("value").alias("value"))


def _row_kernel(csr: DataFrame, x: DataFrame, size: int | None) -> DataFrame | None:
    """A dot product inside each packed row against x held as one array: no shuffle of the matrix.

    Rows none of whose columns occur in x are dropped, as a join would. None if x is too long for one array.
    """
    if size is None:
        top = x.agg(F.max("idx")).first()[0]
        size = 0 if top is None else top + 1
    if size > ROW_KERNEL_SIZE:
        return None
    summed = x.where("idx is not null").groupBy("idx").agg(F.sum("value").alias("value"))
    full = x.sparkSession.range(size).withColumnRenamed("id", "idx").join(summed.withColumn("there", F.lit(True)), "idx", "left")
    packed = full.agg(F.array_sort(F.collect_list(F.struct("idx", "value", "there"))).alias("xs"))
    row = csr.crossJoin(F.broadcast(packed))  # one record of bounded length
    inside = F.filter(F.arrays_zip("col_indices", "values"), lambda e: F.coalesce(F.get("xs", e["col_indices"].cast("int"))["there"], F.lit(False)))
    hits = row.select(F.col("row").alias("idx"), inside.alias("hits"), "xs").where(F.size("hits") > 0)
    term = lambda acc, e: acc + F.coalesce(e["values"] * F.get("xs", e["col_indices"].cast("int"))["value"], F.lit(0.0))
    return hits.select("idx", F.aggregate("hits", F.lit(0.0), term).alias("value"))


def spmm(a: DataFrame, b: DataFrame, layout: str = "coo", strategy: str = "adaptive", drop_zeros: bool = True) -> DataFrame:
    """C[i,k] = sum_j A[i,j] B[j,k]; b is (row, col, value). drop_zeros is the sparse-times-sparse rule."""
    strategy = _name(strategy, SPMM, layout)
    if strategy == "block":
        out = _spmm_tiles(unpack(a, layout), b)
    else:
        right = b.select(F.col("row").alias("inner"), F.col("col").alias("bcol"), F.col("value").alias("bvalue"))
        n = _parts(a)
        if layout == "csc" and strategy == "colwise":
            packed = a.repartition(n, "col").withColumnRenamed("col", "inner")
            flat = packed.join(right.repartition(n, "inner"), "inner").select("inner", "bcol", "bvalue", F.inline(F.arrays_zip("row_indices", "values")))
            products = flat.select(F.col("row_indices").alias("row"), F.col("bcol").alias("col"), (F.col("values") * F.col("bvalue")).alias("value"))
        else:
            left = unpack(a, layout).select("row", F.col("col").alias("inner"), "value")
            if strategy in ("copartition", "inpartition", "caching"):
                left, right = left.repartition(n, "inner"), right.repartition(n, "inner")
            elif strategy in ("broadcast", "rowwise"):
                right = _broadcast(right)
            if strategy == "caching":
                left, right = _cached(left, right)
            products = left.join(right, "inner").select("row", F.col("bcol").alias("col"), (F.col("value") * F.col("bvalue")).alias("value"))
        out = products.groupBy("row", "col").agg(F.sum("value").alias("value"))
    return out.where(not_zero("value")) if drop_zeros else out


def _tiles(df: DataFrame, outer: str, inner: str, prefix: str, block: int) -> DataFrame:
    """One record for each strip of block inner indices, or several of about TILE_ENTRIES for a strip that has more.

    Narrower tiles would hold about one entry each in a sparse matrix, and as many pairs as it has products would meet.
    """
    strip = F.expr(f"{inner} div {block}L").alias("inner_block")
    parts = df.groupBy(strip).agg(F.ceil(F.count(F.lit(1)) / TILE_ENTRIES).alias("parts"))
    entry = F.struct(F.col(outer).alias("o"), F.expr(f"cast({inner} % {block} + {block} as int)").alias("i"), F.col("value").alias("v"))
    dealt = df.select(strip, F.expr(f"{outer} div {block}L").alias("outer_block"), entry.alias("e")).join(parts, "inner_block")
    tile = dealt.groupBy("inner_block", F.expr("pmod(xxhash64(outer_block), parts)").alias("part"))
    return tile.agg(F.collect_list("e").alias(prefix)).select("inner_block", prefix)


def _spmm_tiles(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """Joins tiles on the inner block; the products of a pair of tiles are summed by cell before they move."""
    pairs = _tiles(a, "row", "col", "a", block).join(_tiles(b, "col", "row", "b", block), "inner_block").select("a", "b")

    def multiply(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (batch.column(c).slice(k, 1).flatten() for c in (0, 1))
                (row, li, lv), (col, ri, rv) = left.flatten(), right.flatten()
                order = np.argsort(ri.to_numpy(), kind="stable")
                sizes = np.bincount(ri.to_numpy(), minlength=2 * block)  # remainders of negative indices come first
                first, li = np.cumsum(sizes) - sizes, li.to_numpy()
                upto = np.concatenate(([0], np.cumsum(sizes[li])))
                begin = 0
                while begin < len(li):  # entries of the left tile with about PRODUCTS products, at least one
                    end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PRODUCTS, side="right")) - 1)
                    n = sizes[li[begin:end]]
                    at = np.repeat(np.arange(begin, end), n)
                    to = order[np.arange(len(at)) + np.repeat(first[li[begin:end]] - (upto[begin:end] - upto[begin]), n)]
                    begin = end
                    if len(at):
                        products = pc.multiply(lv.take(pa.array(at)), rv.take(pa.array(to)))
                        cells = pa.table({"row": row.take(pa.array(at)), "col": col.take(pa.array(to)), "value": products})
                        summed = cells.group_by(["row", "col"], use_threads=False).aggregate([("value", "sum")])
                        yield from summed.select(["row", "col", "value_sum"]).rename_columns(["row", "col", "value"]).to_batches()

    products = pairs.mapInArrow(multiply, "row long, col long, value double")
    return products.groupBy("row", "col").agg(F.sum("value").alias("value"))


def optimal_partitions(size_bytes: int, parallelism: int, target_bytes: int = 128 << 20) -> int:
    """Partitions of about target size, at least one and at most four for each core; AQE refines this at run time."""
    return max(parallelism, min(4 * parallelism, math.ceil(size_bytes / target_bytes)))
