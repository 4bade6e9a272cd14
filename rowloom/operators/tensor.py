"""Three-way (and N-way where noted) sparse tensor operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import checked_product, not_zero
from rowloom.model import FactorMatrix, SparseTensor
from rowloom.operators.strategy import small_enough

STRATEGIES = ("baseline", "copartition", "inpartition", "adaptive")


def _check_mode(t: SparseTensor, mode: int) -> None:
    if not 0 <= mode < t.order:
        raise ValueError(f"mode {mode} of an order-{t.order} tensor")


def unfold(t: SparseTensor, mode: int) -> DataFrame:
    """Matricise: row is the mode's index, col the mixed radix of the others in order, the last running fastest."""
    _check_mode(t, mode)
    others = [m for m in range(t.order) if m != mode]
    checked_product(*(t.dims[m] for m in others))
    at = t.indices()
    col: Column = F.lit(0).cast("long")
    for m in others:
        col = col * F.lit(int(t.dims[m])).cast("long") + at[m].cast("long")
    return t.df.select(at[mode].cast("long").alias("row"), col.alias("col"), "value")


def mttkrp(t: SparseTensor, factors: list[FactorMatrix], mode: int, strategy: str = "adaptive") -> FactorMatrix:
    """Y[i, r] = sum of T[...] times the product of the other modes' factors at (their index, r).

    factors come in mode order without the mode itself. Each factor is packed to one array for an index, so that rows
    stay as many as entries until the last step, where the rank is spread out for a partial sum.
    """
    _check_mode(t, mode)
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is not one of {', '.join(STRATEGIES)}")
    if len(factors) != t.order - 1:
        raise ValueError(f"{t.order - 1} factors are needed, {len(factors)} given")
    if len({f.rank for f in factors}) != 1:
        raise ValueError("all factors need the same rank")
    others = [m for m in range(t.order) if m != mode]
    at = t.indices()
    df = t.df.select(*(at[m].alias(f"m{m}") for m in range(t.order)), "value")
    if strategy in ("copartition", "inpartition"):
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(n, f"m{mode}")
    for m, f in zip(others, factors, strict=True):
        packed = f.df.groupBy(F.col("idx").alias(f"m{m}")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "value")))).alias(f"f{m}"))
        packed = packed.select(f"m{m}", F.array(*(F.try_element_at(f"f{m}", F.lit(r).cast("long")) for r in range(f.rank))).alias(f"f{m}"))
        df = df.join(packed, f"m{m}")
    product = reduce(lambda p, m: F.zip_with(p, F.col(f"f{m}"), lambda a, b: a * b), others[1:], F.col(f"f{others[0]}"))
    spread = df.select(F.col(f"m{mode}").alias("idx"), "value", F.posexplode(product).alias("r", "p"))
    terms = spread.where("p is not null").select("idx", F.col("r").cast("long").alias("r"), (F.col("value") * F.col("p")).alias("value"))
    return FactorMatrix(terms.groupBy("idx", "r").agg(F.sum("value").alias("value")), t.dims[mode], factors[0].rank)


def mttkrp_with_ones(t: SparseTensor, mode: int, rank: int) -> FactorMatrix:
    """MTTKRP against all-ones factors: the slice sums, repeated for each rank column, with no join at all."""
    _check_mode(t, mode)
    sums = t.df.groupBy(t.indices()[mode].alias("idx")).agg(F.sum("value").alias("value"))
    df = sums.select("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rank - 1).cast("long"))).alias("r"), "value")
    return FactorMatrix(df, t.dims[mode], rank)


def tensor_times_matrix(t: SparseTensor, m: DataFrame, mode: int, num_cols: int | None = None) -> SparseTensor:
    """Contract the mode with the matrix's rows; its columns become the mode's new index. Near-zero sums are dropped.

    num_cols defaults to the matrix's largest column plus one.
    """
    _check_mode(t, mode)
    names = [f"m{k}" for k in range(t.order)]
    at = t.indices()
    df = t.df.select(*(at[k].alias(names[k]) for k in range(t.order)), "value")
    right = m.select(F.col("row").alias(names[mode]), F.col("col").alias("c"), F.col("value").alias("w"))
    if num_cols is None:
        top = m.agg(F.max("col")).first()[0]
        num_cols = 0 if top is None else int(top) + 1
    joined = df.join(right, names[mode])
    out_index = [F.col("c").alias(names[k]) if k == mode else F.col(names[k]) for k in range(t.order)]
    summed = joined.select(*out_index, (F.col("value") * F.col("w")).alias("value")).groupBy(*names).agg(F.sum("value").alias("value")).where(not_zero("value"))
    if "indices" in t.df.columns:
        df = summed.select(F.array(*names).alias("indices"), "value")
    else:
        df = summed.select(*(F.col(n).alias(c) for n, c in zip(names, "ijk", strict=True)), "value")
    return SparseTensor(df, tuple(num_cols if k == mode else d for k, d in enumerate(t.dims)))


def khatri_rao(a: FactorMatrix, b: FactorMatrix) -> FactorMatrix:
    """Column-wise Kronecker product: row a.idx * b.num_rows + b.idx, one equi-join on the rank column.

    A rank has few values, so that a second factor too large to broadcast is copied to as many salts as there are
    shuffle partitions; the copies are fewer than the result's rows as soon as the first factor has more rows than that.
    """
    if a.rank != b.rank:
        raise ValueError(f"ranks differ: {a.rank} and {b.rank}")
    rows = checked_product(a.num_rows, b.num_rows)
    left = a.df.select(F.col("idx").alias("ia"), "r", F.col("value").alias("va"))
    right = b.df.select(F.col("idx").alias("ib"), "r", F.col("value").alias("vb"))
    if small_enough(right):
        joined = left.join(F.broadcast(right), "r")
    else:
        salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        joined = left.withColumn("salt", F.pmod(F.xxhash64("ia"), F.lit(salts))).join(right, ["r", "salt"])
    df = joined.select((F.col("ia") * F.lit(b.num_rows) + F.col("ib")).alias("idx"), "r", (F.col("va") * F.col("vb")).alias("value"))
    return FactorMatrix(df, rows, a.rank)


def collapse(t: SparseTensor) -> DataFrame:
    """The first two modes as a matrix with the third dropped; duplicates stay."""
    at = t.indices()
    return t.df.select(at[0].alias("row"), at[1].alias("col"), "value")
