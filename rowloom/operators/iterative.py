"""Pipelines of repeated products. Lineage is cut with checkpoint() in the shared folder every few steps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.model import Matrix, Vector
from rowloom.operators import algebra
from rowloom.session import drop_table, materialise, scratch_path, shared_dir

#: Steps between checkpoints: plans of a few joins are cheaper to run whole than to write out.
CUT_EVERY = 5


def _cut(df: DataFrame, step: int, steps: int) -> DataFrame:
    if step % CUT_EVERY or step == steps:
        return df
    shared_dir(df.sparkSession)
    return df.checkpoint()


def uniform(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), (F.lit(1.0) / F.lit(float(n))).alias("value"))


def pagerank(m: Matrix, steps: int = 10, damping: float = 0.85, transpose: bool = False) -> Vector:
    """r <- damping * (M r) + (1 - damping) / n from the uniform vector; M is taken as given, without normalisation.

    transpose=True sums over the other index. Vertices without an in-link vanish from the result.
    """
    m = m.transpose() if transpose else m
    n = m.num_rows
    r = uniform(m.df.sparkSession, n)
    for step in range(1, steps + 1):
        y = algebra.spmv(m.df, r, m.layout)
        r = _cut(y.select("idx", (F.lit(damping) * F.col("value") + F.lit((1 - damping) / n)).alias("value")), step, steps)
    return Vector(r, n, "sparse")


def power_iteration(m: Matrix, start: DataFrame | None = None, steps: int = 20, seed: int = 42) -> Vector:
    """v <- A v / |A v|; the norm is a one-row relation joined lazily, so nothing returns to the driver.

    Both the norm and the next vector read A v, so it is written in each step: a plan never holds more than one product.
    """
    spark = m.df.sparkSession
    v = start if start is not None else spark.range(m.num_cols).select(F.col("id").alias("idx"), F.randn(seed).alias("value"))
    y = None
    for _ in range(steps):
        before, y = y, materialise(algebra.spmv(m.df, v, m.layout), "product")
        if before is not None:
            drop_table(before)
        norm = y.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
        v = y.crossJoin(F.broadcast(norm)).select("idx", (F.col("value") / F.col("norm")).alias("value"))  # one row
    return Vector(v, m.num_rows, "sparse")


def centrality(m: Matrix, steps: int = 10) -> Vector:
    """How many weighted walks of this many edges begin at each vertex: A^steps times the vector of ones."""
    ones = m.df.sparkSession.range(m.num_cols).select(F.col("id").alias("idx"), F.lit(1.0).alias("value"))
    return iterated_spmv(m, ones, steps)


def iterated_spmv(m: Matrix, x: DataFrame, steps: int = 10) -> Vector:
    """A^steps x without damping; also the graph-centrality loop."""
    for step in range(1, steps + 1):
        x = _cut(algebra.spmv(m.df, x, m.layout), step, steps)
    return Vector(x, m.num_rows, "sparse")


def matrix_power(m: Matrix, k: int) -> Matrix:
    """Walk weights of length k, near-zero entries dropped at each step."""
    out = m
    for step in range(2, k + 1):
        df = algebra.spmm_sparse(out.coo(), m.coo())
        out = Matrix(_cut(df, step, k), m.num_rows, m.num_cols)
    return out


def k_hop_reachability(edges: DataFrame, hops: int) -> DataFrame:
    """Distinct (src, dst) pairs joined by a walk of exactly this many edges."""
    paths = edges.select("src", "dst").distinct()
    step_edges = paths.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    for step in range(2, hops + 1):
        paths = paths.join(step_edges, paths.dst == step_edges.mid).select("src", F.col("to").alias("dst")).distinct()
        paths = _cut(paths, step, hops)
    return paths


def item_similarity(ratings: DataFrame, upper_only: bool = False) -> DataFrame:
    """A^T A over (user, item, rating): the products of ratings that share a user, summed for each pair of items.

    Ratings are written once, in parts by item; a task for each two parts reads them and gives final sums, so neither
    products nor sums move. Where pairs of items are fewer than ratings, or parts would be too many, users of near
    numbers share a task instead, whose sums move. Ratings without a user join nothing.
    """
    spark = ratings.sparkSession
    rated = ratings.where("user is not null").select("user", F.col("item").cast("long"), F.col("rating").cast("double"))
    rated = materialise(rated, "ratings")
    n, items = rated.agg(F.count(F.lit(1)), F.approx_count_distinct("item")).first()
    parts = max(1, -(-n // PART_RATINGS))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    if tasks * items**2 > n and parts <= MOST_PARTS:
        dealt = rated.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")).coalesce(spark.sparkContext.defaultParallelism)
        path = scratch_path(spark, "ratings_by_item")
        dealt.write.partitionBy("part").parquet(path)
        drop_table(rated)
        dealt = spark.read.schema(dealt.schema).parquet(path)
        names = "item_a long, item_b long, similarity double"

        def pair(a: int, b: int) -> DataFrame:
            return dealt.where(F.col("part").isin(a, b)).coalesce(1).mapInArrow(lambda batches: cross_sums(batches, a, b, upper_only), names)

        # a union of single partitions alone would be one task; this branch reads no file and is none
        none = dealt.where("part < 0").select(F.col("item").alias("item_a"), F.col("item").alias("item_b"), F.col("rating").alias("similarity"))
        return reduce(DataFrame.unionByName, [none, *(pair(a, b) for a in range(parts) for b in range(a, parts))])
    sorted_users = rated.repartitionByRange(tasks, "user").sortWithinPartitions("user")
    sums = sorted_users.mapInArrow(lambda batches: pair_sums(batches, upper_only), "item_a long, item_b long, similarity double")
    return sums.repartition("item_a", "item_b").groupBy("item_a", "item_b").agg(F.sum("similarity").alias("similarity"))


#: Ratings of a part of the items, of which a task holds two; parts at most, of which each two are a task.
PART_RATINGS, MOST_PARTS = 3_000_000, 16
#: Products whose sums are found together, and cells for each of them up to which the sums are held as a grid.
TOGETHER, SPARSE = 1 << 21, 4


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's place in an array of the different ones; -1 for null."""
    column = column.combine_chunks().dictionary_encode()  # chunks apart would each have a dictionary
    return column.indices.fill_null(-1).to_numpy(zero_copy_only=False), column.dictionary


def cross_sums(batches: Iterator[pa.RecordBatch], part_a: int, part_b: int, upper_only: bool = False) -> Iterator[pa.RecordBatch]:
    """(item_a, item_b, sum of products), each pair of items once, over all (user, item, rating, part) of two parts of the items.

    Pairs are of one item of each part, in both orders. The ratings of a few items of the first part meet all of the second.
    """
    table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["user", "item", "rating", "part"])])
    if not table.num_rows:
        return
    part = table["part"].to_numpy()
    user, users = _codes(table["user"])
    item, names = _codes(table["item"])
    empty = table["rating"].is_null().to_numpy()
    value = table["rating"].fill_null(0.0).to_numpy()
    some_empty = bool(empty.any())
    del table

    def side(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a part, their items' places among its items, and those items (-1: null)."""
        rows = np.flatnonzero(part == which)
        mine, place = np.unique(item[rows], return_inverse=True)
        return rows, place, mine

    rows_b, place_b, items_b = side(part_b)
    order = np.argsort(user[rows_b], kind="stable")
    rows_b, place_b = rows_b[order], place_b[order]
    count = np.bincount(user[rows_b], minlength=len(users))
    start = np.cumsum(count) - count
    rows_a, place_a, items_a = side(part_a)
    order = np.argsort(place_a, kind="stable")
    order = order[count[user[rows_a[order]]] > 0]
    rows_a, place_a = rows_a[order], place_a[order]
    n, first = count[user[rows_a]], start[user[rows_a]]
    value_b, empty_b, wide = value[rows_b], empty[rows_b], len(items_b)
    upto = np.concatenate(([0], np.cumsum(n)))

    def products(begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(cell, product, whether it is null) of the first part's ratings from begin to end, about PRODUCTS at a time."""
        while begin < end:
            to = min(end, max(begin + 1, int(np.searchsorted(upto, upto[begin] + PRODUCTS, side="right")) - 1))
            a = np.repeat(np.arange(begin, to), n[begin:to])
            b = np.arange(len(a)) + np.repeat(first[begin:to] - (upto[begin:to] - upto[begin]), n[begin:to])
            with np.errstate(invalid="ignore", over="ignore"):  # infinity times zero is NaN, as in SQL
                yield place_a[a] * wide + place_b[b], value[rows_a[a]] * value_b[b], empty[rows_a[a]] | empty_b[b] if some_empty else None
            begin = to

    def out(cell: np.ndarray, total: np.ndarray, null: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(cell), 1 << 16):
            a, b = items_a[cell[k : k + (1 << 16)] // wide], items_b[cell[k : k + (1 << 16)] % wide]
            a, b = (names.take(pa.array(x, mask=x < 0)) for x in (a, b))
            sums = pa.array(total[k : k + (1 << 16)], mask=None if null is None else null[k : k + (1 << 16)])
            for x, y in ((a, b), (b, a))[: 1 + (part_a != part_b)]:
                found = pa.RecordBatch.from_arrays([x, y, sums], names=["item_a", "item_b", "similarity"])
                yield found.filter(pc.less(x, y)) if upper_only else found

    heads = np.flatnonzero(np.concatenate(([True], place_a[1:] != place_a[:-1]))) if len(place_a) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(place_a))
    k = 0
    while k < len(heads):  # items of the first part with about TOGETHER products, at least one item
        z = max(k + 1, int(np.searchsorted(upto[ends], upto[heads[k]] + TOGETHER, side="right")))
        begin, end = heads[k], ends[z - 1]
        low, cells = place_a[begin] * wide, (place_a[end - 1] - place_a[begin] + 1) * wide
        if cells <= SPARSE * (upto[end] - upto[begin]) or z == k + 1:
            total, seen, filled = np.zeros(cells), np.zeros(cells, bool), np.zeros(cells if some_empty else 0, bool)
            for cell, product, null in products(begin, end):
                seen[cell - low] = True
                if some_empty:
                    cell, product = cell[~null], product[~null]
                    filled[cell - low] = True
                with np.errstate(invalid="ignore", over="ignore"):
                    np.add.at(total, cell - low, product)
            at = np.flatnonzero(seen)
            yield from out(at + low, total[at], ~filled[at] if some_empty else None)
        else:
            cell, product, null = (np.concatenate(x) if x[0] is not None else None for x in zip(*products(begin, end), strict=True))
            order = np.argsort(cell, kind="stable")
            cell, product = cell[order], product[order]
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            with np.errstate(invalid="ignore", over="ignore"):
                total = np.add.reduceat(product, cuts)
            yield from out(cell[cuts], total, np.logical_and.reduceat(null[order], cuts) if some_empty else None)
        k = z


#: Ratings taken at once, products held at once, and items whose sums a task holds as a square (64 MB and a byte a cell).
RATINGS, PRODUCTS, SQUARE = 1 << 17, 1 << 19, 2896


def pair_sums(batches: Iterator[pa.RecordBatch], upper_only: bool = False) -> Iterator[pa.RecordBatch]:
    """(item_a, item_b, sum of products) over ratings sorted by user; a pair of items may come more than once.

    Sums are held in a square over the items met, which is given out and begun anew when it gets too wide. Ratings with
    nulls, or of too many items, are summed for PRODUCTS products at a time.
    """
    names = ["item_a", "item_b", "similarity"]
    items, sums, seen = np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros((0, 0), bool)

    def out(cells: pa.Table) -> Iterator[pa.RecordBatch]:
        cells = cells.filter(pc.less(cells["item_a"], cells["item_b"])) if upper_only else cells
        yield from cells.to_batches(max_chunksize=1 << 16)

    def held() -> Iterator[pa.RecordBatch]:
        step = max(1, PRODUCTS // max(1, len(items)))
        for top in range(0, len(items), step):
            x, y = np.nonzero(seen[top : top + step])
            yield from out(pa.table([items[x + top], items[y], sums[x + top, y]], names=names))

    for user, item, rating in whole_users(batches):
        sizes = np.diff(np.concatenate(([0], np.flatnonzero(user[1:] != user[:-1]) + 1, [len(user)])))
        n = np.repeat(sizes, sizes)  # by rating: how many its user has, and where they begin
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        upto = np.concatenate(([0], np.cumsum(n)))
        square = not (item.null_count or rating.null_count)
        if square:
            found = np.unique(item.to_numpy())
            both = np.union1d(items, found)
            if len(both) > SQUARE:
                yield from held()
                items, sums, seen = np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros((0, 0), bool)
                both, square = found, len(found) <= SQUARE
            if square and len(both) > len(items):
                at = np.ix_(*[np.searchsorted(both, items)] * 2)
                wider, more = np.zeros((len(both), len(both))), np.zeros((len(both), len(both)), bool)
                wider[at], more[at] = sums, seen
                items, sums, seen = both, wider, more
            if square:
                place, values = np.searchsorted(items, item.to_numpy()), rating.to_numpy()
        begin = 0
        while begin < len(n):  # ratings with about PRODUCTS products, at least one rating
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PRODUCTS, side="right")) - 1)
            a = np.repeat(np.arange(begin, end), n[begin:end])
            b = np.arange(len(a)) + np.repeat(first[begin:end] - (upto[begin:end] - upto[begin]), n[begin:end])
            begin = end
            if square:
                cell = place[a] * len(items) + place[b]
                with np.errstate(invalid="ignore"):  # infinity times zero is NaN, as in SQL
                    np.add.at(sums.reshape(-1), cell, values[a] * values[b])
                seen.reshape(-1)[cell] = True
            else:
                a, b = pa.array(a), pa.array(b)
                cells = pa.table([item.take(a), item.take(b), pc.multiply(rating.take(a), rating.take(b))], names=names)
                yield from out(cells.group_by(names[:2], use_threads=False).aggregate([(names[2], "sum")]).select([*names[:2], "similarity_sum"]).rename_columns(names))
    yield from held()


def whole_users(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    """Users as numbers, items and ratings of about RATINGS rows, or of one user that has more."""
    waiting, rows = [], 0
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            waiting.append(batch)
            rows += batch.num_rows
        if not rows or batch is not None and rows < RATINGS:
            continue
        part = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        user = part.column(0).to_numpy(zero_copy_only=False)
        cut = rows if batch is None else int(np.searchsorted(user, user[-1]))  # the last user may go on
        if cut:
            yield user[:cut], part.column(1).slice(0, cut), part.column(2).slice(0, cut)
        waiting, rows = [part.slice(cut)] if cut < rows else [], rows - cut


def recommend(m: Matrix, v: DataFrame) -> DataFrame:
    """(A A) v, evaluated as A (A v): two matrix-vector products instead of a matrix-matrix one."""
    return algebra.spmv(m.df, algebra.spmv(m.df, v, m.layout), m.layout)
