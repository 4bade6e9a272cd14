"""Golden cases, algebraic properties and the edge semantics that tables do not show."""

import pytest

from rowloom.functions import checked_product
from rowloom.model import EmptyInputError, FactorMatrix, Matrix, SparseTensor, Vector
from rowloom.operators import algebra, iterative, layout, strategy, tensor, verify
from rowloom.plans import planner
from rowloom.sources import generate

ENTRIES = [(0, 0, 1.0), (0, 2, 2.0), (1, 1, -1.0), (3, 0, 4.0), (3, 3, 0.5)]


def coo(spark, rows):
    return spark.createDataFrame(rows, "row long, col long, value double")


def vec(spark, rows):
    return spark.createDataFrame(rows, "idx long, value double")


def got(df, *keys):
    return sorted(tuple(r) for r in df.select(*keys, "value").collect())


@pytest.fixture(scope="module")
def a(spark):
    return Matrix(coo(spark, ENTRIES), 4, 4)


def test_rows_without_a_match_are_absent_and_exact_zeros_stay(spark, a):
    x = vec(spark, [(0, 2.0), (2, -1.0)])
    for lay in ("coo", "csr", "csc"):
        for s in strategy.SPMV[lay]:
            out = strategy.spmv(layout.pack(a.df, lay), x, lay, s)
            assert got(out, "idx") == [(0, 0.0), (3, 8.0)], (lay, s)


def test_sparse_product_drops_zeros_and_dense_product_keeps_them(spark):
    m = coo(spark, [(0, 0, 1.0), (0, 1, 1.0)])
    b = coo(spark, [(0, 0, 1.0), (1, 0, -1.0), (0, 1, 3.0)])
    for lay in ("coo", "csr", "csc"):
        for s in strategy.SPMM[lay]:
            assert got(algebra.spmm_sparse(layout.pack(m, lay), b, lay, s), "row", "col") == [(0, 1, 3.0)], (lay, s)
            assert got(algebra.spmm_dense(layout.pack(m, lay), b, lay, s), "row", "col") == [(0, 0, 0.0), (0, 1, 3.0)], (lay, s)


def test_duplicates_sum_in_products_and_survive_conversion(spark):
    m = Matrix(coo(spark, [(0, 0, 1.0), (0, 0, 2.0)]), 1, 1)
    assert got(m.multiply(Vector(vec(spark, [(0, 10.0)]), 1)).df, "idx") == [(0, 30.0)]
    assert m.nnz == 2 and m.to("csr").nnz == 2 and m.to("csc").to("coo").nnz == 2
    assert m.to("dense").nnz == 2


def test_null_keys_do_not_join_and_null_values_do_not_count(spark):
    m = coo(spark, [(0, None, 1.0), (0, 0, None), (0, 1, 2.0)])
    assert got(strategy.spmv(m, vec(spark, [(0, 5.0), (1, 5.0), (None, 9.0)])), "idx") == [(0, 10.0)]


def test_nan_is_not_zero(spark):
    m = Matrix(coo(spark, [(0, 0, float("nan")), (0, 1, 1e-11), (0, 2, 0.0)]), 1, 3, "dense")
    assert m.to("coo").nnz == 1


def test_layouts_round_trip_and_transpose_twice(spark, a):
    want = got(a.df, "row", "col")
    for lay in ("csr", "csc"):
        assert got(a.to(lay).coo(), "row", "col") == want
        assert got(a.to(lay).transpose().transpose().coo(), "row", "col") == want
        assert a.to(lay).transpose().layout != lay
    assert len(got(a.to("dense").df, "row", "col")) == 16
    assert got(a.to("dense").to("coo").df, "row", "col") == want


def test_add_commutes_and_takes_left_layout(spark, a):
    b = Matrix(coo(spark, [(0, 0, -1.0), (2, 2, 7.0)]), 4, 4)
    assert got(a.add(b).df, "row", "col") == got(b.add(a).df, "row", "col")
    assert (0, 0, 0.0) in got(a.add(b).df, "row", "col")
    dense = Matrix(coo(spark, [(1, 0, 0.0)]), 4, 4, "dense")
    assert (1, 0, 0.0) not in got(a.add(dense).df, "row", "col")
    assert (1, 0, 0.0) in got(dense.add(a).df, "row", "col")


def test_identity_slice_and_preview(spark, a):
    eye = Matrix(generate.identity(spark, 4), 4, 4)
    assert got((eye @ a).df, "row", "col") == got(a.df, "row", "col")
    assert got(a.slice(1, 4, 0, 2).df, "row", "col") == [(0, 1, -1.0), (2, 0, 4.0)]
    assert [r.row for r in a.preview(2).collect()] == [0, 0]


def test_shapes_are_checked_unless_asked_not_to(spark, a):
    with pytest.raises(algebra.ShapeError):
        a.multiply(Vector(vec(spark, [(0, 1.0)]), 3))
    with pytest.raises(algebra.ShapeError):
        a.add(Matrix(coo(spark, ENTRIES), 4, 5))
    assert a.multiply(Vector(vec(spark, [(0, 1.0)]), 3), strict=False).df.count() == 2
    with pytest.raises(ValueError):
        algebra.dispatch(Vector(vec(spark, []), 1), Vector(vec(spark, []), 1))
    with pytest.raises(ValueError):
        strategy.spmv(a.df, vec(spark, []), "coo", "rowwise")


def test_shape_inference(spark):
    assert Matrix.of(coo(spark, ENTRIES)).shape == (4, 4)
    with pytest.raises(EmptyInputError):
        Matrix.of(coo(spark, []))
    assert Vector.of(vec(spark, [(8, 1.0)])).size == 9
    nine = Vector(vec(spark, [(0, 1.0)]), 10)
    assert not nine.is_sparse, "exactly 0.90 is not above the threshold"
    assert Vector(vec(spark, [(0, 1.0)]), 11).is_sparse


def test_chain_prefers_the_vector_side(spark, a):
    assert planner.chain_order([(9, 9), (9, 9), (9, 1)], [0.5, 0.5, 1.0]) == (0, (1, 2))
    v = Vector(vec(spark, [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]), 4)
    left = a.multiply(a).multiply(v).df
    assert verify.differences(planner.chain([a, a, v]).df, left, ["idx"]).count() == 0


def test_verify_reports_missing_and_different(spark):
    one, two = vec(spark, [(0, 1.0), (1, 2.0)]), vec(spark, [(1, 2.5), (2, 3.0)])
    assert sorted(r.idx for r in verify.differences(one, two, ["idx"]).collect()) == [0, 1, 2]
    assert tuple(verify.summary(one, one, ["idx"]).first()) == (0, 0.0)


TENSOR = [(0, 0, 0, 1.0), (0, 1, 0, 2.0), (1, 0, 1, 3.0), (1, 1, 1, 4.0), (2, 0, 0, 5.0), (2, 1, 1, 6.0)]


@pytest.fixture(scope="module")
def t(spark):
    return SparseTensor(spark.createDataFrame(TENSOR, "i long, j long, k long, value double"), (3, 2, 2))


def ones(spark, n, rank):
    return FactorMatrix(spark.createDataFrame([(i, r, 1.0) for i in range(n) for r in range(rank)], "idx long, r long, value double"), n, rank)


def test_golden_tensor(spark, t):
    assert got(tensor.unfold(t, 0), "row", "col") == [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0), (1, 3, 4.0), (2, 0, 5.0), (2, 3, 6.0)]
    m = coo(spark, [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 1.0), (1, 1, 1.0)])
    out = tensor.tensor_times_matrix(t, m, 1)
    want = {(0, 0): 2.5, (1, 1): 5.5, (2, 0): 2.5, (2, 1): 6.0}
    assert got(out.df, "i", "j", "k") == sorted((i, c, k, v) for (i, k), v in want.items() for c in (0, 1))
    assert out.dims == (3, 2, 2) and tensor.tensor_times_matrix(t, m, 1, num_cols=5).dims == (3, 5, 2)
    flat = tensor.mttkrp(t, [ones(spark, 2, 10), ones(spark, 2, 10)], 0).df
    assert got(flat, "idx", "r") == got(tensor.mttkrp_with_ones(t, 0, 10).df, "idx", "r")
    assert {(r.idx, r.value) for r in flat.collect()} == {(0, 3.0), (1, 7.0), (2, 11.0)}


def test_unfolding_times_khatri_rao_is_mttkrp(spark, t):
    u = FactorMatrix(generate.factor(spark, 2, 3, 1), 2, 3)
    w = FactorMatrix(generate.factor(spark, 2, 3, 2), 2, 3)
    kr = tensor.khatri_rao(u, w).df.selectExpr("idx as row", "r as col", "value")
    left = algebra.spmm_dense(tensor.unfold(t, 0), kr)
    right = tensor.mttkrp(t, [u, w], 0).df.selectExpr("idx as row", "r as col", "value")
    assert verify.differences(left, right, ["row", "col"]).count() == 0


def test_n_way_tensors(spark):
    df = spark.createDataFrame([([0, 1, 1, 0], 2.0), ([1, 0, 1, 1], 3.0)], "indices array<long>, value double")
    four = SparseTensor(df, (2, 2, 2, 2))
    assert got(tensor.unfold(four, 0), "row", "col") == [(0, 6, 2.0), (1, 3, 3.0)]
    assert got(tensor.mttkrp(four, [ones(spark, 2, 1)] * 3, 3).df, "idx", "r") == [(0, 0, 2.0), (1, 0, 3.0)]
    eye = coo(spark, [(0, 0, 1.0), (1, 1, 1.0)])
    assert sorted(tuple(r.indices) for r in tensor.tensor_times_matrix(four, eye, 2).df.collect()) == [(0, 1, 1, 0), (1, 0, 1, 1)]


def test_tensor_arguments_are_checked(spark, t):
    for bad in (-1, 3):
        with pytest.raises(ValueError):
            tensor.unfold(t, bad)
        with pytest.raises(ValueError):
            tensor.tensor_times_matrix(t, coo(spark, ENTRIES), bad)
    with pytest.raises(ValueError):
        tensor.mttkrp(t, [ones(spark, 2, 2)], 0)
    with pytest.raises(ValueError):
        tensor.khatri_rao(ones(spark, 2, 2), ones(spark, 2, 3))
    with pytest.raises(OverflowError):
        checked_product(2**40, 2**40)
    wide = SparseTensor(spark.createDataFrame([(0, 2**20, 2**20, 1.0)], "i long, j long, k long, value double"), (1, 2**21, 2**21))
    assert got(tensor.unfold(wide, 0), "row", "col") == [(0, 2**20 * 2**21 + 2**20, 1.0)]


def test_iterations(spark, a):
    import numpy as np

    dense = np.zeros((4, 4))
    for r, c, v in ENTRIES:
        dense[r, c] = v
    v = iterative.power_iteration(a, vec(spark, [(k, 1.0) for k in range(4)]), 6).df
    x = np.ones(4)
    for _ in range(6):
        x = dense @ x
        x /= np.linalg.norm(x)
    assert {r.idx: r.value for r in v.collect()} == pytest.approx({k: x[k] for k in (0, 1, 3)})
    ring = Matrix(coo(spark, [(k, (k + 1) % 4, 1.0) for k in range(4)]), 4, 4)
    assert got(iterative.pagerank(ring, 7).df, "idx") == [(k, pytest.approx(0.25)) for k in range(4)]
    assert got(iterative.matrix_power(ring, 4).df, "row", "col") == [(k, k, 1.0) for k in range(4)]
    edges = ring.df.selectExpr("row as src", "col as dst")
    assert sorted(map(tuple, iterative.k_hop_reachability(edges, 3).collect())) == [(k, (k + 3) % 4) for k in range(4)]


def test_power_iteration_plans_do_not_grow_with_the_steps(spark):
    g = Matrix(spark.createDataFrame([(0, 1, 2.0), (1, 0, 1.0), (1, 1, 3.0)], "row long, col long, value double"), 2, 2)
    scans = [iterative.power_iteration(g, steps=k).df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRelation") + iterative.power_iteration(g, steps=k).df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for k in (2, 6)]
    assert scans[0] == scans[1] > 0


def test_khatri_rao_of_large_factors_is_salted(spark, monkeypatch):
    from rowloom.operators import tensor

    f = lambda n: FactorMatrix(spark.range(n).selectExpr("id AS idx", "CAST(id % 2 AS long) AS r", "CAST(id + 1 AS double) AS value"), n, 2)
    want = sorted(map(tuple, tensor.khatri_rao(f(30), f(7)).df.collect()))
    monkeypatch.setattr(tensor, "small_enough", lambda df: False)
    assert sorted(map(tuple, tensor.khatri_rao(f(30), f(7)).df.collect())) == want


def test_caches_are_given_back(spark):
    from rowloom.operators import strategy

    a = spark.createDataFrame([(0, 1, 2.0)], "row long, col long, value double")
    x = spark.createDataFrame([(1, 3.0)], "idx long, value double")
    for _ in range(3):
        assert strategy.spmv(a, x, strategy="caching").collect()[0].value == 6.0
    held = list(strategy._held)
    assert len(held) == 2 and all(d.is_cached for d in held)
    strategy.release_caches()
    assert not strategy._held and not any(d.is_cached for d in held)


def test_mllib_spmv_keeps_index_and_product_together_and_leaves_unmatched_rows_out(spark):
    from rowloom.operators import mllib

    a, x = coo(spark, ENTRIES), vec(spark, [(0, 2.0), (2, -1.0), (3, 0.0)])
    out = mllib.spmv(a, x, 4, 4)
    assert got(out, "idx") == got(strategy.spmv(a, x), "idx") == [(0, 0.0), (3, 8.0)]
    # a zip of two evaluations of a shuffle pairs other rows wherever blocks arrive in another order
    frame = mllib._coordinates(a, 4, 4).toIndexedRowMatrix().rows
    assert "Zipped" not in out.rdd._jrdd.rdd().toDebugString() and "ShuffledRDD" in frame._jrdd.rdd().toDebugString()


def test_block_strategy_pairs_few_tiles_and_cuts_full_strips(spark, monkeypatch):
    """A tile of 100 by 100 cells for each entry of a sparse matrix made 2,500 pairs of these 100 entries."""
    scattered = coo(spark, [(k * 1000, k % 2, float(k)) for k in range(50)] + [(-5, -1, 1.0), (None, 1, 2.0), (3, 0, None), (3, 500, 1.0), (7, None, 1.0)])
    right = coo(spark, [(k % 2, k * 1000, 1.0 + k) for k in range(50)] + [(-1, 4, 2.0), (500, 9, float("nan")), (None, 3, 1.0)])
    seen = lambda df: sorted(map(repr, df.collect()))
    for zeros in (False, True):
        want = seen(strategy.spmm(scattered, right, "coo", "baseline", zeros))
        assert seen(strategy.spmm(scattered, right, "coo", "block", zeros)) == want
    assert [r.n for r in strategy._tiles(scattered, "row", "col", "a", 100).selectExpr("size(a) n").orderBy("n").collect()] == [1, 53]
    monkeypatch.setattr(strategy, "TILE_ENTRIES", 7)
    monkeypatch.setattr(strategy, "PRODUCTS", 10)
    assert seen(strategy.spmm(scattered, right, "coo", "block", True)) == want
    assert strategy._tiles(scattered, "row", "col", "a", 100).count() > 5


def test_item_similarity_sums_products_before_they_move(spark, monkeypatch):
    """The products of all pairs of a user's ratings were moved: 16 for each of these 300 users, now 16 a task."""
    import random

    from pyspark.sql import functions as F

    same = spark.range(300).selectExpr("id AS user", "explode(sequence(0L, 3L)) AS item").selectExpr("user", "item", "CAST(user + item AS double) AS rating")
    out = iterative.item_similarity(same.coalesce(1))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    moved = list(iterative.pair_sums(iter(same.orderBy("user").toArrow().to_batches(max_chunksize=7))))
    assert sum(b.num_rows for b in moved) == 16

    rng = random.Random(5)
    rows = [(u, i, float(rng.randint(-5, 5))) for u in range(60) for i in rng.sample(range(-20, 40), rng.randint(1, 12))]
    odd = [(None, 3, 1.0), (7, None, 2.0), (8, 1000, None), (9, 2**62, float("nan")), (10, 2**62 + 1, float("inf")), (11, 5, 0.5), (11, 5, 0.25)]
    seen = lambda df: sorted(repr((r.item_a, r.item_b, None if r.similarity is None else r.similarity + 0.0)) for r in df.collect())
    for data in (rows, rows + odd, [], odd[:1]):
        ratings = spark.createDataFrame(data, "user long, item long, rating double")
        a, b = (ratings.select("user", F.col("item").alias(f"item_{x}"), F.col("rating").alias(x)) for x in "ab")
        joined = a.join(b, "user")
        plain = lambda df: seen(df.groupBy("item_a", "item_b").agg(F.sum(F.col("a") * F.col("b")).alias("similarity")))
        assert seen(iterative.item_similarity(ratings)) == plain(joined)
        assert seen(iterative.item_similarity(ratings, upper_only=True)) == plain(joined.where("item_a < item_b"))
        batches = lambda: ratings.where("user is not null").orderBy("user").toArrow().to_batches(max_chunksize=5)  # noqa: E731, B023
        for name, value in (("RATINGS", 9), ("PRODUCTS", 7), ("SQUARE", 13)):
            monkeypatch.setattr(iterative, name, value)
            parts = [r for x in iterative.pair_sums(iter(batches())) for r in x.to_pylist()]
            again = spark.createDataFrame([(r["item_a"], r["item_b"], r["similarity"]) for r in parts], "item_a long, item_b long, similarity double")
            assert seen(again.groupBy("item_a", "item_b").agg(F.sum("similarity").alias("similarity"))) == plain(joined)
        monkeypatch.undo()
