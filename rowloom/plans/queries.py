"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom import sources
from rowloom.model import FactorMatrix, Matrix, SparseTensor, Vector
from rowloom.operators import algebra, iterative, layout, mllib, stats, strategy, tensor, verify
from rowloom.operators.contract import LayoutOperations
from rowloom.plans import planner
from rowloom.plans.views import Views, with_views
from rowloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Callable[[Views], DataFrame], views: str = "", sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(Views(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = with_views(views, sql) if views else sql


SPMV = 'SELECT {m}."row" AS idx, SUM({m}.value * {v}.value) AS value FROM {m} JOIN {v} ON {m}.col = {v}.idx GROUP BY 1'
SPMM = 'SELECT {a}."row" AS "row", {b}.col AS col, SUM({a}.value * {b}.value) AS value FROM {a} JOIN {b} ON {a}.col = {b}."row" GROUP BY 1, 2'
KEEP = " HAVING ABS(SUM({a}.value * {b}.value)) >= 1e-10"

# Matrix times vector: every layout and every strategy.
for _layout, _names in strategy.SPMV.items():
    for _s in _names:
        _key = f"spmv_{_layout}" if _s == "adaptive" else f"spmv_{_layout}_{_s}"
        register(_key, lambda v, lay=_layout, s=_s: strategy.spmv(layout.pack(v.part_supplier, lay), v.x_dense, lay, s), "A x", SPMV.format(m="A", v="x"))
    for _s in ("baseline", "copartition", "inpartition", "broadcast", "adaptive"):
        _key = f"spmv_sparse_{_layout}" if _s == "adaptive" else f"spmv_sparse_{_layout}_{_s}"
        register(_key, lambda v, lay=_layout, s=_s: strategy.spmv(layout.pack(v.part_supplier, lay), v.x_sparse, lay, s), "A xs", SPMV.format(m="A", v="xs"))
register("spmv_dense", lambda v: strategy.spmv(v.part_supplier, v.x_dense, "dense"), "A x", SPMV.format(m="A", v="x"))

# Matrix times matrix, sparse (zeros dropped) and dense (zeros kept).
for _layout, _names in strategy.SPMM.items():
    for _s in _names:
        _key = f"spmm_sparse_{_layout}" if _s == "adaptive" else f"spmm_sparse_{_layout}_{_s}"
        register(_key, lambda v, lay=_layout, s=_s: algebra.spmm_sparse(layout.pack(v.graph, lay), v.graph, lay, s), "G", (SPMM + KEEP).replace("{b}", "H").replace("{a}", "G").replace("JOIN H", "JOIN G H"))
        _key = f"spmm_dense_{_layout}" if _s == "adaptive" else f"spmm_dense_{_layout}_{_s}"
        register(_key, lambda v, lay=_layout, s=_s: algebra.spmm_dense(layout.pack(v.part_supplier, lay), v.b_dense, lay, s), "A B", SPMM.format(a="A", b="B"))
register("spmm_dense_dense", lambda v: _dense(v).multiply(Matrix(v.b_dense, 1, 1, "dense"), strict=False).coo(), "A B", SPMM.format(a="A", b="B"))
register("spmm_zero_filtered", lambda v: algebra.spmm_sparse(v.signed_graph, v.signed_graph), "S", (SPMM + KEEP).replace("{b}", "H").replace("{a}", "S").replace("JOIN H", "JOIN S H"))


def _dense(v: Views) -> Matrix:
    return Matrix(v.part_supplier, 1, 1, "dense")


def _m(df: DataFrame) -> Matrix:
    """A matrix whose shape does not matter to the operator at hand."""
    return Matrix(df, 1, 1)


register("vecmat", lambda v: algebra.vector_times_matrix(Vector(v.x_part, 1), _m(v.part_supplier), strict=False).df, "A xp",
         "SELECT A.col AS idx, SUM(A.value * xp.value) AS value FROM A JOIN xp ON A.\"row\" = xp.idx GROUP BY 1")
_ADD = 'SELECT "row", col, SUM(value) AS value FROM (SELECT * FROM G UNION ALL SELECT * FROM S) GROUP BY 1, 2'
register("add_coo", lambda v: _m(v.graph).add(_m(v.signed_graph)).coo(), "G S", _ADD)
register("add_csr", lambda v: Matrix.of(v.graph, 1, 1, "csr").add(_m(v.signed_graph)).coo(), "G S", _ADD)
register("add_dense", lambda v: Matrix(v.graph, 1, 1, "dense").add(_m(v.signed_graph)).coo(), "G S", _ADD)
_TRANSPOSED = 'SELECT col AS "row", "row" AS col, value FROM A'
register("transpose_coo", lambda v: _m(v.part_supplier).transpose().coo(), "A", _TRANSPOSED)
register("transpose_csr", lambda v: _m(v.part_supplier).to("csr").transpose().coo(), "A", _TRANSPOSED)
register("slice", lambda v: _m(v.part_supplier).slice(10, 150, 2, 60).coo(), "A",
         'SELECT "row" - 10 AS "row", col - 2 AS col, value FROM A WHERE "row" >= 10 AND "row" < 150 AND col >= 2 AND col < 60')

# Conversions, compared in coordinate form.
_SAME = 'SELECT "row", col, value FROM A'
for _layout in ("csr", "csc"):
    register(f"coo_to_{_layout}", lambda v, lay=_layout: layout.unpack(layout.pack(v.part_supplier, lay), lay), "A", _SAME)
    register(f"{_layout}_to_coo", lambda v, lay=_layout: Matrix.of(v.part_supplier, 1, 1, lay).to("coo").coo(), "A", _SAME)
register("csr_row_lengths", lambda v: layout.pack(v.part_supplier, "csr").select("row", F.size("values").cast("long").alias("entries"), F.col("col_indices")[0].alias("first_col")), "A",
         'SELECT "row", COUNT(*) AS entries, MIN(col) AS first_col FROM A GROUP BY 1')
register("csc_column_lengths", lambda v: layout.pack(v.part_supplier, "csc").select("col", F.size("values").cast("long").alias("entries"), F.col("row_indices")[0].alias("first_row")), "A",
         'SELECT col, COUNT(*) AS entries, MIN("row") AS first_row FROM A GROUP BY 1')
register("coo_to_dense_fill", lambda v: layout.fill(v.events, v.events.agg(F.max("row")).first()[0] + 1, 24), "E",
         'SELECT g.r AS "row", h.c AS col, COALESCE(E.value, 0.0) AS value FROM (SELECT UNNEST(range((SELECT MAX("row") + 1 FROM E))) AS r) g CROSS JOIN (SELECT UNNEST(range(24)) AS c) h LEFT JOIN E ON E."row" = g.r AND E.col = h.c')
register("dense_to_coo", lambda v: Matrix(v.b_dense, 1, 4, "dense").to("coo").coo(), "B", 'SELECT "row", col, value FROM B WHERE ABS(value) >= 1e-10')

# Shape, statistics, previews.
_DIMS = 'SELECT MAX("row") + 1 AS num_rows, MAX(col) + 1 AS num_cols, COUNT(*) AS nnz, 1 - CAST(COUNT(*) AS DOUBLE) / ((MAX("row") + 1) * (MAX(col) + 1)) AS sparsity FROM A'
register("nnz_sparsity_dims", lambda v: stats.dimensions(v.part_supplier), "A", _DIMS)
register("smart_load_decision", lambda v: stats.dimensions(v.order_part).select("nnz", F.when(F.col("sparsity") > 0.9, "coo").otherwise("dense").alias("layout")), "O",
         "SELECT COUNT(*) AS nnz, CASE WHEN 1 - CAST(COUNT(*) AS DOUBLE) / ((MAX(\"row\") + 1) * (MAX(col) + 1)) > 0.9 THEN 'coo' ELSE 'dense' END AS layout FROM O")
register("vector_stats", lambda v: stats.vector_stats(strategy.spmv(v.part_supplier, v.x_dense)), "A x",
         "SELECT COUNT(*) AS n, SUM(value) AS total, FIRST(idx ORDER BY ABS(value) DESC, idx) AS max_idx, FIRST(value ORDER BY ABS(value) DESC, idx) AS max_value, FIRST(idx ORDER BY ABS(value), idx) AS min_idx, FIRST(value ORDER BY ABS(value), idx) AS min_value FROM (" + SPMV.format(m="A", v="x") + ")")
register("matrix_stats", lambda v: stats.matrix_stats(v.part_supplier), "A",
         'SELECT COUNT(*) AS n, SUM(value) AS total, FIRST("row" ORDER BY ABS(value) DESC, "row", col) AS max_row, FIRST(col ORDER BY ABS(value) DESC, "row", col) AS max_col, MAX(value) AS max_value, FIRST("row" ORDER BY value, "row", col) AS min_row, FIRST(col ORDER BY value, "row", col) AS min_col, MIN(value) AS min_value FROM A')
register("preview_topn", lambda v: _m(v.part_supplier).preview(10), "A", 'SELECT "row", col, value FROM A ORDER BY "row", col LIMIT 10')
register("estimate_size", lambda v: stats.estimate_size(v.table("lineitem")))


# Tensors.
def _t(v: Views) -> SparseTensor:
    return SparseTensor.of(v.tensor)


def _factors(v: Views, t: SparseTensor, mode: int) -> list[FactorMatrix]:
    return [FactorMatrix(v.factor(t.dims[m]), t.dims[m], 3) for m in range(3) if m != mode]


_UNFOLD = ("i, j * dk + k", "j, i * dk + k", "k, i * dj + j")
for _mode in range(3):
    _row, _col = _UNFOLD[_mode].split(", ")
    register(f"unfold_mode{_mode}", lambda v, m=_mode: tensor.unfold(_t(v), m), "T D", f'SELECT {_row} AS "row", {_col} AS col, value FROM T, D')
    _a, _b = [c for c in "ijk" if c != "ijk"[_mode]]
    _sql = f"SELECT T.{'ijk'[_mode]} AS idx, P.r AS r, SUM(T.value * P.value * Q.value) AS value FROM T JOIN U P ON T.{_a} = P.idx JOIN U Q ON T.{_b} = Q.idx AND P.r = Q.r GROUP BY 1, 2"
    for _s in tensor.STRATEGIES:
        _key = f"mttkrp_mode{_mode}" + ("" if _s == "adaptive" else f"_{_s}")
        register(_key, lambda v, m=_mode, s=_s: tensor.mttkrp(t := _t(v), _factors(v, t, m), m, s).df, "T U", _sql)
    _out = ", ".join("M.r AS c_" + c if c == "ijk"[_mode] else f"T.{c} AS c_{c}" for c in "ijk")
    register(f"ttm_mode{_mode}", lambda v, m=_mode: tensor.tensor_times_matrix(t := _t(v), v.factor(t.dims[m]).select(F.col("idx").alias("row"), F.col("r").alias("col"), "value"), m).df, "T U",
             f"SELECT c_i AS i, c_j AS j, c_k AS k, SUM(p) AS value FROM (SELECT {_out}, T.value * M.value AS p FROM T JOIN U M ON T.{'ijk'[_mode]} = M.idx) GROUP BY 1, 2, 3 HAVING ABS(SUM(p)) >= 1e-10")
register("mttkrp_ones", lambda v: tensor.mttkrp_with_ones(_t(v), 0, 10).df, "T", "SELECT i AS idx, c AS r, SUM(value) AS value FROM T, range(10) s(c) GROUP BY 1, 2")
for _layout, _mode in (("csr", 0), ("csc", 1)):
    register(f"mttkrp_ones_{_layout}", lambda v, lay=_layout, m=_mode: layout.pack(tensor.collapse(_t(v)), lay).select(F.col("row" if lay == "csr" else "col").alias("idx"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("value")), "T",
             f"SELECT {'ij'[_mode]} AS idx, SUM(value) AS value FROM T GROUP BY 1")
register("khatri_rao", lambda v: tensor.khatri_rao(*_factors(v, _t(v), 2)).df, "T D U",
         "SELECT P.idx * dj + Q.idx AS idx, P.r AS r, P.value * Q.value AS value FROM D, U P JOIN U Q ON P.r = Q.r WHERE P.idx < di AND Q.idx < dj")
register("tensor_stats", lambda v: stats.tensor_stats(v.tensor), "T",
         "SELECT MAX(i) + 1 AS dim_i, MAX(j) + 1 AS dim_j, MAX(k) + 1 AS dim_k, COUNT(*) AS nnz, (MAX(i) + 1) * (MAX(j) + 1) * (MAX(k) + 1) AS total_elements, 1 - CAST(COUNT(*) AS DOUBLE) / ((MAX(i) + 1) * (MAX(j) + 1) * (MAX(k) + 1)) AS sparsity FROM T")


# Iterative pipelines.
def _g(v: Views) -> Matrix:
    n = v.n("customer")
    return Matrix(v.graph, n, n)


def _pagerank_sql(row: str, col: str) -> str:
    n = "CAST((SELECT COUNT(*) FROM customer) AS DOUBLE)"
    steps = [f"p0 AS (SELECT UNNEST(range((SELECT COUNT(*) FROM customer))) AS idx, 1.0 / {n} AS value)"]
    for s in range(1, 4):
        steps.append(f"p{s} AS (SELECT G.\"{row}\" AS idx, CAST(0.85 AS DOUBLE) * SUM(G.value * p.value) + CAST(0.15 AS DOUBLE) / {n} AS value FROM G JOIN p{s - 1} p ON G.\"{col}\" = p.idx GROUP BY 1)")
    return ", " + ", ".join(steps) + " SELECT idx, ROUND(value, 12) AS value FROM p3"


def _rounded(v: Vector) -> DataFrame:
    return v.df.select("idx", F.round("value", 12).alias("value"))


register("pagerank_k3", lambda v: _rounded(iterative.pagerank(_g(v), 3)))
register("pagerank_transposed_k3", lambda v: _rounded(iterative.pagerank(_g(v), 3, transpose=True)))
for _key, _row, _col in (("pagerank_k3", "row", "col"), ("pagerank_transposed_k3", "col", "row")):
    ORACLES[_key] = with_views("G", "") .rstrip() + _pagerank_sql(_row, _col)
_POWER = ", ".join(
    f"y{s} AS (SELECT G.\"row\" AS idx, SUM(G.value * v.value) AS value FROM G JOIN v{s - 1} v ON G.col = v.idx GROUP BY 1), v{s} AS (SELECT idx, value / SQRT((SELECT SUM(value * value) FROM y{s})) AS value FROM y{s})"
    for s in range(1, 4)
)
register("power_iteration_k3", lambda v: _rounded(iterative.power_iteration(_g(v), v.spark.range(v.n("customer")).select(F.col("id").alias("idx"), (F.col("id") % 7 + 1).cast("double").alias("value")), 3)))
ORACLES["power_iteration_k3"] = with_views("G", "").rstrip() + ", v0 AS (SELECT i AS idx, CAST(i % 7 + 1 AS DOUBLE) AS value FROM (SELECT UNNEST(range((SELECT COUNT(*) FROM customer))) AS i)), " + _POWER + " SELECT idx, ROUND(value, 12) AS value FROM v3"
_START = "v0 AS (SELECT i AS idx, CAST(1 + i % 3 AS DOUBLE) AS value FROM (SELECT UNNEST(range((SELECT COUNT(*) FROM customer))) AS i))"
_TWICE = ", " + _START + ', v1 AS (SELECT G."row" AS idx, SUM(G.value * v.value) AS value FROM G JOIN v0 v ON G.col = v.idx GROUP BY 1) SELECT G."row" AS idx, SUM(G.value * v.value) AS value FROM G JOIN v1 v ON G.col = v.idx GROUP BY 1'


def _start(v: Views) -> DataFrame:
    return v.spark.range(v.n("customer")).select(F.col("id").alias("idx"), (F.col("id") % 3 + 1).cast("double").alias("value"))


register("iterated_spmv_k2", lambda v: iterative.iterated_spmv(_g(v), _start(v), 2).df)
register("matrix_chain", lambda v: planner.chain([g := _g(v), g, Vector(_start(v), g.num_cols)]).df)
register("recommend", lambda v: iterative.recommend(_g(v), _start(v)))
for _key in ("iterated_spmv_k2", "matrix_chain", "recommend"):
    ORACLES[_key] = with_views("G", "").rstrip() + _TWICE
_SIMILAR = 'SELECT a.item AS item_a, b.item AS item_b, SUM(a.rating * b.rating) AS similarity FROM R a JOIN R b ON a."user" = b."user" {} GROUP BY 1, 2'
register("item_similarity", lambda v: iterative.item_similarity(v.ratings), "R", _SIMILAR.format(""))
register("item_similarity_upper", lambda v: iterative.item_similarity(v.ratings, upper_only=True), "R", _SIMILAR.format("WHERE a.item < b.item"))
register("matrix_power_k2", lambda v: iterative.matrix_power(_g(v), 2).coo(), "G", (SPMM + KEEP).replace("{b}", "H").replace("{a}", "G").replace("JOIN H", "JOIN G H"))
register("khop_reach_k3", lambda v: iterative.k_hop_reachability(v.graph.select(F.col("row").alias("src"), F.col("col").alias("dst")), 3), "G",
         'SELECT DISTINCT p.src AS src, e.col AS dst FROM (SELECT DISTINCT a."row" AS src, b.col AS dst FROM G a JOIN G b ON a.col = b."row") p JOIN G e ON p.dst = e."row"')
register("graph_centrality_k3", lambda v: iterative.centrality(_g(v), 3).df)
_ONES = 'w1 AS (SELECT "row" AS idx, SUM(value) AS value FROM G GROUP BY 1), ' + ", ".join(f'w{s} AS (SELECT G."row" AS idx, SUM(G.value * w.value) AS value FROM G JOIN w{s - 1} w ON G.col = w.idx GROUP BY 1)' for s in (2, 3))
ORACLES["graph_centrality_k3"] = with_views("G", "").rstrip() + ", " + _ONES + " SELECT idx, value FROM w3"
register("verify_equivalence", lambda v: verify.summary(strategy.spmv(v.part_supplier, v.x_dense), strategy.spmv(layout.pack(v.part_supplier, "csc"), v.x_dense, "csc", "colwise"), ["idx"]), "A x",
         'SELECT COUNT(*) FILTER (p.idx IS NULL OR q.idx IS NULL OR ABS(p.value - q.value) > 1e-10) AS mismatches, COALESCE(MAX(ABS(p.value - q.value)), 0) AS max_error '
         'FROM (SELECT "row" AS idx, SUM(A.value * x.value) AS value FROM A JOIN x ON A.col = x.idx GROUP BY 1) p '
         'FULL JOIN (SELECT "row" AS idx, SUM(s) AS value FROM (SELECT "row", x.value AS w, SUM(A.value) * x.value AS s FROM A JOIN x ON A.col = x.idx GROUP BY 1, 2) GROUP BY 1) q ON p.idx = q.idx')  # fmt: skip


# Text files: a view is saved and read again by each reader.
def _file(v: Views, df: DataFrame, columns: str) -> str:
    """The path of a folder of unsorted comma-separated lines."""
    path = scratch_path(v.spark, "text")
    df.select(F.concat_ws(",", *columns.split()).alias("value")).write.text(path)
    return path


def _saved(v: Views, df: DataFrame, save: Callable[[DataFrame, str], None]) -> str:
    path = scratch_path(v.spark, "saved")
    save(df, path)
    return path


register("csv_sparse_matrix", lambda v: sources.load_sparse_matrix(v.spark, _saved(v, v.signed_graph, sources.save_matrix)), "G S", 'SELECT "row", col, value FROM S')
register("csv_dense_matrix", lambda v: sources.load_dense_matrix(v.spark, _saved(v, v.b_dense, sources.save_matrix)), "B", 'SELECT "row", col, value FROM B')
register("csv_sparse_vector", lambda v: sources.load_sparse_vector(v.spark, _saved(v, v.x_sparse, sources.save_vector)), "xs", "SELECT idx, value FROM xs")
register("csv_dense_vector", lambda v: sources.load_dense_vector(v.spark, _saved(v, v.x_dense, sources.save_vector)), "x", "SELECT idx, value FROM x")
register("csv_tensor", lambda v: sources.load_tensor(v.spark, _file(v, v.tensor, "i j k value")), "T", "SELECT i, j, k, value FROM T")


def _smart_matrix(v: Views) -> DataFrame:
    m = sources.load_matrix(v.spark, _saved(v, v.order_part, sources.save_matrix))
    return m.df.agg(F.count(F.lit(1)).alias("nnz")).select("nnz", F.lit(m.layout).alias("layout"), F.lit(m.num_rows).cast("long").alias("num_rows"), F.lit(m.num_cols).cast("long").alias("num_cols"))


def _smart_vector(v: Views) -> DataFrame:
    x = sources.load_vector(v.spark, _saved(v, v.x_edge, sources.save_vector))
    return x.df.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(x.kind).alias("kind"), F.lit(x.size).cast("long").alias("size"))


def _sniffed(v: Views) -> DataFrame:
    paths = {"A": _saved(v, v.part_supplier, sources.save_matrix), "x": _saved(v, v.x_dense, sources.save_vector)}
    kinds = {name: sources.sniff(v.spark, path) for name, path in paths.items()}
    rows = [(name, kind, sources.exists(v.spark, paths[name])) for name, kind in kinds.items()]
    return v.spark.createDataFrame([*rows, ("A x", sources.operation_of(kinds["A"], kinds["x"]), sources.exists(v.spark, paths["x"] + "-none"))], "name string, kind string, there boolean")


register("smart_load_matrix", _smart_matrix, "O",
         "SELECT COUNT(*) AS nnz, CASE WHEN 1 - CAST(COUNT(*) AS DOUBLE) / ((MAX(\"row\") + 1) * (MAX(col) + 1)) > 0.9 THEN 'coo' ELSE 'dense' END AS layout, MAX(\"row\") + 1 AS num_rows, MAX(col) + 1 AS num_cols FROM O")
register("smart_load_vector", _smart_vector, "xe",
         "SELECT COUNT(*) AS n, CASE WHEN 1 - CAST(COUNT(*) AS DOUBLE) / (MAX(idx) + 1) > 0.9 THEN 'sparse' ELSE 'dense' END AS kind, MAX(idx) + 1 AS size FROM xe")
register("sniff_files", _sniffed, "",
         "SELECT * FROM (VALUES ('A', 'matrix', TRUE), ('x', 'vector', TRUE), ('A x', 'matrix-vector', FALSE)) t(name, kind, there)")


# The products as a protocol, and by Spark's distributed matrices.
def _extent(df: DataFrame) -> tuple[int, int]:
    return tuple(df.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols")).first())


def _mllib_spmv(v: Views) -> DataFrame:
    rows, cols = _extent(v.part_supplier)
    return mllib.spmv(v.part_supplier, v.x_dense.where(F.col("idx") < cols), rows, cols)


def _mllib_spmm(v: Views) -> DataFrame:
    rows, inner = _extent(v.part_supplier)
    return mllib.spmm(v.part_supplier, v.b_dense.where(F.col("row") < inner), rows, inner, 4)


register("mllib_spmv", _mllib_spmv, "A x", SPMV.format(m="A", v="x"))
register("mllib_spmm", _mllib_spmm, "A B", SPMM.format(a="A", b="B") + " HAVING SUM(A.value * B.value) <> 0")
register("contract_spmv", lambda v: LayoutOperations("csc").spmv(layout.pack(v.part_supplier, "csc"), v.x_dense), "A x", SPMV.format(m="A", v="x"))
register("contract_spmv_sparse", lambda v: LayoutOperations("csr").spmv_sparse(layout.pack(v.part_supplier, "csr"), v.x_sparse), "A xs", SPMV.format(m="A", v="xs"))
register("contract_spmm_dense", lambda v: LayoutOperations("csr").spmm_dense(layout.pack(v.part_supplier, "csr"), v.b_dense), "A B", SPMM.format(a="A", b="B"))
register("contract_spmm_sparse", lambda v: LayoutOperations().spmm_sparse(v.graph, v.graph), "G", (SPMM + KEEP).replace("{b}", "H").replace("{a}", "G").replace("JOIN H", "JOIN G H"))
