"""The star-schema tables seen as matrices, vectors, tensors and graphs: once as DataFrames, once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """Lazy views over a folder of Parquet tables; each is a scan, a projection and at most one aggregate or join."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _quantity(self, row: str, col: str) -> DataFrame:
        line = self.table("lineitem").select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col("l_quantity").cast("double").alias("q"))
        return line.groupBy("row", "col").agg(F.sum("q").alias("value"))

    @property
    def part_supplier(self) -> DataFrame:
        return self._quantity("l_partkey", "l_suppkey")

    @property
    def order_part(self) -> DataFrame:
        return self._quantity("l_orderkey", "l_partkey")

    @property
    def x_dense(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").cast("long").alias("idx"), (F.lit(1) + F.col("s_suppkey") % 7).cast("double").alias("value"))

    @property
    def x_sparse(self) -> DataFrame:
        """Only suppliers in debt."""
        s = self.table("supplier").where("s_acctbal < 0")
        return s.select(F.col("s_suppkey").cast("long").alias("idx"), (F.lit(1) + F.col("s_suppkey") % 7).cast("double").alias("value"))

    @property
    def x_edge(self) -> DataFrame:
        """Every eleventh supplier: about nine in ten entries are absent, at the edge of what counts as sparse."""
        return self.x_dense.where("idx % 11 = 0")

    @property
    def x_part(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("long").alias("idx"), (F.lit(1) + F.col("p_partkey") % 5).cast("double").alias("value"))

    @property
    def b_dense(self) -> DataFrame:
        s = self.table("supplier").select(F.col("s_suppkey").cast("long").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("col"))
        return s.select("row", "col", ((F.col("row") * 7 + F.col("col") * 3) % 11).cast("double").alias("value"))

    def n(self, table: str) -> int:
        return self.table(table).count()

    @property
    def graph(self) -> DataFrame:
        """Customer o_custkey -> o_orderkey mod the number of customers, weight 1, distinct."""
        n = self.n("customer")
        o = self.table("orders").select(F.col("o_custkey").cast("long").alias("row"), (F.col("o_orderkey") % n).cast("long").alias("col"))
        return o.distinct().withColumn("value", F.lit(1.0))

    @property
    def signed_graph(self) -> DataFrame:
        """The graph with weights +1 and -1, so that products cancel."""
        return self.graph.withColumn("value", F.when((F.col("row") + F.col("col")) % 2 == 0, 1.0).otherwise(-1.0))

    @property
    def ratings(self) -> DataFrame:
        line = self.table("lineitem").select("l_orderkey", F.col("l_suppkey").cast("long").alias("item"), F.col("l_quantity").cast("double").alias("q"))
        order = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("long").alias("user"))
        return line.join(order, "l_orderkey").groupBy("user", "item").agg(F.sum("q").alias("rating"))

    @property
    def tensor(self) -> DataFrame:
        flag = F.col("l_returnflag")
        k = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).cast("long")
        line = self.table("lineitem").select(F.col("l_suppkey").cast("long").alias("i"), F.col("l_linenumber").cast("long").alias("j"), k.alias("k"), F.col("l_quantity").cast("double").alias("q"))
        return line.groupBy("i", "j", "k").agg(F.sum("q").alias("value"))

    @property
    def events(self) -> DataFrame:
        e = self.table("events").select(F.col("user_id").cast("long").alias("row"), F.hour("ts").cast("long").alias("col"))
        return e.groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("value"))

    def factor(self, n: int) -> DataFrame:
        f = self.spark.range(n).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("r"))
        return f.withColumn("value", ((F.col("idx") * 2 + F.col("r")) % 5).cast("double"))


_QUANTITY = "SELECT CAST({0} AS BIGINT) AS \"row\", CAST({1} AS BIGINT) AS col, CAST(SUM(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2"

#: The same views for DuckDB, by the name that the queries use.
SQL = {
    "A": _QUANTITY.format("l_partkey", "l_suppkey"),
    "O": _QUANTITY.format("l_orderkey", "l_partkey"),
    "x": "SELECT CAST(s_suppkey AS BIGINT) AS idx, CAST(1 + s_suppkey % 7 AS DOUBLE) AS value FROM supplier",
    "xs": "SELECT CAST(s_suppkey AS BIGINT) AS idx, CAST(1 + s_suppkey % 7 AS DOUBLE) AS value FROM supplier WHERE s_acctbal < 0",
    "xp": "SELECT CAST(p_partkey AS BIGINT) AS idx, CAST(1 + p_partkey % 5 AS DOUBLE) AS value FROM part",
    "B": "SELECT CAST(s_suppkey AS BIGINT) AS \"row\", CAST(c AS BIGINT) AS col, CAST((s_suppkey * 7 + c * 3) % 11 AS DOUBLE) AS value FROM supplier, range(4) t(c)",
    "G": "SELECT DISTINCT CAST(o_custkey AS BIGINT) AS \"row\", CAST(o_orderkey % (SELECT COUNT(*) FROM customer) AS BIGINT) AS col, CAST(1 AS DOUBLE) AS value FROM orders",
    "S": "SELECT \"row\", col, CAST(CASE WHEN (\"row\" + col) % 2 = 0 THEN 1 ELSE -1 END AS DOUBLE) AS value FROM G",
    "R": "SELECT CAST(o_custkey AS BIGINT) AS \"user\", CAST(l_suppkey AS BIGINT) AS item, CAST(SUM(l_quantity) AS DOUBLE) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "T": "SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_linenumber AS BIGINT) AS j, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS k, CAST(SUM(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2, 3",
    "D": "SELECT MAX(i) + 1 AS di, MAX(j) + 1 AS dj, MAX(k) + 1 AS dk FROM T",
    "E": "SELECT CAST(user_id AS BIGINT) AS \"row\", CAST(hour(ts) AS BIGINT) AS col, CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2",
    "U": "SELECT CAST(i AS BIGINT) AS idx, CAST(c AS BIGINT) AS r, CAST((i * 2 + c) % 5 AS DOUBLE) AS value FROM (SELECT UNNEST(range((SELECT GREATEST(MAX(l_suppkey), MAX(l_linenumber), 2) + 1 FROM lineitem))) AS i) t, range(3) s(c)",
    "xe": "SELECT CAST(s_suppkey AS BIGINT) AS idx, CAST(1 + s_suppkey % 7 AS DOUBLE) AS value FROM supplier WHERE s_suppkey % 11 = 0",
}
_NEEDS = {"S": ["G"], "D": ["T"]}


def with_views(names: str, body: str) -> str:
    """Prefix body with the named views as common table expressions."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in (*_NEEDS.get(name, []), name) if n not in wanted]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted) + " " + body
