"""Sweeps over layouts, strategies, partition counts and planner settings, and a Markdown report of them.

python -m rowloom.harness SF_DIR [-o REPORT.md] [--repeats N]
"""

from __future__ import annotations

import argparse
import os
import platform
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from statistics import median

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.model import FactorMatrix, Matrix, SparseTensor
from rowloom.operators import iterative, layout, strategy, tensor, verify
from rowloom.plans.views import Views
from rowloom.session import drop_table, local_session, materialise

#: Planner features that the ablation switches off.
FEATURES = {
    "adaptive execution": {"spark.sql.adaptive.enabled": "false"},
    "broadcast joins": {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"},
    "code generation": {"spark.sql.codegen.wholeStage": "false"},
}


@dataclass(frozen=True)
class Timing:
    group: str
    case: str
    seconds: float
    speedup: float  # against the first case of the group


def environment(spark: SparkSession) -> dict[str, str]:
    """What a reader of timings has to know."""
    context = spark.sparkContext
    memory = context.getConf().get("spark.driver.memory", "default") if context.master.startswith("local") else context.getConf().get("spark.executor.memory", "default")
    settings = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")}
    return {"Spark": pyspark.__version__, "Python": platform.python_version(), "master": context.master, "parallelism": str(context.defaultParallelism), "cores": str(os.cpu_count()), "memory": memory, **settings}


def seconds(run: Callable[[], DataFrame], repeats: int = 3) -> float:
    """Median time of the whole result written to the noop sink, after one run that is not counted."""
    taken = []
    for _ in range(repeats + 1):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return median(taken[1:])


def compare(group: str, cases: Iterable[tuple[str, Callable[[], DataFrame]]], repeats: int = 3) -> Iterator[Timing]:
    first = None
    for case, run in cases:
        taken = seconds(run, repeats)
        first = first or taken
        yield Timing(group, case, round(taken, 3), round(first / taken, 2))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _under(spark: SparkSession, values: dict[str, str], run: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """Plans are fixed when they are first asked for, so the settings hold until then."""

    def planned() -> DataFrame:
        with settings(spark, values):
            df = run()
            df._jdf.queryExecution().executedPlan()
            return df

    return planned


class Suite:
    """All sweeps over one folder of tables; operands are written once in each layout and read again by every case."""

    def __init__(self, spark: SparkSession, sf_dir: str, repeats: int = 3):
        self.spark, self.repeats = spark, repeats
        v = Views(spark, sf_dir)
        self.written = {
            **{lay: materialise(layout.pack(v.part_supplier, lay), lay) for lay in ("coo", "csr", "csc")},
            "x": materialise(v.x_dense, "x"), "b": materialise(v.b_dense, "b"), "t": materialise(v.tensor, "t"), "g": materialise(v.graph, "g"),
        }
        self.size = v.n("customer")
        self.dims = tuple(self.written["t"].agg(*((F.max(c) + 1).alias(c) for c in "ijk")).first())
        self.factors = [materialise(v.factor(n), "factor") for n in self.dims]

    def close(self) -> None:
        for table in (*self.written.values(), *self.factors):
            drop_table(table)

    def naive(self) -> DataFrame:
        """The product as anyone would write it in SQL."""
        w = self.written
        return self.spark.sql("SELECT a.row AS idx, SUM(a.value * x.value) AS value FROM {a} a JOIN {x} x ON a.col = x.idx GROUP BY 1", a=w["coo"], x=w["x"])

    def conversions(self) -> Iterator[Timing]:
        return compare("conversion from coo", ((lay, lambda lay=lay: layout.pack(self.written["coo"], lay)) for lay in ("csr", "csc")), self.repeats)

    def formats(self) -> Iterator[Timing]:
        w = self.written
        cases = [("plain SQL", self.naive)] + [(lay, lambda lay=lay: strategy.spmv(w[lay], w["x"], lay)) for lay in ("coo", "csr", "csc")]
        yield from compare("matrix times vector by layout", cases, self.repeats)
        yield from compare("matrix times dense matrix by layout", ((lay, lambda lay=lay: strategy.spmm(w[lay], w["b"], lay, drop_zeros=False)) for lay in ("coo", "csr", "csc")), self.repeats)

    def strategies(self) -> Iterator[Timing]:
        w = self.written
        for lay, names in strategy.SPMV.items():
            yield from compare(f"matrix times vector, {lay}", ((s, lambda s=s: strategy.spmv(w[lay], w["x"], lay, s)) for s in names), self.repeats)
        for lay, names in strategy.SPMM.items():
            yield from compare(f"matrix times dense matrix, {lay}", ((s, lambda s=s: strategy.spmm(w[lay], w["b"], lay, s, drop_zeros=False)) for s in names), self.repeats)
        t, others = SparseTensor(w["t"], self.dims), [FactorMatrix(f, n, 3) for f, n in zip(self.factors[1:], self.dims[1:], strict=True)]
        yield from compare("MTTKRP, mode 0", ((s, lambda s=s: tensor.mttkrp(t, others, 0, s).df) for s in tensor.STRATEGIES), self.repeats)
        strategy.release_caches()

    def scalability(self) -> Iterator[Timing]:
        w, most = self.written, self.spark.sparkContext.defaultParallelism
        run = lambda: strategy.spmv(w["coo"], w["x"], "coo", "baseline")
        counts = [n for n in (1, 2, 4, 8, 16, 32, 64) if n <= most]
        # coalescing would undo the counts
        cases = ((str(n), _under(self.spark, {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}, run)) for n in counts)
        return compare("shuffle partitions", cases, self.repeats)

    def ablation(self) -> Iterator[Timing]:
        w = self.written
        run = lambda: strategy.spmv(w["coo"], w["x"])
        yield from compare("without one feature", [("all on", run)] + [(name, _under(self.spark, off, run)) for name, off in FEATURES.items()], self.repeats)
        off, cases = {}, [("all on", run)]
        for name, values in FEATURES.items():
            off = {**off, **values}
            cases.append((f"and no {name}", _under(self.spark, off, run)))
        yield from compare("features off one after another", cases, self.repeats)

    def end_to_end(self) -> Iterator[Timing]:
        w = self.written
        g = Matrix(w["g"], self.size + 1, self.size + 1)
        cases = [("pagerank, 3 steps", lambda: iterative.pagerank(g, 3).df), ("centrality, 3 steps", lambda: iterative.centrality(g, 3).df)]
        yield from compare("end to end", cases, self.repeats)

    def verification(self) -> list[tuple[str, str, int, float]]:
        """(group, case, differing rows, largest difference) of every strategy against the plain product."""
        w, found = self.written, []
        wanted_v, wanted_m = self.naive(), strategy.spmm(w["coo"], w["b"], drop_zeros=False)
        for table, keys, wanted, group in ((strategy.SPMV, ["idx"], wanted_v, "matrix times vector"), (strategy.SPMM, ["row", "col"], wanted_m, "matrix times dense matrix")):
            for lay, names in table.items():
                for s in names:
                    got = strategy.spmv(w[lay], w["x"], lay, s) if keys == ["idx"] else strategy.spmm(w[lay], w["b"], lay, s, drop_zeros=False)
                    row = verify.summary(got, wanted, keys).first()
                    found.append((group, f"{lay} {s}", row.mismatches, row.max_error))
        strategy.release_caches()
        return found


def report(env: dict[str, str], timings: Iterable[Timing], checks: list[tuple[str, str, int, float]]) -> str:
    """Markdown: the environment, one table for each group of timings, and the verification with its totals."""
    lines = ["# Benchmark report", "", "| setting | value |", "|-|-|", *(f"| {k} | {v} |" for k, v in env.items())]
    group = None
    for t in timings:
        if t.group != group:
            group = t.group
            lines += ["", f"## {group}", "", "| case | seconds | speed-up |", "|-|-|-|"]
        lines.append(f"| {t.case} | {t.seconds} | {t.speedup} |")
    passed = sum(1 for c in checks if c[2] == 0)
    lines += ["", "## Verification", "", f"{passed} of {len(checks)} passed.", "", "| group | case | differing rows | largest difference |", "|-|-|-|-|"]
    lines += [f"| {g} | {case} | {n} | {error:.3g} |" for g, case, n, error in checks]
    return "\n".join(lines) + "\n"


def run(spark: SparkSession, sf_dir: str, repeats: int = 3) -> str:
    suite = Suite(spark, sf_dir, repeats)
    try:
        parts = (suite.conversions, suite.formats, suite.strategies, suite.scalability, suite.ablation, suite.end_to_end)
        return report(environment(spark), [t for part in parts for t in part()], suite.verification())
    finally:
        suite.close()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="rowloom.harness")
    p.add_argument("sf_dir")
    p.add_argument("-o", "--output")
    p.add_argument("--repeats", type=int, default=3)
    args = p.parse_args(argv)
    spark = local_session()
    text = run(spark, args.sf_dir, args.repeats)
    spark.stop()
    if args.output:
        with open(args.output, "w") as f:
            f.write(text)
    else:
        print(text)


if __name__ == "__main__":
    main()
