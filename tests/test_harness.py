"""The benchmark harness on the smallest tables, and the protocol of products."""

from rowloom import harness
from rowloom.operators.contract import LayoutOperations, MatrixOperations
from rowloom.operators.strategy import estimated_bytes, optimal_partitions

SF = "/root/testdata/sf0.001"


def test_operations_follow_the_protocol():
    assert isinstance(LayoutOperations("csr"), MatrixOperations) and not isinstance(object(), MatrixOperations)


def test_sizes_come_from_the_planner(spark):
    assert estimated_bytes(spark.range(1000)) == 8000
    assert optimal_partitions(0, 8) == 8 and optimal_partitions(20 * (128 << 20), 8) == 20 and optimal_partitions(1 << 60, 8) == 32


def test_settings_are_given_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with harness.settings(spark, {"spark.sql.shuffle.partitions": "3", "spark.rowloom.none": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.rowloom.none", None) is None


def test_verification_and_report(spark):
    suite = harness.Suite(spark, SF, repeats=1)
    checks = suite.verification()
    timings = [*suite.scalability(), *suite.ablation()]
    suite.close()
    assert checks and all(n == 0 and error < 1e-9 for _, _, n, error in checks)
    text = harness.report(harness.environment(spark), timings, checks)
    assert f"{len(checks)} of {len(checks)} passed." in text and "## shuffle partitions" in text and "| all on |" in text
