"""Text readers and writers, file sniffing, the command line, generators and streams."""

import pytest

from rowloom import cli
from rowloom.model import EmptyInputError
from rowloom.sources import csv, discover, exists, generate, load_matrix, load_vector, save_matrix, save_vector, sniff
from rowloom.streaming.incremental import stream_spmv, windowed_counts


def write(path, text):
    path.write_text(text)
    return str(path)


def test_lenient_reader_skips_and_drops(spark, tmp_path):
    p = write(tmp_path / "m.csv", "row,col,value\n0,1,2.5\n\n 1 , 2 , 3 , extra\nbad\n1,2\n1.0,2,3\n2,2,0.0\n3,3,1e-11\n+4,4,-1e3\n")
    assert sorted(map(tuple, csv.load_sparse_matrix(spark, p).collect())) == [(0, 1, 2.5), (1, 2, 3.0), (4, 4, -1000.0)]


def test_strict_readers_fail_and_keep_zeros(spark, tmp_path):
    good = write(tmp_path / "v.csv", "index,value\n0,0.0\n1,2\n")
    assert sorted(map(tuple, csv.load_dense_vector(spark, good).collect())) == [(0, 0.0), (1, 2.0)]
    bad = write(tmp_path / "w.csv", "index,value\n0,x\n")
    with pytest.raises(Exception, match="malformed"):
        csv.load_dense_vector(spark, bad).collect()
    with pytest.raises(Exception, match="malformed"):
        csv.load_dense_matrix(spark, write(tmp_path / "d.csv", "row,col,value\n0,1\n")).collect()
    t = write(tmp_path / "t.csv", "i,j,k,value\n0,0,1,2\n0,1,0,0\n")
    assert [tuple(r) for r in csv.load_tensor(spark, t).collect()] == [(0, 0, 1, 2.0)]


def test_smart_loading(spark, tmp_path):
    p = write(tmp_path / "m.csv", "row,column,value\n0,0,1\n9,9,1\n")
    m = load_matrix(spark, p)
    assert (m.layout, m.shape) == ("coo", (10, 10))
    assert load_matrix(spark, p, force_dense=True).layout == "dense"
    assert load_matrix(spark, p, force_sparse=True, force_dense=True).layout == "coo"
    v = load_vector(spark, write(tmp_path / "v.csv", "index,value\n0,0\n10,1\n"))
    assert (v.size, v.kind) == (11, "dense")
    assert load_vector(spark, write(tmp_path / "s.csv", "index,value\n100,1\n")).kind == "sparse"
    for text in ("row,col,value\n", "row,col,value\n0,0,0\n"):
        with pytest.raises(EmptyInputError):
            load_matrix(spark, write(tmp_path / "e.csv", text))


def test_sniffing_and_discovery(spark, tmp_path):
    assert sniff(spark, write(tmp_path / "a.csv", "INDEX,value\n\n1,2\n")) == "vector"
    assert sniff(spark, write(tmp_path / "b.csv", "Row,col,value\n1,2,3\n")) == "matrix"
    with pytest.raises(ValueError):
        sniff(spark, write(tmp_path / "c.csv", "1,2,3,4\n"))
    with pytest.raises(EmptyInputError):
        sniff(spark, write(tmp_path / "d.csv", "row,col,value\n"))
    for n in ("sparse_matrix_10x15.csv", "sparse_matrix_2000x10.csv", "dense_vector_10.csv"):
        write(tmp_path / n, "")
    assert [(d["rows"], d["category"]) for d in discover(spark, str(tmp_path))] == [(2000, "medium")]
    assert discover(spark, str(tmp_path), "small") == [] and len(discover(spark, str(tmp_path), "medium")) == 1
    assert exists(spark, str(tmp_path / "a.csv")) and not exists(spark, str(tmp_path / "none.csv"))


def test_command_line_round_trip(spark, tmp_path, capsys):
    a = write(tmp_path / "a.csv", "row,col,value\n0,0,2\n1,1,3\n")
    b = write(tmp_path / "b.csv", "index,value\n0,5\n1,7\n")
    for extra in ([], ["--format", "csr", "--strategy", "rowwise"], ["--format", "csc", "--strategy", "colwise"]):
        out = tmp_path / f"out{len(extra)}{'-'.join(extra)}"
        assert cli.main([a, b, "-o", str(out), *extra]) == 0
        assert sorted(r[0] for r in spark.read.text(str(out)).collect()) == ["0,10.0", "1,21.0"]
    assert "2 entries" in capsys.readouterr().out
    assert cli.main([b, a, "--no-stats", "--no-preview"]) == 0
    assert cli.main([b, b]) == 1 and cli.main([a]) == 1


def test_saves_are_sorted(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, 2.0), (0, 1, 1.0)], "row long, col long, value double")
    save_matrix(m, str(tmp_path / "m"))
    save_vector(m.selectExpr("row as idx", "value"), str(tmp_path / "v"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "m")).orderBy("value").collect()] == ["0,1,1.0", "1,0,2.0"]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "v")).collect()) == ["0,1.0", "1,2.0"]


def test_generators_are_seeded(spark):
    one, two = (generate.sparse_matrix(spark, 30, 30, 0.9).collect() for _ in range(2))
    assert sorted(one) == sorted(two) and 40 < len(one) < 160
    assert len({(r.row, r.col) for r in one}) == len(one)
    assert generate.dense_vector(spark, 7).count() == 7
    assert generate.tensor(spark, (4, 5, 6), 1.0).count() == 120
    assert generate.sparse_vector(spark, 500).count() < 80


def test_streamed_products_equal_the_batch(spark, tmp_path):
    entries = generate.sparse_matrix(spark, 40, 20, 0.5)
    entries.repartition(3).write.parquet(str(tmp_path / "in"))
    x = generate.dense_vector(spark, 20)
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_spmv(stream, x).writeStream.outputMode("complete").format("memory").queryName("spmv_out").start()
    q.processAllAvailable()
    q.stop()
    from rowloom.operators import strategy, verify

    assert verify.differences(spark.table("spmv_out"), strategy.spmv(entries, x), ["idx"]).count() == 0


def test_windowed_counts(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    src.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "ev"))
    q = windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("win_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("win_out").agg({"n": "sum"}).first()[0] == src.count()


def test_written_tables_are_deleted(spark):
    from rowloom.session import drop_table, materialise

    t = materialise(spark.range(5), "five", "zstd")
    path = t.written_path
    assert t.count() == 5 and exists(spark, path)
    drop_table(t)
    assert not exists(spark, path) and spark.conf.get("spark.sql.files.minPartitionNum", None) is None
