"""Operators on vectors, conversations and pages, the registered queries with SQL, and the pipeline."""

import hashlib
import base64
import random
import struct

import numpy as np
import pytest
from compare import connect, differs
from pyspark.sql import functions as F

import corpus_pipeline
from rowloom.llm import chat, neighbours, queries, warc

SF = "/root/testdata/sf0.001"


# Nearest neighbours.
def brute(ids, rows, k=5):
    v = np.array(rows, dtype=np.float64)
    norm = np.sqrt((v * v).sum(1))
    out = {}
    for i, q in enumerate(ids):
        if q % 50 == 0:
            s = (v * v[i]).sum(1) / (norm * norm[i])
            s[i] = -9
            best = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
            out[q] = [(r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(best)]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_recall_against_brute_force(spark):
    for sf in ("sf0.001", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        src = df.collect()
        want = brute(np.array([r.vec_id for r in src]), [r.embedding for r in src])
        got = found(neighbours.search(df, F.col("vec_id") % 50 == 0).collect())
        assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
        hits = sum(len({v for _, v, _ in want[q]} & {v for _, v, _ in got[q]}) for q in want)
        assert hits >= 0.95 * 5 * len(want)
        exact = {(q, v): s for q, x in want.items() for _, v, s in x}
        assert all(s == exact[q, v] for q, x in got.items() for _, v, s in x if (q, v) in exact)


def test_pruning_on_clustered_vectors(spark, monkeypatch):
    """Over 200 lists, of which a query reads few, with nearly all true neighbours found."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(1500, 32))
    rows = (np.repeat(centres, 20, axis=0) + 0.35 * rng.normal(size=(30_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(8)
    index, dimension = neighbours.fit(df.withColumnRenamed("embedding", "vector"))
    assert dimension == 32 and len(index.centroids) >= 200
    units = neighbours.unit(rows.astype(np.float64))
    lists = np.concatenate([index.lists_of_vectors(units[a : a + 4096]) for a in range(0, len(units), 4096)])
    assert 1 <= (lists >= 0).sum(axis=1).mean() < 3, "only boundary vectors are replicated"
    asked = np.arange(0, len(rows), 50)
    at, probed = index.lists_of_queries(units[asked])
    scored = [np.isin(lists, probed[at == k]).any(axis=1).mean() for k in range(0, len(asked), 10)]
    assert np.mean(scored) < 0.2
    want = np.argsort(-(units[asked] @ units.T - 9.0 * (asked[:, None] == np.arange(len(rows)))), axis=1)[:, :5]
    got = found(neighbours.search(df, F.col("vec_id") % 50 == 0).collect())
    assert sum(len(set(w.tolist()) & {v for _, v, _ in got[int(q)]}) for q, w in zip(asked, want)) >= 0.95 * want.size


def test_every_list_within_the_ratio_is_read():
    """The pool of a graph search is no limit: it grows until a list outside the ratio is in it."""
    from dataclasses import replace

    rng = np.random.default_rng(2)
    centroids = neighbours.unit(rng.normal(size=(600, 24)))
    index = replace(neighbours.Index.of(centroids), ratio=1.2)
    vectors = neighbours.unit(rng.normal(size=(40, 24)))
    far = np.sqrt(np.maximum(0, 2 - 2 * (vectors @ centroids.T).astype(np.float64)))
    want = far <= 1.2 * far.min(axis=1)[:, None]
    at, lists = index.lists_of_queries(vectors)
    seen = np.zeros_like(want)
    seen[at, lists] = True
    assert want.sum(axis=1).max() > neighbours.POOL and (seen & want).sum() >= 0.97 * want.sum() and not (seen & ~want).any()


def test_vectors_that_take_no_part_and_ties(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0]), (None, [0.5, 0.5])]
    rows += [(k, [2.0, 0.0]) for k in range(10, 40)] + [(50, [0.0, 3.0]), (100, None), (0, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 50][:3] == [0, None, 0]
    assert sorted({r.query_id for r in got}) == [0, 50]
    first = [(r.vec_id, r.score) for r in got if r.query_id == 0 and r.score == 1.0]
    assert (10, 1.0) in first and (14, 1.0) in first
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    assert neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect() == got
    assert neighbours.search(df.where("vec_id = 1"), F.lit(True)).count() == 0 == neighbours.search(df.where("false"), F.lit(True)).count()
    assert neighbours.search(df.where("vec_id in (10, 11)"), F.lit(True)).count() == 2


def test_graph_search_finds_the_nearest_centroid():
    rng = np.random.default_rng(0)
    centroids = neighbours.unit(rng.normal(size=(700, 16)))
    index = neighbours.Index.of(centroids)
    vectors = neighbours.unit(rng.normal(size=(300, 16)))
    ids, far = index.search(vectors)
    assert ((vectors @ centroids.T).argmax(1) == ids[:, 0]).mean() > 0.97
    assert (np.diff(far, axis=1) >= 0).all()
    lists = index.lists_of_vectors(vectors)
    assert (lists[:, 0] == ids[:, 0]).mean() > 0.95 and (lists[:, 1:] >= 0).any()


def test_results_of_blocks_merge(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n, top = 4000, 3
    found = []
    for _ in range(4):
        quid, uid = rng.integers(0, 40, n), rng.integers(0, 60, n)
        name = uid // 2  # names repeat, and the score depends on the pair alone
        found.append((quid, quid + 100, uid, name, quid < 0, uid % 7 == 0, ((quid * 31 + name * 17) % 11) / 11))
    got = neighbours._merged(found, top)
    pairs = {(int(q), int(u)): (-float(s), bool(m), int(k), int(u)) for f in found for q, u, k, m, s in zip(f[0], f[2], f[3], f[5], f[6], strict=True)}
    wanted = {q: sorted(v for (p, _), v in pairs.items() if p == q)[:top] for q in range(40)}
    mine = {}
    for q, u, k, m, s in zip(got[0], got[2], got[3], got[5], got[6], strict=True):
        mine.setdefault(int(q), []).append((-float(s), bool(m), int(k), int(u)))
    assert mine == wanted and (got[1] == got[0] + 100).all()
    assert all(len(c) == 0 for c in neighbours._merged([tuple(c[:0] for c in found[0])], top))


def test_lists_meet_their_queries_without_moving_pairs(spark, monkeypatch):
    """A row moved for each query and list that it read; copies had every list read, as different vectors alone measured the ratio."""
    rng = np.random.default_rng(4)
    ids = rng.permutation(6000)
    rows = np.tile(rng.normal(size=(300, 16)), (20, 1)).astype(np.float32)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<float>").repartition(6)
    out = neighbours.search(df, F.col("vec_id") % 50 == 0)
    want = brute(ids, rows)
    assert found(out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Join" not in plan
    for name, value in (("PART_BYTES", 50 * 64), ("HELD", 40), ("BLOCK", 3), ("QUERY_BLOCK", 2)):
        monkeypatch.setattr(neighbours, name, value)
    assert found(neighbours.search(df, F.col("vec_id") % 50 == 0).collect()) == want


def test_ratio_is_measured_by_the_whole_table(spark):
    """The neighbours of a vector are nearer in the table than in the sample, which had more lists read than the recall needs."""
    rng = np.random.default_rng(6)
    units = neighbours.unit(rng.normal(size=(6000, 16)))
    index = neighbours.Index.of(neighbours.balanced_centroids(units, 60)).calibrated(units[:600], 5, 0.9)
    lists = index.lists_of_vectors(units)
    r, c = np.nonzero(lists >= 0)
    postings = spark.createDataFrame([(int(a), int(b), units[b].tobytes()) for a, b in zip(lists[r, c], r)], "list int, uid long, v binary").repartition(5)
    shared = spark.sparkContext.broadcast((index, 16))
    ratio = neighbours.measured(postings, shared, np.dtype(np.float32), 5, 0.9).ratio
    near = np.argsort(-(index.trials @ units.T), axis=1)[:, 1:6]
    far = index.distances(index.trials)
    to = np.where(lists[near] >= 0, far[np.arange(len(near))[:, None, None], lists[near]], np.inf).min(axis=2)
    assert 1 < ratio < index.ratio and abs(ratio - np.quantile(to / far.min(axis=1)[:, None], 0.9)) < 1e-3


# Conversations.
def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, size string, place int")


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "bye")
    rows = [(1, 0, *a), (2, 0, *a), (2, 1, *b), (3, 0, *a), (3, 1, *b), (3, 2, *c), (4, 0, *a), (4, 1, *b), (4, 2, *c), (5, 0, *a), (5, 1, *c)]
    rows += [(6, None, None, None), (7, 5, *c), (7, 5, *c), (None, 0, "user", "<|im_start|>system<|im_end|>")]
    got = {r.conv_id: r for r in chat.format_chats(turns(spark, rows)).collect()}
    assert set(got) == {3, 5, 6, 7, None}
    assert got[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert got[7].n_turns == 2 and got[6].rendered == "<|im_start|>\n<|im_end|>\n"
    assert got[None].rendered == "<|im_start|>user\n< |im_start|>system< |im_end|><|im_end|>\n"
    assert chat.format_chats(turns(spark, [])).count() == 0


def test_long_conversations_are_parts_that_join(spark):
    long = [(1, t, "user", f"turn {t}") for t in range(700)]
    rows = long + [(2, t, "user", f"turn {t}") for t in range(600)] + [(3, t, "user", f"turn {t + 1}") for t in range(300)]
    got = chat.format_chats(turns(spark, rows)).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, r.n_turns, r.total_turns) for r in got] == [(1, 0, 256, 700), (1, 1, 256, 700), (1, 2, 188, 700), (3, 0, 256, 300), (3, 1, 44, 300)]
    assert "".join(r.rendered for r in got if r.conv_id == 1) == "".join(f"<|im_start|>user\nturn {t}<|im_end|>\n" for t in range(700))


def test_crowded_turn_numbers_are_cut(spark, monkeypatch):
    monkeypatch.setattr(chat, "CROWDED", 8)
    monkeypatch.setattr(chat, "CHUNK", 4)
    # null numbers, one number for many turns, and rows that repeat; conversation 2 is 1 without its last turn
    rows = [(None, "user", f"n{i % 30}") for i in range(40)] + [(3, "user" if i % 3 else "bot", f"t{i % 50}") for i in range(60)] + [(t, "user", f"u{t}") for t in range(4, 12)]
    both = [(1, *r) for r in rows] + [(2, *r) for r in rows[:-1]]
    got = chat.format_chats(turns(spark, both)).orderBy("conv_id", "part").collect()
    assert {r.conv_id for r in got} == {1} and [r.part for r in got] == list(range(len(got)))
    assert sum(r.n_turns for r in got) == len(rows) and {r.total_turns for r in got} == {len(rows)}
    assert max(r.n_turns for r in got) < 20 < len(got)
    whole = "".join(r.rendered for r in got)
    order = [whole.index(x) for x in ("n0<", "\nt0<", "u4<", "u11<")]
    assert order == sorted(order)
    assert sorted(whole.split("<|im_end|>\n")[:-1]) == sorted(f"<|im_start|>{role}\n{text}" for _, role, text in rows)


def test_long_turn(spark):
    got = chat.format_chats(turns(spark, [(1, 0, "user", "ab" * 2_000_000), (1, 1, "bot", "")])).collect()
    assert [(r.n_turns, len(r.rendered)) for r in got] == [(2, 4_000_000 + len("<|im_start|>user\n<|im_end|>\n<|im_start|>bot\n<|im_end|>\n"))]


# Archives.
def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", b"y") for r in rows], "page_id long, url string, html string, digest string, payload binary")


def test_archives_hold_their_dictionary_and_each_record_apart(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/../sf0.1/pages.parquet")
    rows = warc.write(df, f"file://{tmp_path}/a", archive_bytes=200_000).collect()
    assert len(rows) > 2
    raw = open(rows[0].archive.removeprefix("file:"), "rb").read()
    assert rows[0].size == len(raw) and raw.endswith(warc.EMPTY_FRAME)
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == warc.DICTIONARY_FRAME and size > 10_000 and raw[8 + size : 12 + size] == warc.FRAME
    got = warc.read(spark, f"file://{tmp_path}/a")
    assert got.count() == df.count()
    html = {r.page_id: (r.html, r.url) for r in df.collect()}
    for r in got.where("record_type = 'response'").collect():
        assert (r.payload.decode(), r.url) == html[r.page_id]


def test_archives_go_through_sparks_file_systems(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.archives.link./out", f"file://{tmp_path}")
    df = spark.read.parquet(f"{SF}/pages.parquet")
    assert warc.write(df, "viewfs://archives/out/a").count() and warc.read(spark, "viewfs://archives/out/a").count() == df.count()


def test_reading_takes_time_in_proportion_to_the_archive():
    import time

    words = warc.train([b"x" * 300])
    press = warc._compressor(words)
    frames = [press.compress(warc.record(k, "http://a", p := random.Random(k).randbytes(1100), warc.digest(p))) for k in range(13_000)]
    content = struct.pack("<II", warc.DICTIONARY_FRAME, len(words)) + words + warc.EMPTY_FRAME.join(frames) + warc.EMPTY_FRAME
    assert len(content) > 15 << 20
    began = time.perf_counter()
    assert [r["fields"]["WARC-Record-ID"] for r in warc.read_archive(content)] == [f"<urn:x-page:{k}>" for k in range(13_000)]
    assert time.perf_counter() - began < 5
    with pytest.raises(ValueError):
        list(warc.read_archive(content[:-500]))


def test_many_repeated_payloads_are_joined_by_shuffle(spark, monkeypatch):
    df = pages(spark, [(k, f"http://a/{k}", ["hot", f"p{k % 40}"][k % 3 > 0]) for k in range(300)])
    want = sorted(warc.round_trip(df).collect())
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(warc, "HOT_PAYLOADS", 2)
    assert sorted(warc.round_trip(df).collect()) == want


def test_pages_with_nothing_or_very_much(spark):
    df = pages(spark, [(1, None, None), (2, None, None), (3, "u", "y" * 3_000_000 + "é")])
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.round_trip(df).collect()}
    assert got == {1: (0, "response"), 2: (0, "revisit"), 3: (3_000_002, "response")}
    assert warc.round_trip(df.where("page_id < 3")).count() == 2


def test_small_tables_and_short_pages_have_a_dictionary(spark, tmp_path):
    few = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    short = pages(spark, [(k, f"http://a/{k}", f"<p>page {k * 7919 % 1000} of {k * 31 % 97}</p>") for k in range(4000)])
    for name, df, least in (("few", few, 8_000), ("short", short, 30_000)):
        archive = warc.write(df, f"{tmp_path}/{name}").first().archive.removeprefix("file:")
        magic, size = struct.unpack_from("<II", open(archive, "rb").read(8))
        assert magic == warc.DICTIONARY_FRAME and size > least, (name, size)
        assert warc.read(spark, f"{tmp_path}/{name}").count() == df.count()
    assert warc.train([]) == b"" and warc.train([b"x" * 100]) == b"x" * 100 and warc.train([b"abc" * 900] * 3) == b"abc" * 2700


def test_revisits_and_odd_pages(spark):
    same = "<p>é</p>"
    rows = [(5, "http://a", same), (3, "http://b", same), (9, None, same), (7, "u", None), (2, "u\nv", ""), (None, "http://n", same), (4, "w", "x" * 70_000), (3, "http://b", same)]
    got = sorted(warc.round_trip(pages(spark, rows)).collect(), key=repr)
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    key = lambda r: (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
    n, d, e = len(same.encode()), digest(same), digest("")
    want = [(5, n, d, "revisit", 3), (3, n, d, "response", None), (3, n, d, "revisit", 3), (9, n, d, "revisit", 3), (7, 0, e, "revisit", 2), (2, 0, e, "response", None), (None, n, d, "revisit", 3), (4, 70_000, digest("x" * 70_000), "response", None)]
    assert sorted(map(key, got), key=repr) == sorted(want, key=repr)
    small = warc.round_trip(pages(spark, rows), minimum=1).where("payload_bytes = 0").collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.round_trip(pages(spark, [])).count() == 0


# Registered queries and the pipeline.
@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, con, name):
    assert differs(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in queries.QUERIES if n != "pipeline"} == {f"op{k}" for k in range(1, 11)}


def test_stages_keep_columns_and_take_effect(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("lang = 'en' and n_chars > 2000").orderBy("doc_id").limit(1)
    docs = docs.unionByName(clean.withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.concat("text", F.lit(' token = "0123456789abcdef0123456789abcdef"'))}))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[3] < sizes[2] == sizes[1] and sizes[4] == sizes[3]
    text = " ".join(r.text for r in docs.collect())
    assert "[SECRET]" in text and 'token = "' not in text
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[4]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, SF).count() > 0
        assert stage(spark, odd_docs.where("false"), SF).count() == 0


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        docs = spark.createDataFrame(rows.collect(), rows.schema)
    cols = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, docs.select(cols).collect()))
