import time
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fabula.sources import files
from fabula.streaming import runs


def docx(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t xml:space='preserve'>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")


def test_script_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\r\n  two \xff\nthree")
    (tmp_path / "b.md").write_text("四\n")
    (tmp_path / "c.doc").write_text("no")
    (tmp_path / "e.txt").write_text(" \n")
    docx(tmp_path / "d.docx", ["第一集", "a &amp; b</w:t><w:br/><w:t>soft", " "])
    lines = files.read_script_lines(spark, str(tmp_path))
    got = {}
    for r in lines.orderBy("path", "pos").collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append(r["line"])
    assert got == {"a.txt": ["one", "two �", "three"], "b.md": ["四"], "d.docx": ["第一集", "a & b", "soft"]}
    summary = {r["status"]: r["files"] for r in files.ingest_summary(files.listing(spark, str(tmp_path)), lines).collect()}
    assert summary == {"ingested": 3, "empty": 1, "skipped": 1}


def test_parser_order(spark):
    schema = "path string, pos bigint, line string"
    a, b = spark.createDataFrame([("x", 0, "a")], schema), spark.createDataFrame([("x", 0, "b"), ("y", 0, "b")], schema)
    assert {(r["path"], r["line"]) for r in files.first_parse(a, b).collect()} == {("x", "a"), ("y", "b")}


def test_label_log_resumes(spark, tmp_path):
    schema = "target_id string, run int, value string, dim string"
    files.append_labels(spark.createDataFrame([("t1", 0, "a", "d"), ("t2", 0, "b", "d")], schema), f"{tmp_path}/log")
    files.append_labels(spark.createDataFrame([("t1", 1, "a", "e")], schema), f"{tmp_path}/log")
    got = files.read_labels(spark, f"{tmp_path}/log")
    assert got.count() == 3 and got.filter("dim = 'd'").count() == 2


def test_reports_and_missing_dims(spark, tmp_path):
    (tmp_path / "r1.json").write_text('{"dim": "x", "verdict": "online"}')
    dims = spark.createDataFrame([("x",), ("y",)], "dim string")
    reports, missing = files.read_reports(spark, str(tmp_path), dims)
    assert reports.first()["verdict"] == "online" and [r["dim"] for r in missing.collect()] == ["y"]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    files.write_versioned(rows, f"{tmp_path}/t", ["p"])
    files.write_versioned(spark.createDataFrame([(9, "b")], "v int, p string"), f"{tmp_path}/t", ["p"])
    assert {(r["v"], r["p"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "a"), (9, "b")}


def test_parents_count_their_children(spark, tmp_path):
    files.insert_with_children(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, c string"), str(tmp_path), "k")
    assert {(r["k"], r["n_children"]) for r in spark.read.parquet(f"{tmp_path}/parents").collect()} == {(1, 2), (2, 0)}


FRAMES = "run_id bigint, seq bigint, frame string, ts timestamp"


def test_replay_and_liveness(spark):
    rows = [(1, s, "f", None) for s in range(5)] + [(2, 0, "f", None), (2, 1, "done", None)]
    f = spark.createDataFrame(rows, FRAMES).withColumn("ts", F.timestamp_seconds(F.lit(1000) + F.col("seq")))
    after = runs.replay(f, spark.createDataFrame([(1, 2)], "run_id bigint, seen bigint"))
    assert [r["seq"] for r in after.collect()] == [3, 4]
    assert [r["seq"] for r in runs.ring(f, 2).filter("run_id = 1").orderBy("seq").collect()] == [3, 4]
    assert [r["run_id"] for r in runs.alive(f, "1970-01-01 00:20:00", 600).collect()] == [1]
    assert runs.alive(f, "1970-01-01 01:00:00", 600).count() == 0


def test_windows_are_alike_in_streams(spark, tmp_path):
    rows = [(i, i * 700, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, s int, value double").select(F.timestamp_seconds("s").alias("ts"), "value")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = runs.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(tuple(r) for r in runs.windowed_counts(df).collect())
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM windows").collect()) == want


@pytest.fixture
def small_state(spark):
    """One state store, kept where stateful processors need it."""
    told = {"spark.sql.shuffle.partitions": "1", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k) for k in told}
    for k, v in told.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ring_and_progress_as_streams(spark, small_state, tmp_path):
    """Frames in two files, some again: each is passed once, a run that is done starts anew, progress is what the batch form says."""
    first = [(1, s, "f") for s in range(6)] + [(2, 0, "f"), (2, 1, "done")]
    second = [(1, s, "f") for s in range(4, 9)] + [(2, 2, "f")]
    schema = "run_id bigint, seq bigint, frame string"

    def run() -> None:
        stream = runs.ring_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), size=4)
        q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start(f"{tmp_path}/out")
        for _ in range(100):  # timers keep such a stream going, so it never says that all is done
            time.sleep(0.5)
            if any(p["numInputRows"] for p in q.recentProgress):
                break
        q.stop()

    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    got = sorted((r["run_id"], r["seq"], r["held"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted([(1, s, min(s + 1, 4)) for s in range(9)] + [(2, 0, 1), (2, 1, 2), (2, 2, 1)])

    states = spark.createDataFrame([(r, "ab"[s % 2], float(s), s) for r, s, _ in first + second], "run_id bigint, stage string, state double, s int")
    states = states.select("run_id", "stage", "state", F.timestamp_seconds("s").alias("ts"))
    states.repartition(2).write.parquet(f"{tmp_path}/states")
    stream = runs.latest_progress(spark.readStream.schema(states.schema).parquet(f"{tmp_path}/states"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM progress").collect()) == sorted(tuple(r) for r in runs.latest_progress(states).collect())


def test_sessions(spark):
    df = spark.createDataFrame([(1, 0), (1, 100), (1, 5000), (2, 0)], "u int, s int").select("u", F.timestamp_seconds("s").alias("ts"))
    assert sorted((r["u"], r["n"]) for r in runs.sessions(df, "10 minutes", "u").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_folders_are_ingested_in_order_up_to_a_limit(spark):
    listed = spark.createDataFrame([(f"/d/{p}", "skipped" if p.endswith("csv") else "supported") for p in ("a.txt", "b.csv", "c.txt", "完整本_d.md", "d.md", "e.txt", "f.txt")], "path string, status string")
    scenes = spark.createDataFrame([("/d/a.txt", 5), ("/d/c.txt", 2), ("/d/d.md", 3), ("/d/f.txt", 9), ("/d/完整本_d.md", 30)], "path string, scenes int")
    told = lambda limit: {r["path"][3:]: r["status"] for r in files.ingested(listed, scenes, limit).collect()}
    every = {"a.txt": "ingested", "b.csv": "skipped", "c.txt": "short", "d.md": "ingested", "e.txt": "empty", "f.txt": "ingested", "完整本_d.md": "guarded"}
    assert told(None) == told(9) == every
    assert told(2) == {k: v for k, v in every.items() if k <= "d.md"}
    assert told(1) == {"a.txt": "ingested"}


def test_every_query_has_sql_or_is_known_to_have_none():
    without = {
        "st11_boundary_similarity", "ret9_mmr", "ret14_citation_support", "ret21_line_search", "str8_name_similarity", "str26_recursive_chunks", "str28_semantic_chunks", "str30_budget_merge",
        "cmp4_entities_with_roles", "cmp3_units_with_scenes", "cmp13_str33_layout_match", "cmp16_routed_chunks", "win11_repair_intervals", "top7_budget_prefix", "agg30_str32_line_changes", "stm8_byte_quota",
        "str32_line_diff", "cmp13_growing_windows", "cmp13a_short_blocks", "str11_str12_segmented_lines", "str30_partitioned_merge", "ret22_index_recall",
        "ret22_vector_index", "str32_word_diff", "cmp16_lateral_chunks",
    }
    from fabula.plans import QUERIES, SQL

    assert set(QUERIES) - set(SQL) == without


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["script_id", "episode"]
