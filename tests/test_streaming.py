import pytest
from pyspark.sql import functions as F

from docgrade.plans.policy import DEMO
from docgrade.sources import manifests as M
from docgrade.streaming import grade as S


def test_stream_grades_like_batch(spark, tmp_path):
    rows = [(1, "a@b.kr", "en", "s", 6), (2, "plain", "en", "s", 5)]
    spark.createDataFrame(rows, S.DOCUMENT).write.parquet(str(tmp_path / "in"))
    q = S.append_records(S.graded_stream(spark, str(tmp_path / "in"), DEMO), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.doc_id: r.grade for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "S", 2: None}


def test_stream_counts_and_windows(spark, tmp_path):
    rows = [(1, "a@b.kr", "en", "s", 6), (2, "plain", "en", "s", 5), (3, "x@y.org", "en", "t", 7)]
    spark.createDataFrame(rows, S.DOCUMENT).write.parquet(str(tmp_path / "in"))
    counts = S.grade_counts(S.graded_stream(spark, str(tmp_path / "in"), DEMO))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("grades").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.source, r.grade): r.docs for r in spark.table("grades").collect()} == {("s", "S"): 1, ("s", "none"): 1, ("t", "S"): 1}
    schema = "ts timestamp, event_type string, value double"
    at = lambda n, day, *some: spark.createDataFrame([(t, "a", v) for t, v in some], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"events/{n}"))
    at(1, 1, ("2024-01-01 00:05:00", 1.0), ("2024-01-01 00:50:00", 2.0))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events/*"))
    start = lambda: S.event_windows(events).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "windows")).trigger(availableNow=True).start().awaitTermination(120)
    start()
    at(2, 1, ("2024-01-01 03:00:00", 5.0))
    start()
    at(3, 1, ("2024-01-01 00:10:00", 100.0), ("2024-01-01 06:00:00", 1.0))  # the first comes too late
    start()
    got = {r.start.hour: (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "windows")).collect()}
    assert got[0] == (2, 3.0) and 100.0 not in {t for _, t in got.values()}


def test_globs():
    assert M.globs("a{b,c{d,e}}, x") == ["ab", "acd", "ace", "x"]
    assert M.globs("*.{txt,md},x") == ["*.txt", "*.md", "x"]


def test_keys(spark):
    paths = ["c:\\a\\..\\b\\.\\x.txt", "//srv/s/a", "/a/../../b", "a/../../b"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    assert [r.k for r in rows.orderBy("i").select(M.key(F.col("p")).alias("k")).collect()] == ["C:/b/x.txt", "//srv/s/a", "/b", "../b"]


def test_identity(spark):
    m = M.checked(spark.createDataFrame([("a/X", "1", None), ("b", "2", None), ("gone", "3", None), ("n", "", None)], M.MANIFEST))
    files = spark.createDataFrame([("a/x", "h"), ("./b", "h"), ("c", "h"), ("d", None)], "path string, hash string")
    got = {r.path: (r.doc_id, r.doc_id_source) for r in M.identified(files, m).collect()}
    assert got == {"a/x": ("1", "case"), "./b": ("2", "key"), "c": (None, "content"), "d": (None, "path")}
    assert [r.doc_id for r in M.missing(m, files).orderBy("path").collect()] == ["1", "3"]
    with pytest.raises(M.ManifestError):
        M.checked(spark.createDataFrame([("a", "1", None), ("./a", "2", None)], M.MANIFEST))


def test_logs(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"file":"a","new_grade":"C"}\nbroken\n{"file":"a","new_grade":"S"}\n')
    (tmp_path / "m.jsonl").write_text('# comment\n{"path":"a","sfile_id":"1"}\n')
    assert [(r.file, r.new_grade) for r in M.overrides(spark, str(tmp_path / "o.jsonl")).collect()] == [("a", "S")]
    assert M.read(spark, str(tmp_path / "m.jsonl"), "jsonl").count() == 1
