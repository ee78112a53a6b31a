"""Folder in, records out; sinks, rules as files, the state file."""

import json

import pytest
from pyspark.sql import functions as F

from docgrade import run, sinks
from docgrade.plans import rules
from docgrade.sources import files as S


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    (d / "a.txt").write_text("write to a@b.org and c@d.org and e@f.org, all rights reserved", encoding="utf-8")
    (d / "license.txt").write_bytes(b"%PDF-1.4 nothing")
    (d / "short.md").write_text("tiny")
    (d.parent / "b.html").write_text("<p>the token and the password of the house</p>")
    return tmp_path


def test_grade_and_forms(spark, folder):
    out = str(folder / "out.jsonl")
    done = run.grade(spark, str(folder / "in"), out, simple=True, texts=str(folder / "texts"))
    assert (done["files"], done["failed"], done["exit"]) == (4, 2, sinks.SOME_FAILED)
    simple = {r.file.rsplit("/", 1)[1]: r for r in spark.read.json(out).collect()}
    assert simple["a.txt"].grade == "C" and simple["b.html"].grade == "C" and simple["license.txt"].error == "extract_failed"
    full = {r.file.rsplit("/", 1)[1]: r for r in spark.read.json(out + ".full").collect()}
    assert full["license.txt"].grade == "O" and full["license.txt"].why.security.method == "extract_failed"
    assert full["short.md"].error.kind == "no_body" and full["a.txt"].error is None
    assert spark.read.parquet(str(folder / "texts" / "texts")).count() == 2
    assert "rule: R1×3" in spark.read.json(out + ".full").filter("file LIKE '%a.txt'").select(sinks.why()).first()[0]


def test_manifest_list_and_command(spark, folder, capsys):
    base = folder / "in"
    (folder / "m.jsonl").write_text("\n".join(["# files", json.dumps({"path": f"{base}/deep/a.txt", "sfile_id": "X1"}), json.dumps({"path": f"{base}/gone.txt", "sfile_id": "X2"})]))
    docs, lost = run.documents(spark, str(base), manifest=str(folder / "m.jsonl"))
    assert {r.doc_id for r in docs.collect()} == {"X1", None} and [r.doc_id for r in lost.collect()] == ["X2"]
    kinds = {r.error.kind for r in run.records(docs, lost).filter("error IS NOT NULL").collect()}
    assert kinds == {"extract_failed", "no_body", "file_missing"}
    (folder / "list.txt").write_text(f'﻿# list\n"{base}/b.html"\n{base}/b.html\n{base}/nowhere\n', encoding="utf-8")
    docs, lost = run.documents(spark, str(base), names=str(folder / "list.txt"))
    assert (docs.count(), lost.count()) == (1, 1)
    assert run.main(["text", "--dir", str(base), "--out", str(folder / "t.json"), "--pattern", "*.{html,md}"], spark) == 0
    assert len(json.load(open(folder / "t.json"))) == 2
    assert run.main(["grade", "--glob", "x"], spark) == sinks.BAD_INPUT
    (folder / "bad.json").write_text('{"keywords": [{"id": "K"}]}')
    assert run.main(["check-rules", "--policy", str(folder / "bad.json")]) == sinks.BAD_RULES
    assert '"ok": false' in capsys.readouterr().out


def test_intake(spark):
    assert S.route(b"long enough to be taken at once")[1:] == ("text", "long enough to be taken at once", None)
    assert S.route(b"short", [("other", lambda b: "a longer text from the fallback")])[1] == "other"
    assert S.route(b"short", [("worse", lambda b: "x"), ("broken", lambda b: 1 / 0)])[1] == "text"
    kind, engine, text, error = S.route(b"%PDF-", [("broken", lambda b: 1 / 0)])
    assert (kind, text) == ("pdf", None) and "no parser for pdf" in error and "ZeroDivisionError" in error
    rows = spark.createDataFrame([("a.txt", 11), ("b.bin", 11), ("c.txt", 5)], "path string, length long")
    fit, over = S.gated(rows, 20, 10)
    assert {r.path for r in fit.collect()} == {"b.bin", "c.txt"} and over.first().error.code == S.ERRORS["too_large"][0]
    x = spark.createDataFrame([(10, 5, 99), (10, 5, 100), (10, 4, 0), (0, 0, 0)], "p int, s int, n int")
    assert [r[0] for r in x.select(S.scan_excluded(F.col("p"), F.col("s"), F.col("n"))).collect()] == [True, False, False, False]
    m = spark.createDataFrame([("a", "1", "h"), ("A/../a", "2", None), ("b", "1", None), ("", "3", None), ("c", "", None), ("d", "9", None)], "path string, sfile_id string, hash string")
    f = spark.createDataFrame([("a", "other"), ("b", "x")], "path string, hash string")
    c = S.manifest_counts(m, f).first()
    assert (c.no_path, c.no_id, c.missing, c.hash_differs, c.ids_of_many_paths, c.paths_of_many_ids) == (1, 1, 1, 1, 1, 1)


def test_sinks(spark, tmp_path):
    assert [sinks.form_of(p) for p in ("a.json", "a.csv", "a.jsonl", "a")] == ["json", "csv", "jsonl", "jsonl"]
    with pytest.raises(sinks.SinkError):
        sinks.form_of("a", "xml")
    rows = spark.createDataFrame([("h", "one"), ("h", "two")], "hash string, text string")
    with pytest.raises(sinks.SinkError):
        sinks.save_texts(rows, str(tmp_path / "t"))
    nested = spark.createDataFrame([(1, "x", [(2, "secret")])], "id int, text string, a array<struct<n:int,values:string>>")
    assert [f.name for f in sinks.loggable(nested).schema] == ["id", "a"] and sinks.loggable(nested).first().a[0].asDict() == {"n": 2}
    at = str(tmp_path / "state")
    for n in (3, 5):
        with sinks.lock(spark, at):
            sinks.replace(spark.range(n), at)
            with pytest.raises(sinks.SinkError), sinks.lock(spark, at):
                pass
    assert spark.read.parquet(at).count() == 5
    assert sinks.status("too_large", "p")["code"] == S.ERRORS["too_large"][0] and sinks.status()["ok"]


def test_rules_as_files(spark):
    nodes = [("A", None, 1, "Legal"), ("A1", "A", 1, "Open License"), ("B", None, 2, "Notice")]
    built = rules.build(nodes, {"license": ["licence"]}, {"tree": "x\r\n"}, by_hand={"B": {"title": ["note"], "head": [], "body": [], "name": []}})
    assert set(built["rules"]) == {"A1", "B"} and "open licence" in built["rules"]["A1"]["title"] and "open_license" in built["rules"]["A1"]["name"]
    assert rules.staleness(built, {"tree": "﻿x\n"}) == []
    assert rules.staleness(built, {"tree": "y", "more": ""}) == ["changed: tree", "new: more"]
    built["rules"]["A1"]["title"].append("z")
    assert rules.staleness(built, {"tree": "x\n"}) == ["edited"]
    assert [rules.bumped(v) for v in ("1.9", "v2", "x")] == ["1.10", "v3", "x.1"]
    policy = {"version": "1.0", "keywords": [{"id": "a", "terms": ["x"]}, {"id": "b", "terms": ["y"]}]}
    new = rules.edited(policy, "keywords", [{"id": "a", "terms": ["z"]}, {"id": "c", "terms": ["w"]}])
    assert new["version"] == "1.1" and [r["id"] for r in new["keywords"]] == ["a", "c"]
    assert rules.edited(policy, "keywords", policy["keywords"]) is policy
    d = rules.digest
    assert rules.compared({"a": "1", "b": "2", "c": "3", "d": "4"}, {"a": "1\r\n".strip(), "b": "old", "c": "mine", "e": "5"}, {"b": d("old"), "c": d("3")}) == {"a": "same", "b": "stale", "c": "edited", "d": "missing", "e": "extra"}


def test_preview(spark):
    got = run.preview(spark, run.DEMO, "a token, a password", "x/license.txt")
    assert got["security"]["grade"] == "C" and got["hits_name"][0]["id"] == "K1"
