from pyspark.sql import functions as F

from docgrade.operators import vocabulary as V


def test_layers_and_variants():
    s = V.layered({"plan": ["scheme"], "report": ["note"]}, {"plan": ["outline", "scheme"]})
    assert list(s) == ["report", "plan"] and s["plan"] == ["scheme", "outline"]
    assert V.variants("audit plan", s) == ["audit plan", "auditplan", "audit scheme", "audit outline"]
    assert "audit_plan" in V.variants("audit plan", s, filename=True)
    assert V.doubled("planplan") and not V.doubled("plan")


def test_judge():
    assert V.judge("plan", ["audit plan", "work plan"]) == "common"
    assert V.judge("plan", [], broad=("plan",)) == "broad"
    assert V.judge("x", []) == "short"
    assert V.judge("plan", [], endings=("report",)) == "ending"
    assert V.judge("plan", ["audit plan"]) == "ok"


def test_suffixes(spark):
    names = spark.createDataFrame([(n,) for n in ("plan", "workplan", "auditplan", "note", "footnote")], "name string")
    assert [tuple(r) for r in V.suffixes(names, "name").collect()] == [("plan", 2)]


def test_by_name(spark):
    docs = spark.createDataFrame([(1, "a/Audit Plan_v2 final.docx"), (2, "b/other.txt"), (3, "workplan (3).pdf")], "id int, file string")
    got = V.by_name(docs, "id", "file", {"plan": "N1", "auditplan": "N2"}, 0.35).collect()
    assert {(r.id, r.dc_id) for r in got} == {(1, "N2"), (3, "N1")}
    assert docs.select(V.stem(F.col("file")).alias("s")).first().s == "auditplan"
