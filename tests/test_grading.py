import pytest
from pyspark.sql import functions as F

from docgrade.operators import grading as G
from docgrade.operators import taxonomy as X
from docgrade.plans import policy as P


def graded(spark, text, policy=P.DEMO, file=None, **more):
    rows = spark.createDataFrame([(1, text, file)], "id int, text string, file string")
    return G.graded(rows, policy, "file", **more).first()


def test_nothing_is_unclassified_or_failsafe(spark):
    r = graded(spark, "plain words").security
    assert (r.grade, r.method, r.decided_by) == (None, "unclassified", [])
    assert graded(spark, None, failsafe="C").security.method == "failsafe_default"


def test_bulk_and_combo(spark):
    assert graded(spark, "a@b.kr").security.grade == "S"
    assert graded(spark, "a@b.kr c@d.kr e@f.kr").security.grade == "C"
    r = graded(spark, "a@b.kr 8.8.8.8")
    assert r.security.grade == "C" and [h.id for h in r.hits_rule] == ["R1", "R2", "M1", "M2"]


def test_cap_lowers_and_says_so(spark):
    capped = P.Policy(P.DEMO.regex, (), P.DEMO.combos, (), (), 5, "S")
    h = graded(spark, "4539148803436467", capped).hits_rule[0]
    assert (h.grade, h.capped_from) == ("S", "C")


def test_name_alone_and_excludes(spark):
    r = graded(spark, None, file="dir/LICENSE.txt")
    assert r.security.grade == "O" and r.security.decided_by == ["name"] and not r.security.seed_eligible
    assert graded(spark, "the token ring").security.grade is None


def test_all_violations_at_once():
    bad = {"keywords": [{"id": "K"}, {"id": "K", "terms": ["a"], "base_grade": "X", "what": 1}], "paths": []}
    with pytest.raises(P.PolicyError) as e:
        P.load(bad)
    assert len(e.value.violations) == 6
    assert P.load({"keywords": [{"id": "K", "terms": ["A"], "base_grade": "C"}]}).keywords[0].terms == ("a",)


def test_taxonomy(spark):
    assert X.validate([("a", "b", 1, ""), ("b", "a", 1, ""), ("c", "x", 1, "")]) == ["c: no parent x", "a: in a cycle", "b: in a cycle"]
    c = X.closure(X.nodes(spark))
    assert {tuple(r) for r in c.filter("dc_id = 'A11'").select("ancestor", "distance").collect()} == {("A11", 0), ("A1", 1), ("A", 2)}
    cands = spark.createDataFrame([(1, "A1", 0.5), (1, "A11", 0.6), (1, "B1", 0.6)], "doc int, dc_id string, confidence double")
    assert {r.dc_id for r in X.absorb(cands, c, "doc").collect()} == {"A11", "B1"}
    assert [(r.dc_id, r.truncated) for r in X.top_n(cands, "doc", 1).collect()] == [("A11", 2)]
    assert X.cross_branch(cands, c, "doc").first().roots == ["A", "B"]


def test_noisy_or(spark):
    assert spark.range(1).select(X.noisy_or(F.array(F.lit(0.5), F.lit(0.4))).alias("x")).first().x == pytest.approx(0.7)
