import random
import re
import pytest
from pyspark.sql import functions as F

from docgrade.functions import pii as P
from docgrade.operators import spans as S

# Made-up sentences; every number is generated to pass its checksum and belongs to nobody.
GOLDEN = [
    ("주민 900101-1234568 확인", {"RRN": 1}),
    ("없는 날짜 901301-1234568", {}),
    ("외국인 900101-5234567", {"FRN": 1}),
    ("카드 4539-1488-0343-6467", {"CARD": 1}),
    ("카드 4539-1488-0343-6468", {}),
    ("사업자 123-45-67891", {"BUSINESS_REG": 1}),
    ("사업자 000-00-00000", {}),
    ("전화 010-1234-5678, 02-123-4567", {"PHONE": 2}),
    ("국제 +82 10 1234 5678", {"PHONE": 1}),
    ("대표 1588-1234", {"PHONE": 1}),
    ("메일 a.b@c.co.kr", {"EMAIL": 1}),
    ("메일 a..b@c.kr", {}),
    ("http://a.b/c?d.", {"URL": 1}),
    ("주소 8.8.8.8", {"IP": 1}),
    ("주소 127.0.0.1 이나 8.8.8.300", {}),
    ("version 1.2.3.4", {}),
    ("fe80::1 x", {"IPV6": 1}),
    ("여권 M12345678", {"PASSPORT": 1}),
    ("여권 M00000000", {}),
    ("면허 11-22-333333-44", {"DRIVER_LICENSE": 1}),
    ("면허 99-22-333333-44", {}),
    ("운전면허 112233333344", {"DRIVER_LICENSE": 1}),
    ("건강보험증 12345678901", {"MEDICAL_INSURANCE": 1}),
    ("처방번호 AB-1234", {"PRESCRIPTION_ID": 1}),
    ("약품코드 123456789", {"EDI_DRUG": 1}),
    ("12가3456 주차", {"VEHICLE": 1}),
    ("12가0000 주차", {}),
    ("2020가합1234 사건", {"COURT_CASE": 1}),
    ("2020가합000 사건", {}),
    ("계좌 110-123-456789", {"ACCOUNT": 1}),
    ("필지 1111010100100010000", {"PNU": 1}),
]


def test_golden(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    found = F.filter(P.counts(F.col("t"), list(P.DETECTORS)), lambda x: x["count"] > 0)
    got = {r.i: {x["label"]: x["count"] for x in r.c} for r in rows.select("i", found.alias("c")).collect()}
    wrong = [(t, want, got[i]) for i, (t, want) in enumerate(GOLDEN) if got[i] != want]
    assert not wrong


def span(a, b, risk=1, conf=1.0, label="X"):
    return (label, a, b, risk, conf)


@pytest.mark.parametrize(
    "spans, kept",
    [
        ([], []),
        ([span(0, 5), span(5, 9)], [(0, 5), (5, 9)]),
        ([span(0, 5, 1), span(4, 9, 2)], [(4, 9)]),
        ([span(0, 5, 1, 0.5), span(4, 9, 1, 0.9)], [(4, 9)]),
        ([span(0, 9), span(3, 5), span(9, 10)], [(0, 9), (9, 10)]),
        ([span(0, 5), span(2, 7), span(6, 11)], [(0, 5), (6, 11)]),
    ],
)
def test_resolution(spark, spans, kept):
    rows = spark.createDataFrame([(spans,)], f"s {S.SPAN}")
    assert [(x["start"], x["end"]) for x in rows.select(S.resolve(F.col("s")).alias("r")).first().r] == kept


def spans_of(spark, label, text):
    rows = spark.createDataFrame([(text,)], "t string")
    return [(x["start"], x["end"]) for x in rows.select(P.DETECTORS[label].spans(F.col("t")).alias("s")).first().s]


def test_spans_are_where_the_pattern_matched(spark):
    assert spans_of(spark, "EMAIL", "x a@b.kr a@b.kr") == [(2, 8), (9, 15)]
    # the same value in and out of context
    assert spans_of(spark, "IP", "version 8.8.8.8 then 8.8.8.8") == [(21, 28)]
    assert spans_of(spark, "IP", "8.8.8.8, 8.8.8.8 build 8.8.8.8 9.9.9.9") == [(0, 7), (31, 38)]
    assert spans_of(spark, "CARD", "4539148803436467 4539148803436468 4539148803436467") == [(0, 16), (34, 50)]
    assert spans_of(spark, "IP", "") == [] and spans_of(spark, "IP", "none") == []


def test_spans_and_resolution_by_force(spark):
    r = random.Random(3)
    bits = ["8.8.8.8", "version ", "4539148803436467", "a@b.kr", "010-1234-5678", "900101-1234568", " ", ", ", "x", "build", "1", "110-123-456789", "계좌 ", "http://a.b/010-1234-5678"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    every = P.detect(F.col("t"))
    for row in df.select("t", every.alias("every"), S.resolve(every).alias("kept")).collect():
        # by force: greedy over all, and every span is a match of its own detector's pattern at that very place
        order = sorted(row.every, key=lambda s: (-s.risk, -s.conf, s.start - s.end, s.start))
        kept = []
        for s in order:
            if not any(k.start < s.end and s.start < k.end for k in kept):
                kept.append(s)
        assert [tuple(s) for s in row.kept] == [tuple(s) for s in sorted(kept, key=lambda s: s.start)]
        for s in row.every:
            shape = P.DETECTORS[s.label].shapes[0]
            if s.label in ("IP", "EMAIL", "CARD", "PHONE"):
                assert any(m.span() == (s.start, s.end) for m in re.finditer(shape.pattern, row.t)), (row.t, s)


MORE = [
    ("전화 070-1234-5678", "PHONE", 1), ("전화 034-123-4567", "PHONE", 0), ("0082-10-1234-5678", "PHONE", 1), ("+82-(0)2-123-4567", "PHONE", 1),
    ("바코드 8801019876545", "RRN", 0), ("0900101-1234568", "RRN", 1), ("00900101-1234568", "RRN", 0), ("7408212331565", "RRN", 1),
    ("12가3456 원", "VEHICLE", 0), ("12외3456", "VEHICLE", 1), ("2020헌가12", "COURT_CASE", 1), ("국민은행 110123456789", "ACCOUNT", 1), ("110-123-456789 신한", "ACCOUNT", 1), ("110-123-456789", "ACCOUNT", 0),
    ("미국인은 왔다", "NATIONALITY", 1), ("프랑스에서 왔다", "NATIONALITY", 1), ("사람은 왔다", "NATIONALITY", 0), ("1:2:3", "IPV6", 0), ("2001:db8::8:800:200c:417a", "IPV6", 1), ("1:2:3:4:5:6:7:8", "IPV6", 1), ("1::2::3", "IPV6", 0),
    ("그림 1.2.3.4", "IP", 0), ("1.2.3.4 버전", "IP", 0), ("접속 1.2.3.4 에서", "IP", 1), ("9789587081780", "CORP_REG", 0),
]


def test_more(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(MORE)], "i int, t string")
    got = {r.i: {x["label"]: x["count"] for x in r.c} for r in rows.select("i", P.counts(F.col("t"), list(P.DETECTORS)).alias("c")).collect()}
    assert [(t, k, n, got[i][k]) for i, (t, k, n) in enumerate(MORE) if got[i][k] != n] == []


def test_merged(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (2, 0, 1)], "k int, start int, end int")
    assert dict(S.merged_count(rows, "k").collect()) == {1: 2, 2: 1}


def test_folded(spark):
    rows = [("O1O-1234-5678", "010-1234-5678"), ("０１０－１２３４－５６７８", "010-1234-5678"), ("010\u200b-1234-5678", "010-1234-5678"), ("Oslo B2 in 2024", "Oslo B2 in 2024"), ("45391488O343646l", "4539148803436461"), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(P.folded(F.col("t"))).collect()] == [w for _, w in rows]
    n = df.select("i", F.filter(P.counts_through(F.col("t"), ["PHONE", "EMAIL"]), lambda x: x["count"] > 0).alias("c"))
    assert sorted(r.i for r in n.collect() if r.c) == [0, 1, 2]


ADDRESSES = [
    ("서울특별시 강남구 테헤란로 152 에서", ["서울특별시 강남구 테헤란로 152"]),
    ("없는특별시 강남구 테헤란로 152", []),
    ("서울특별시 해운대구 테헤란로 152", []),
    ("테헤란로 152", []),
    ("주소: 테헤란로 152", ["테헤란로 152"]),
    ("강남구 테헤란로 152-3 103동 1202호 (역삼동, 가나) 끝", ["강남구 테헤란로 152-3 103동 1202호 (역삼동, 가나)"]),
    ("강남구 테헤란로 152 한빛타워 12층", ["강남구 테헤란로 152 한빛타워 12층"]),
    ("강남구 테헤란로 152-3-4", []),
    ("강원특별자치도 아무시 어떤동 12", ["강원특별자치도 아무시 어떤동 12"]),
    ("아무구 어떤동 12", []),
    ("강남구 역삼동 12", ["강남구 역삼동 12"]),
    ("저는 강남구 살아요", ["강남구"]),
    ("저는 강남구에 살아요", ["강남구"]),
    ("강남구 회의", []),
    ("서울특별시에 거주", ["서울특별시"]),
    # nearer than thirty characters to what was found
    ("거주: 강남구 역삼동 12, 송파구", ["강남구 역삼동 12"]),
    ("", []),
]


def test_addresses(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ADDRESSES)] + [(99, None)], "i int, t string")
    d = P.DETECTORS["ADDRESS"]
    got = {r.i: r for r in rows.select("i", "t", d.matches(F.col("t")).alias("m"), d.spans(F.col("t")).alias("s")).collect()}
    assert [(t, want, got[i].m) for i, (t, want) in enumerate(ADDRESSES) if got[i].m != want] == []
    assert all(r.t[s.start : s.end] in ADDRESSES[i][1] for i, r in got.items() for s in r.s or [])
    assert [(s.risk, s.conf) for i in (0, 10, 14) for s in got[i].s] == [(3, 0.8), (3, 0.75), (2, 0.7)]
    more = P.address({**P.PROVINCE_DISTRICTS, "강원특별자치도": "춘천시"})
    far = rows.filter("i in (8)").select(more.matches(F.col("t")).alias("m")).first().m
    assert far == []
