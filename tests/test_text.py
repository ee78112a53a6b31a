import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgrade.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


def test_clean_puts_steps_in_order(spark):
    raw = "  a\x07  b \t c  \r\n\r\n\r\n\r\nd\r..PAGE:3\ne "
    assert one(spark, T.clean(F.col("t")), t=raw) == "a b c\n\nd\ne"
    assert one(spark, T.clean(F.col("t")), t="é") == "\xe9"


def test_first_line_and_body(spark):
    assert one(spark, T.first_line(F.col("t")), t="\n 　\n  Title \nrest") == "Title"
    assert one(spark, T.no_body(F.col("t")), t="a" * 19 + " 　") is True
    assert one(spark, T.no_body(F.col("t")), t=None) is True
    assert one(spark, T.basename(F.col("t")), t="a/b\\c.txt") == "c.txt"


def test_counts(spark):
    assert one(spark, T.count_literal(F.col("t"), "aa"), t="aaaaa") == 2
    assert one(spark, T.count_word(F.col("t"), "nda"), t="nda ndas x-nda") == 2
    assert one(spark, T.count_compact(F.col("t"), "보안 등급"), t="보 안등급 보안 등급") == 2
    assert one(spark, T.count_outside(F.col("t"), "license", ["licensed"]), t="license licensed license") == 2
    assert one(spark, T.first_outside(F.col("t"), "b", ["ab"]), t="ab b") == 3


@given(st.text("ab", max_size=20), st.sampled_from(["a", "ab", "b"]), st.lists(st.text("ab", min_size=1, max_size=4), max_size=3))
def test_irrelevant_excludes_change_nothing(hay, needle, excludes):
    assert T.outside(hay, needle, excludes) == T.outside(hay, needle, T.relevant_excludes(needle, excludes))


def test_outside_without_excludes_is_count():
    r = random.Random(1)
    for _ in range(500):
        hay = "".join(r.choice("ab") for _ in range(r.randint(0, 15)))
        assert T.outside(hay, "ab", [])[0] == hay.count("ab")


def test_outside_by_force():
    r = random.Random(2)
    for _ in range(2000):
        hay = "".join(r.choice("abc") for _ in range(r.randint(0, 20)))
        needle = r.choice(["a", "ab", "bc", "aa"])
        excludes = T.relevant_excludes(needle, ["".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 4))])
        hidden = []
        for e in excludes:
            at = hay.find(e)
            while at >= 0:
                hidden.append((at, at + len(e)))
                at = hay.find(e, at + len(e))
        found, at = [], hay.find(needle)
        while at >= 0:
            if not any(a <= at and at + len(needle) <= b for a, b in hidden):
                found.append(at)
            at = hay.find(needle, at + len(needle))
        assert T.outside(hay, needle, excludes) == (len(found), found[0] if found else -1)
        if excludes and (single := T.subtractable(needle, excludes)):
            assert hay.count(needle) - hay.count(single[0]) == len(found), (hay, needle, excludes)


def test_small_tables_are_dealt_and_large_ones_stay(spark, tmp_path):
    from docgrade.plans.layout import dealt

    spark.range(100).selectExpr("id", "repeat('x', 50) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert dealt(t).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dealt(t, most=10) is t
    assert sorted(dealt(t).collect()) == sorted(t.collect()) and dealt(t.limit(0)).count() == 0


def test_mined_words(spark):
    from docgrade.operators.mining import words

    rows = spark.createDataFrame([("One one, tw o3ne abc1 1abc abc ÉTÉ an-other",), ("",), (None,), ("x" * 100000 + " y",)], "t string")
    assert [r[0] for r in rows.select(words(F.col("t"))).collect()] == [["one", "abc", "été", "other"], [], [], ["x" * 100000]]


def test_only_texts_that_may_not_be_composed_go_to_python(spark):
    import unicodedata

    second = {int(p[1], 16) for c in range(0x110000) if len(p := unicodedata.decomposition(chr(c)).split()) == 2 and not p[0].startswith("<")}
    second |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for a, b in T.COMPOSED:
        assert all(not unicodedata.combining(chr(c)) and unicodedata.normalize("NFC", chr(c)) == chr(c) and c not in second for c in range(a, b + 1))
    plain = ["abc", "déjà – vu", "한글 text", "漢字かな", "", None]
    loose = ["é", "한", "ａ́", "KK", "が", "x\U0001d15e", "Ά", " "]
    rows = spark.createDataFrame([(t,) for t in plain + loose], "t string").select("t", F.col("t").rlike(T._BEYOND).alias("sent"), T.nfc(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [t and unicodedata.normalize("NFC", t) for t in plain + loose]
    assert not any(r.sent for r in rows[: len(plain)]) and all(r.sent for r in rows[len(plain) :])


def test_words_of_fields_are_found_once_and_as_before(spark):
    from docgrade.operators import mining as M

    text = "Budget 2024plan aaa PDF budget été a b2 x9x 예산을 예산 에서 나나 report.docx plan"
    want = {(): ["budget", "été", "b2", "x9x", "예산을", "예산", "에서", "report", "plan"], None: ["budget", "été", "b2", "x9x", "예산", "에서", "report", "plan"]}
    for particles, words in want.items():
        extra = {} if particles is None else {"particles": particles}
        assert one(spark, M.tokens(F.col("t"), **extra), t=text) == words
    assert one(spark, M.tokens(F.col("t")), t="plain Text aaa 12 txt text") == ["plain", "text"]
    f = M.fields(F.lit("plan"), F.lit("plan budget"), F.lit("budget head"), F.col("t"))
    assert one(spark, f, t="body head plan") == (["plan"], ["budget"], ["head"], ["body"], ["body", "head", "plan"])
    # what nobody asks of a field's words is not worked out: without suffixes all of the body's are loose
    df = spark.createDataFrame([("x",)], "t string").select(M.fields(F.lit(""), F.lit(""), F.lit(""), F.col("t")).alias("f"))
    assert "(?!)" not in df._jdf.queryExecution().optimizedPlan().toString()
