import io
import zipfile

from docgrade.operators import review as R
from docgrade.operators import vectors as V
from docgrade.sources import extract as E


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def test_html():
    assert E.html_to_text("<head>x</head><p>a  b</p>c<br>d<script>e</script>&amp;") == "a b\nc\nd&"
    assert E.html_to_text(None) == ""


def test_sniff_and_parse():
    docx = zipped(word__document_xml="<d><p><r><t>one</t><tab/><t>two</t></r></p></d>")
    assert E.extract_one(docx) == ("docx", "one\ttwo", None)
    xlsx = zipped(xl__sharedStrings_xml="<s><si><t>a</t></si></s>", xl__worksheets__sheet1_xml='<s><row><c t="s"><v>0</v></c><c><v>2.0</v></c></row></s>')
    assert E.extract_one(xlsx) == ("xlsx", "a\t2", None)
    assert E.sniff(b"%PDF-1") == "pdf" and E.sniff(b"a\0b") == "binary" and E.sniff(b"<HTML>") == "html"
    assert E.extract_one(b"%PDF-1")[2] == "no parser for pdf"
    assert E.extract_one("한글".encode("cp949"))[1] == "한글"


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"%PDF-")
    got = E.extract(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("path").collect()
    assert [(r.format, r.text, r.error) for r in got] == [("text", "hello", None), ("pdf", None, "no parser for pdf")]


def test_greedy(spark):
    rows = [(1, [1.0, 0.0], 2), (2, [0.999, 0.01], 1), (3, [0.0, 1.0], 3), (4, None, 4), (5, [0.0, -1.0], 5), (6, [0.999, 0.02], 0), (9, [0.5, 0.5], 9)]
    c = spark.createDataFrame(rows, "id long, v array<double>, place int")
    seeds = spark.createDataFrame([(9, [0.0, -2.0])], "id long, v array<double>")
    got = {r.id: r.verdict for r in V.greedy_distinct(c, seeds, "id", "v", "place", 0.985).collect()}
    assert got == {6: "added", 2: "near_added", 1: "near_added", 3: "added", 4: "no_vector", 5: "near_seed", 9: "existing"}


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 0.0]), (8, [2.0, 0.1]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r.query, r.seed, r["rank"]) for r in V.neighbours(df, df, "id", "v", 1, other_only=True).collect())
    assert got == [(1, 8, 1), (7, 1, 1), (8, 1, 1)]
    assert [(r.a, r.b) for r in V.near_duplicates(df, "id", "v", 0.9).collect()] == [(1, 8)]
    assert V.neighbours(df.limit(0), df, "id", "v", 3).count() == 0 and V.near_duplicates(df.limit(0), "id", "v", 0.5).count() == 0


def test_allocate():
    out = R.allocate({"a": 100, "b": 4, "c": 1}, 20, 1)
    assert sum(out.values()) == 20 and out["c"] == 1 and out["b"] <= 4


def test_cells_stand_apart():
    row = "<table><tr><th>900101-1234568</th><th>010-1234-5678</th></tr><tr><td>a</td><td>b</td></tr></table>"
    assert E.html_to_text(row).split("\n") == ["900101-1234568", "010-1234-5678", "a", "b"]
    assert E.html_to_text("<p>x<script>y</script>z</p><noscript>n</noscript>&amp;<pre>k</pre>") == "xz\n&k"


def test_number_formats(spark):
    assert [E.builtin_kind(n) for n in (14, 21, 22, 0)] == ["day", "time", "both", None]
    assert [E.code_kind(c) for c in ("yyyy-mm-dd", "[h]:mm:ss", 'yyyy"h" m/d h:mm', "0.00", "mmm", '"day" 0', "[Red]0.0", "mm:ss")] == ["day", "time", "both", None, "day", None, None, "time"]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(60.5,), (1.999999,), (0.0,), (45000.25,)], "s double")
    got = [tuple(r) for r in rows.select(E.excel_text(F.col("s"), "day"), E.excel_text(F.col("s"), "time"), E.excel_text(F.col("s"), "both")).collect()]
    assert got[0] == ("1900-02-29", "12:00:00", "1900-02-29 12:00:00") and got[1][2] == "1900-01-02 00:00:00" and got[3][2] == "2023-03-15 06:00:00"


def test_workbook_days_and_comments():
    styles = (
        '<s><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.00"/></numFmts>'
        '<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="21"/><xf/></cellXfs></s>'
    )
    cells = '<c s="1"><v>45000</v></c><c s="2"><v>45000.25</v></c><c s="3"><v>45000.5</v></c><c s="4"><v>0.5</v></c><c s="1" t="str"><v>45000</v></c><c s="9"><v>7.0</v></c><c s="1"><v>-1</v></c><c t="s"><v>4</v></c>'
    note = "<c><authors><author>Kim</author></authors><commentList><comment><text><r><t> se</t></r><r><t>cond </t></r></text></comment><comment/></commentList></c>"
    book = zipped(
        xl__styles_xml=styles,
        xl__worksheets__sheet1_xml=f"<s><sheetData><row>{cells}</row><row/></sheetData></s>",
        xl__worksheets__sheet2_xml="<s",
        xl__comments2_xml=note,
        xl__comments1_xml=note.replace("cond", "cret"),
        xl__threadedComments__threadedComment3_xml="<t><threadedComment><text>third</text></threadedComment></t>",
    )
    assert E.xlsx(book).split("\n") == ["2023-03-15\t2023-03-15 06:00:00\t45000.5\t12:00:00\t45000\t7\t-1\t", "", "secret", "second", "third"]


def test_serials_as_cells_and_as_columns(spark):
    from pyspark.sql import functions as F

    values = [0.0, 1.0, 59.0, 60.0, 61.5, 59.999999, 60.999999, 45000.25, 2958465.0, 2958465.999999, 2958466.0, -1.0]
    rows = spark.createDataFrame([(v,) for v in values], "s double")
    for kind in ("day", "time", "both"):
        assert [r[0] for r in rows.select(E.excel_text(F.col("s"), kind)).collect()] == [E.serial_text(str(v), kind) for v in values]
    assert E.serial_text("x", "day") is None and E.serial_text("nan", "day") is None and E.serial_text("", "time") is None
