import gzip
import io
import tarfile
import zipfile

from docgrade.sources import archives as A


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in entries.items():
            z.writestr(n, b)
    return out.getvalue()


def tarred(entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n, b in entries.items():
            info = tarfile.TarInfo(n)
            info.size = len(b)
            t.addfile(info, io.BytesIO(b))
    return out.getvalue()


def test_nested_and_noise():
    inner = zipped({"b.txt": b"B", "__MACOSX/x": b"", ".DS_Store": b""})
    outer = zipped({"a.txt": b"A", "in.zip": inner})
    assert [(n, d) for n, d, _ in A.expand(outer, "o.zip")] == [("o.zip/a.txt", b"A"), ("o.zip/in.zip/b.txt", b"B")]
    assert [n for n, _, _ in A.expand(outer, "o.zip", depth=1)] == ["o.zip/a.txt", "o.zip/in.zip"]


def test_tar_gz():
    data = gzip.compress(tarred({"x/y.txt": b"Y"}))
    assert [(n, d) for n, d, _ in A.expand(data, "o.tgz")] == [("o.tgz/x/y.txt", b"Y")]


def test_limits_and_errors():
    z = zipped({"a": b"x" * 100, "b": b"y" * 100})
    assert [p for _, _, p in A.expand(z, "o.zip", budget=A.Budget(150, 10))] == ["limit"]
    assert [p for _, _, p in A.expand(b"abc", "o.7z.001")] == ["split_volume"]
    assert [p for _, _, p in A.expand(b"Rar!....", "o.rar")] == ["error: NotImplementedError"]
    assert [p.split(":")[0] for _, _, p in A.expand(b"\x1f\x8bbroken", "o.gz")] == ["error"]


def test_office_is_no_archive():
    assert A.kind_of(zipped({"word/document.xml": b""})) is None


def test_as_rows(spark, tmp_path):
    (tmp_path / "o.zip").write_bytes(zipped({"a.txt": b"A", "b.txt": b"B"}))
    (tmp_path / "c.txt").write_bytes(b"C")
    got = A.expanded(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert {(r.path, bytes(r.content), r.origin is not None) for r in got} == {("o.zip/a.txt", b"A", True), ("o.zip/b.txt", b"B", True), ("c.txt", b"C", False)}
