"""Archives: members as rows, nested ones too, within a budget of bytes and members."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

SPLIT = re.compile(r"(?i)\.(?:7z|zip)\.\d{3}$|\.z\d{2}$|\.part\d+\.rar$|\.r\d{2}$")
NOISE = re.compile(r"(?:^|/)(?:__MACOSX/|\.DS_Store$)")
SINGLE = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}
OFFICE = ("word/", "xl/", "ppt/", "Contents/")


class Limit(Exception):
    pass


@dataclass
class Budget:
    """Shared by everything inside one outermost archive."""

    bytes: int = 1 << 30
    members: int = 10_000

    def take(self, n: int) -> None:
        self.bytes -= n
        self.members -= 1
        if self.bytes < 0 or self.members < 0:
            raise Limit


def kind_of(content: bytes) -> str | None:
    """The archive's kind by content; office documents are no archives."""
    if content.startswith(b"PK\x03\x04"):
        try:
            names = zipfile.ZipFile(io.BytesIO(content)).namelist()
        except zipfile.BadZipFile:
            return None
        return None if any(n.startswith(OFFICE) for n in names) else "zip"
    for start, kind in ((b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"Rar!", "rar")):
        if content.startswith(start):
            return kind
    return "tar" if content[257:262] == b"ustar" else None


def entry_name(info: zipfile.ZipInfo) -> str:
    """Names without the UTF-8 flag were read as cp437 and are cp949 more often."""
    if info.flag_bits & 0x800:
        return info.filename
    try:
        return info.filename.encode("cp437").decode("cp949")
    except UnicodeError:
        return info.filename


def _read(stream, budget: Budget) -> bytes:
    data = stream.read(max(0, budget.bytes) + 1)
    budget.take(len(data))
    return data


def members(content: bytes, kind: str, name: str, budget: Budget):
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir() and not NOISE.search(info.filename):
                    with z.open(info) as f:
                        yield entry_name(info), _read(f, budget)
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for info in t:
                if info.isfile() and not NOISE.search(info.name):
                    yield info.name, _read(t.extractfile(info), budget)
    elif kind in SINGLE:
        with SINGLE[kind](io.BytesIO(content)) as f:
            yield re.sub(r"(?i)\.(?:gz|bz2|xz)$|(?<=\.t)(?:gz|bz2|xz)$", lambda m: "ar" if m[0][0] != "." else "", name.rpartition("/")[2]), _read(f, budget)
    else:
        raise NotImplementedError(f"no reader for {kind}")


def expand(content: bytes, name: str, depth: int = 3, budget: Budget | None = None):
    """(label, content, problem): label is outer/inner. What cannot be opened stays one row, with why."""
    budget = Budget() if budget is None else budget
    if SPLIT.search(name):
        yield name, content, "split_volume"
        return
    kind = kind_of(content)
    if not kind or not depth:
        yield name, content, None
        return
    try:
        inside = list(members(content, kind, name, budget))
    except Limit:
        yield name, content, "limit"
        return
    except Exception as e:  # noqa: BLE001 - a broken archive is a value
        yield name, content, f"error: {type(e).__name__}"
        return
    for inner, data in inside:
        yield from expand(data, f"{name}/{inner}" if kind not in SINGLE or kind_of(data) != "tar" else name, depth - 1, budget)


def expanded(files: DataFrame, depth: int = 3) -> DataFrame:
    """path, origin, content, problem: one row a member of a ``binaryFile`` table's archives."""

    def run(batches):
        for batch in batches:
            paths, contents = batch.column(0).to_pylist(), batch.column(1)
            for i, path in enumerate(paths):
                content = contents[i].as_py()
                name = path.rpartition("/")[2]
                for label, data, problem in expand(content, name, depth):
                    origin = path if label != name else None
                    yield pa.RecordBatch.from_pydict({"path": [label], "origin": [origin], "content": [data], "problem": [problem]}, schema=SCHEMA)

    return files.select("path", "content").mapInArrow(run, "path string, origin string, content binary, problem string")


SCHEMA = pa.schema([("path", pa.string()), ("origin", pa.string()), ("content", pa.binary()), ("problem", pa.string())])
