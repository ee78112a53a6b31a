"""Where records go: JSON lines and arrays, simple and full forms, texts by content, reports, one state file."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .sources.files import ERRORS

#: Exit codes of a run.
OK, SOME_FAILED, BAD_INPUT, BAD_RULES, BROKEN = range(5)


class SinkError(ValueError):
    pass


def status(kind: str | None = None, path: str | None = None, message: str | None = None, exit_code: int = OK) -> dict:
    """How a run or a document ended, as one object."""
    code = ERRORS[kind][0] if kind else 0
    return {k: v for k, v in {"ok": kind is None, "kind": kind, "code": code, "exit": exit_code, "path": path, "message": message}.items() if v is not None}


def form_of(path: str, form: str | None = None) -> str:
    """json, jsonl or csv: as asked for, else by the name's end; jsonl if neither says."""
    if form:
        if form not in ("json", "jsonl", "csv"):
            raise SinkError(f"no form {form!r}")
        return form
    end = os.path.splitext(path)[1].lower().lstrip(".")
    return {"json": "json", "csv": "csv"}.get(end, "jsonl")


def scrubbed(df: DataFrame) -> DataFrame:
    """Strings on top as valid UTF-8: lone surrogates become replacement signs, so every record can be written."""
    return df.select(*[F.make_valid_utf8(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema.fields])


ORDER = ("doc_id", "file", "grade", "doctype", "why", "error", "notes", "meta")


def ordered(records: DataFrame) -> DataFrame:
    """Columns in the order in which people read a record; others behind, as they come."""
    first = [c for c in ORDER if c in records.columns]
    return records.select(*first, *[c for c in records.columns if c not in first])


def why() -> Column:
    """One line: the signals that decided, with their rules and counts."""
    parts = [
        F.when(F.array_contains("why.security.decided_by", n), F.concat(F.lit(f"{n}: "), F.array_join(F.transform(f"why.security.signals.{n}.hits", lambda h: F.concat(h["id"], F.lit("×"), h["count"].cast("string"))), ", ")))
        for n in ("rule", "sensitive", "stamp", "name")
    ]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "; ")


def simple(records: DataFrame, key: str = "doc_id", with_why: bool = False) -> DataFrame:
    """The few columns most readers want."""
    keep = [c for c in ("file",) if c in records.columns]
    out = [F.col(key), *keep, F.col("grade"), F.col("why.security.confidence").alias("confidence"), F.array_join("why.security.decided_by", ",").alias("decided_by")]
    if "error" in records.columns:
        out.append(F.col("error.kind").alias("error"))
    if with_why:
        out.append(why().alias("why"))
    return records.select(*out)


#: Parts of a record that never reach a log.
PRIVATE = ("text", "vector", "embedding", "values", "pii")


def loggable(df: DataFrame) -> DataFrame:
    """Without texts, vectors and personal values, at any depth."""

    def bare(c: Column, t: DataType) -> Column:
        if isinstance(t, StructType):
            return F.struct(*[bare(c[f.name], f.dataType).alias(f.name) for f in t.fields if f.name not in PRIVATE])
        if isinstance(t, ArrayType) and isinstance(t.elementType, StructType):
            return F.transform(c, lambda x: bare(x, t.elementType))
        return c

    return df.select(*[bare(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in PRIVATE])


def write(records: DataFrame, path: str, form: str | None = None, mode: str = "errorifexists") -> None:
    """JSON lines or CSV as a folder, in parallel; one JSON array as a file, row by row through the driver, for lists people read."""
    form = form_of(path, form)
    rows = scrubbed(records)
    if form == "jsonl":
        rows.write.mode(mode).json(path, ignoreNullFields=False)
    elif form == "csv":
        flat = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (StructType, ArrayType)) else F.col(f.name) for f in rows.schema.fields]
        rows.select(*flat).write.mode(mode).option("header", True).csv(path)
    else:
        if mode == "errorifexists" and os.path.exists(path):
            raise SinkError(f"{path} is there already")
        with open(path, "w", encoding="utf-8") as f:
            f.write("[")
            for i, (line,) in enumerate(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()):
                f.write((",\n" if i else "\n") + line)
            f.write("\n]\n")


def write_both(records: DataFrame, path: str, form: str | None = None, mode: str = "errorifexists") -> None:
    """Simple records at ``path`` and whole ones at ``path``.full; records should be a written table, they are read twice."""
    write(simple(records), path, form, mode)
    write(records, f"{path}.full", form_of(path, form), mode)


def save_texts(docs: DataFrame, path: str) -> DataFrame:
    """Texts by content: (hash, text) once each, in folders by the hash's beginning. Gives the index of documents.

    Two texts under one hash are an error; the check moves hashes and digests, not texts.
    """
    marks = docs.select("hash", F.xxhash64("text").alias("x")).groupBy("hash").agg(F.min("x").alias("a"), F.max("x").alias("b")).filter("a <> b").limit(5).collect()
    if marks:
        raise SinkError("different texts under one hash: " + ", ".join(r.hash for r in marks))
    once = docs.groupBy("hash").agg(F.first("text").alias("text")).withColumn("shard", F.left("hash", F.lit(2)))
    once.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/texts")
    index = docs.select("hash", *[c for c in ("file", "doc_id") if c in docs.columns], F.length("text").alias("chars"))
    index.write.mode("overwrite").json(f"{path}/index")
    return index


def without_id(records: DataFrame) -> DataFrame:
    """The report of records whose id does not come from a manifest."""
    return records.filter(~F.coalesce("doc_id_source", F.lit("")).isin("key", "case")).select(*[c for c in ("file", "path", "hash", "doc_id_source") if c in records.columns])


def export(frame: DataFrame) -> DataFrame:
    """A flat table of filtered documents with the grade and labels in effect."""
    labels = F.array_join(F.transform(F.filter("labels", lambda x: x["status"] != "rejected"), lambda x: x["dc_id"]), ",")
    return frame.select("doc_id", *[c for c in ("file",) if c in frame.columns], F.col("effective").alias("grade"), labels.alias("labels"), *[c for c in ("changed", "confidence") if c in frame.columns])


def run_meta(seconds: float, files: int, propagated: int, policy: str) -> dict:
    return {"seconds": round(seconds, 3), "files": files, "propagated": propagated, "policy": policy}


# ---------------------------------------------------------------- one state file


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def lock(spark: SparkSession, path: str) -> Iterator[None]:
    """One writer at a time: the lock is a file that only one can create."""
    at, fs = _fs(spark, f"{path}.lock")
    try:
        fs.create(at, False).close()
    except Exception as e:
        raise SinkError(f"{path} is being written") from e
    try:
        yield
    finally:
        fs.delete(at, False)


def replace(df: DataFrame, path: str) -> None:
    """The table at ``path`` exchanged as a whole: written beside it, then renamed; readers see the old or the new one."""
    spark = df.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    new, fs = _fs(spark, fresh)
    now, _ = _fs(spark, path)
    old, _ = _fs(spark, f"{fresh}.old")
    had = fs.exists(now)
    if had and not fs.rename(now, old):
        raise SinkError(f"{path} cannot be moved")
    if not fs.rename(new, now):
        if had:
            fs.rename(old, now)
        raise SinkError(f"{path} cannot be replaced")
    if had:
        fs.delete(old, True)


def as_json(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)
