"""From folders and lists to documents: which files, how large, what came out of them, what went wrong.

Every outcome is a row. A file that cannot be read, is too large, has too little text or is missing
becomes a record with an ``error`` struct; nothing vanishes and nothing ends the batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import extract as E
from . import manifests as M

MAX_TEXT_BYTES = MAX_BYTES = 100 << 20
SCAN_SHARE, SCAN_CHARS = 0.5, 10
TEXTUAL = ("txt", "md", "csv", "tsv", "log", "json", "xml", "html", "htm")

#: Codes of a run's end and of documents' errors: kind -> (code, whether the run goes on).
ERRORS = {
    "file_missing": (21, True),
    "too_large": (22, True),
    "no_body": (23, True),
    "extract_failed": (24, True),
    "bad_rules": (31, False),
    "bad_manifest": (32, False),
    "bad_option": (33, False),
    "no_input": (34, False),
}


def error(kind: str | Column, message: Column | str, path: Column) -> Column:
    """struct(kind, code, message, path)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    code = F.lit(None).cast("int")
    for name, (number, _) in ERRORS.items():
        code = F.when(kind == name, number).otherwise(code)
    return F.struct(kind.alias("kind"), code.alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"), path.alias("path"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, line of a list of files: byte order mark, quotes and comment lines go; of one key the first line stays."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "raw"))
    bare = F.regexp_replace(F.trim(F.regexp_replace("raw", "^﻿", "")), "^(['\"])(.*)\\1$", "$2")
    rows = lines.select("line", bare.alias("path")).filter("path <> ''").filter(~F.col("path").startswith("#"))
    first = rows.withColumn("key", M.key(F.col("path"))).groupBy("key").agg(F.min(F.struct("line", "path")).alias("f"))
    return first.select("f.path", "f.line", "key")


def collect(spark: SparkSession, folder: str, patterns: str | None = None) -> DataFrame:
    """path, length, modificationTime, content of a folder's files at every depth, by globs of the file's name."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if patterns:
        reader = reader.option("pathGlobFilter", "{" + ",".join(M.globs(patterns)) + "}")
    return reader.load(folder)


def only_listed(files: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files that a list names, and the list's names without a file."""
    keyed = files.withColumn("key", M.key(F.regexp_replace("path", "^file:/*", "/")))
    return keyed.join(names.select("key"), "key", "left_semi").drop("key"), names.join(keyed.select("key"), "key", "left_anti")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(T.basename(path), r"\.([A-Za-z0-9]+)$", 1))


def gated(files: DataFrame, max_bytes: int = MAX_BYTES, max_text_bytes: int = MAX_TEXT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files within their limit, and error rows of the others; decided by the listed length, before any content is read."""
    limit = F.when(extension(F.col("path")).isin(*TEXTUAL), max_text_bytes).otherwise(max_bytes)
    over = files.filter(F.col("length") > limit)
    message = F.concat(F.col("length").cast("string"), F.lit(" bytes"))
    return files.filter(F.col("length") <= limit), over.select("path", error("too_large", message, F.col("path")).alias("error"))


ROUTED = "struct<format:string,engine:string,text:string,error:string>"


def route(content: bytes, fallbacks=()) -> tuple[str, str | None, str | None, str | None]:
    """(format, engine, text, error): the format's parser, then the fallbacks; the first text of twenty signs or more wins, else the longest.

    A fallback is (name, function of the bytes). Without any text all reasons are given.
    """
    kind = E.sniff(content)
    engines = ([(kind, E.PARSERS[kind])] if kind in E.PARSERS else []) + list(fallbacks)
    best, reasons = None, [] if kind in E.PARSERS else [f"no parser for {kind}"]
    for name, parse in engines:
        try:
            text = parse(content) or ""
        except Exception as e:  # noqa: BLE001 - any parser error is the document's own
            reasons.append(f"{name}: {type(e).__name__}: {e}"[:200])
            continue
        n = len("".join(text.split()))
        if n >= T.MIN_BODY:
            return kind, name, text, None
        if best is None or n > best[0]:
            best = n, name, text
    if best is None:
        return kind, None, None, "; ".join(reasons) or "empty"
    return kind, best[1], best[2], None


def routed(files: DataFrame, fallbacks=()) -> DataFrame:
    """path, hash, format, engine, text, error (struct or null) of a binaryFile table."""

    @F.pandas_udf(ROUTED)
    def parse(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([route(bytes(c), fallbacks) for c in content], columns=["format", "engine", "text", "error"])

    got = files.withColumn("x", parse("content"))
    failed = error("extract_failed", F.col("x.error"), F.col("path"))
    return got.select("path", F.sha2("content", 256).alias("hash"), "x.format", "x.engine", "x.text", F.when(F.col("x.error").isNotNull(), failed).alias("error"))


def prepared(docs: DataFrame, limit: int = T.MAX_CHARS) -> DataFrame:
    """Cleaned and cut texts with what is to be said of them: n_chars, truncated, no_body as an error."""
    clean = docs.withColumn("text", T.clean(F.coalesce("text", F.lit(""))))
    cut = clean.withColumn("t", T.truncated(F.col("text"), limit))
    short = F.col("error").isNull() & T.no_body(F.col("t.text"))
    err = F.when(short, error("no_body", F.lit("less than twenty signs"), F.col("path"))).otherwise(F.col("error"))
    rest = [c for c in docs.columns if c not in ("text", "error")]
    return cut.select(*rest, F.col("t.text").alias("text"), "t.n_chars", "t.truncated", err.alias("error"))


def scan_excluded(pages: Column, scanned: Column, n_chars: Column) -> Column:
    """Whether a document is a scan: half of its pages or more are images and there are hardly any signs to a page."""
    return F.coalesce((pages > 0) & (scanned / pages >= SCAN_SHARE) & (n_chars / pages < SCAN_CHARS), F.lit(False))


def marked(docs: DataFrame, scanned_chars: int = 1_000_000) -> DataFrame:
    """``notes``: what was not looked at in full: partial extraction, an archive left closed, text beyond the detectors' reach."""
    have = set(docs.columns)
    note = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    notes = [F.when(F.col("n_chars") > scanned_chars, note("pii_scan_capped", F.lit(scanned_chars)))]
    if "partial" in have:
        notes.append(F.when(F.col("partial").isNotNull(), note("partial_extract", F.col("partial"))))
    if "unexpanded" in have:
        notes.append(F.when(F.col("unexpanded").isNotNull(), note("archive_unexpanded", F.col("unexpanded"))))
    return docs.withColumn("notes", F.filter(F.array(*notes), lambda n: n.isNotNull()))


def manifest_counts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counters: rows without path or id, files missing, ids of many paths, paths of many ids, hashes that differ."""
    rows = manifest.withColumn("key", M.key(F.col("path")))
    fine = rows.filter("path <> '' AND sfile_id <> ''")
    have = files.select(M.key(F.col("path")).alias("key"), F.col("hash").alias("file_hash")).dropDuplicates(["key"])
    j = fine.dropDuplicates(["key"]).join(have.withColumn("there", F.lit(True)), "key", "left")
    counters = j.agg(F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("hash") != F.col("file_hash")).alias("hash_differs"))
    shapes = rows.agg(F.count_if(F.coalesce(F.col("path"), F.lit("")) == "").alias("no_path"), F.count_if((F.col("path") != "") & (F.coalesce(F.col("sfile_id"), F.lit("")) == "")).alias("no_id"))
    many_paths = fine.groupBy("sfile_id").agg(F.countDistinct("key").alias("n")).agg(F.count_if(F.col("n") > 1).alias("ids_of_many_paths"))
    many_ids = conflicts(manifest).agg(F.count("*").alias("paths_of_many_ids"))
    # four rows of one, each an aggregate
    return shapes.crossJoin(counters).crossJoin(many_paths).crossJoin(many_ids)


def conflicts(manifest: DataFrame) -> DataFrame:
    """key, ids: paths with more than one id."""
    rows = manifest.filter("path <> '' AND sfile_id <> ''").groupBy(M.key(F.col("path")).alias("key")).agg(F.countDistinct("sfile_id").alias("ids"))
    return rows.filter("ids > 1")
