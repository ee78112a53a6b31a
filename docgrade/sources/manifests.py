"""Manifests of documents: reading, keys of paths, lookup, identity, missing files; override and seed logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_key
from ..operators import review as R

MANIFEST = "path string, sfile_id string, hash string"


class ManifestError(ValueError):
    pass


def braces(pattern: str) -> list[str]:
    """``a{b,c}`` as ``ab`` and ``ac``, nested ones too, in order."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    out = [x for part in m[1].split(",") for x in braces(pattern[: m.start()] + part + pattern[m.end() :])]
    return list(dict.fromkeys(out))


def globs(spec: str) -> list[str]:
    """Patterns between commas that stand outside braces."""
    parts, depth = [""], 0
    for c in spec:
        depth += (c == "{") - (c == "}")
        if c == "," and depth <= 0:
            parts.append("")
        else:
            parts[-1] += c
    return list(dict.fromkeys(x for p in parts if p.strip() for x in braces(p.strip())))


key = path_key


def read(spark: SparkSession, path: str, form: str) -> DataFrame:
    """JSONL, CSV or TSV; lines whose first sign is # and a blank, another # or nothing are comments."""
    if form == "jsonl":
        lines = spark.read.text(path).filter(~F.col("value").rlike(r"^#(?:[#\s]|$)") & (F.trim("value") != ""))
        return lines.select(F.from_json("value", MANIFEST).alias("m")).select("m.*")
    return spark.read.option("header", True).option("sep", "\t" if form == "tsv" else ",").option("comment", "#").schema(MANIFEST).csv(path)


def checked(manifest: DataFrame) -> DataFrame:
    """Rows with an id and a path, by key; a path with two ids is an error."""
    rows = manifest.filter("sfile_id <> '' AND path <> ''").withColumn("key", key(F.col("path")))
    twice = rows.groupBy("key").agg(F.countDistinct("sfile_id").alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ManifestError("paths with more than one id: " + ", ".join(r.key for r in twice))
    return rows.dropDuplicates(["key"])


def identified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files(path, hash) with doc_id and doc_id_source: the manifest's id, else the content, else the path.

    An exact key wins; one that differs only in case counts if just one manifest row has it.
    """
    m = manifest.select("key", "sfile_id")
    folded = m.groupBy(F.lower("key").alias("fold")).agg(F.count("*").alias("n"), F.first("sfile_id").alias("fold_id")).filter("n = 1").drop("n")
    out = files.withColumn("key", key(F.col("path"))).withColumn("fold", F.lower("key")).join(m, "key", "left").join(folded, "fold", "left")
    doc_id = F.coalesce("sfile_id", "fold_id")
    source = F.when(F.col("sfile_id").isNotNull(), "key").when(F.col("fold_id").isNotNull(), "case").when(F.col("hash").isNotNull(), "content").otherwise("path")
    return out.select("path", "hash", doc_id.alias("doc_id"), source.alias("doc_id_source"))


def missing(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows without a file become records that say so."""
    there = files.select(key(F.col("path")).alias("key"))
    from .files import error

    gone = manifest.join(there, "key", "left_anti")
    return gone.select("path", F.col("sfile_id").alias("doc_id"), error("file_missing", F.lit("not there"), F.col("path")).alias("error"))


def overrides(spark: SparkSession, path: str, axis: str | None = None) -> DataFrame:
    """The last line for each file of an append-only log, of one axis if asked; broken lines are skipped."""
    schema = "file string, doc_id string, hash string, axis string, new_grade string, confirmed array<string>, rejected array<string>, reviewer string, ts string"
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    rows = lines.select("line", F.from_json("value", schema).alias("o")).select("line", "o.*").filter("file IS NOT NULL")
    if axis:
        rows = rows.filter(F.coalesce("axis", F.lit("security")) == axis)
    return R.latest(rows, "file", "line", "doc_id", "hash", "axis", "new_grade", "reviewer", "ts")
