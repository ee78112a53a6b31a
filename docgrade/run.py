"""A folder in, records out: the batch as a function and as a command.

    python -m docgrade.run grade --dir IN --out OUT [--policy P.json] [--manifest M] [--simple] [--texts DIR]
    python -m docgrade.run text --dir IN --out OUT
    python -m docgrade.run check-rules --policy P.json
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions import text as T
from .operators import grading as G
from .plans.policy import DEMO, Policy, PolicyError, load, violations
from .sources import files as S
from .sources import manifests as M

#: Options of earlier versions and what to use now.
REMOVED = {"--glob": "--pattern", "--recursive": "folders are always read at every depth", "--daemon": "workers stay up between tasks"}


class Failed(Exception):
    def __init__(self, kind: str, message: str, exit_code: int, path: str | None = None):
        super().__init__(message)
        self.status = sinks.status(kind, path, message, exit_code)


def documents(spark: SparkSession, folder: str, pattern: str | None = None, names: str | None = None, manifest: str | None = None, form: str = "jsonl", fallbacks=()) -> tuple[DataFrame, DataFrame]:
    """(path, hash, format, engine, text, n_chars, truncated, doc_id, doc_id_source, error, notes) of every file, and missing ones."""
    files = S.collect(spark, folder, pattern)
    lost = None
    if names:
        files, without = S.only_listed(files, S.listed(spark, names))
        lost = without.select("path", F.lit(None).cast("string").alias("doc_id"), S.error("file_missing", "not there", F.col("path")).alias("error"))
    fit, over = S.gated(files)
    docs = S.routed(fit, fallbacks).unionByName(over, allowMissingColumns=True)
    docs = S.marked(S.prepared(docs))
    if manifest:
        m = M.checked(M.read(spark, manifest, form))
        bare = F.regexp_replace("path", "^file:/*", "/")
        ids = M.identified(docs.select(bare.alias("path"), "hash"), m).select("path", "doc_id", "doc_id_source").dropDuplicates(["path"])
        docs = docs.withColumn("path", bare).join(ids, "path", "left")
        gone = M.missing(m, docs)
        lost = gone if lost is None else lost.unionByName(gone)
    else:
        docs = docs.withColumns({"doc_id": F.lit(None).cast("string"), "doc_id_source": F.when(F.col("hash").isNotNull(), "content").otherwise("path")})
    return docs, docs.select("path", "doc_id", "error").limit(0) if lost is None else lost


def records(docs: DataFrame, lost: DataFrame, policy: Policy = DEMO, failsafe: str | None = None) -> DataFrame:
    """A record for every document; one whose text failed is graded by its name, never a seed, method extract_failed."""
    failed = F.col("error").isNotNull() & (F.col("error.kind") != "no_body")
    every = docs.unionByName(lost, allowMissingColumns=True).withColumn("text", F.when(failed, "").otherwise(F.coalesce("text", F.lit(""))))
    graded = G.graded(every, policy, file="path", failsafe=failsafe)
    s = F.col("security")
    graded = graded.withColumn("security", s.withField("method", F.when(failed, "extract_failed").otherwise(s["method"])).withField("seed_eligible", s["seed_eligible"] & F.col("error").isNull()))
    out = G.record(graded, ["doc_id", "doc_id_source", "path", "hash", "error", "notes", "n_chars"], F.current_timestamp().cast("string"))
    return sinks.ordered(out.withColumnRenamed("path", "file"))


def grade(spark: SparkSession, folder: str, out: str, policy: Policy = DEMO, form: str | None = None, simple: bool = False, texts: str | None = None, mode: str = "errorifexists", **source) -> dict:
    """The whole batch. The records are written once, in full; other forms are made from what was written."""
    began = time.perf_counter()
    docs, lost = documents(spark, folder, **source)
    seen = Observation("records")
    rows = records(docs, lost, policy).observe(seen, F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("grade").isNotNull()).alias("graded"))
    full = f"{out}.full" if simple else out
    sinks.write(rows, full, form if simple else sinks.form_of(out, form), mode)
    if simple:
        sinks.write(sinks.simple(spark.read.schema(rows.schema).json(full) if sinks.form_of(full, form) == "jsonl" else rows), out, form, mode)
    if texts:
        sinks.save_texts(docs.filter("hash IS NOT NULL AND error IS NULL").select("hash", F.col("path").alias("file"), "doc_id", "text"), texts)
    counts = seen.get
    if not counts["files"]:
        raise Failed("no_input", "no files", sinks.BAD_INPUT, folder)
    end = sinks.SOME_FAILED if counts["failed"] else sinks.OK
    return sinks.status(exit_code=end) | counts | {"seconds": round(time.perf_counter() - began, 3)}


def text_only(spark: SparkSession, folder: str, out: str, form: str | None = None, mode: str = "errorifexists", **source) -> dict:
    """Extracted and cleaned texts, no grades."""
    docs, _ = documents(spark, folder, **source)
    sinks.write(docs.select(F.col("path").alias("file"), "hash", "format", "text", "n_chars", "truncated", "error"), out, form, mode)
    return sinks.status()


def check_rules(data: dict) -> dict:
    """Everything wrong with a policy, without reading a document."""
    found = violations(data)
    return {"ok": not found, "violations": found, "exit": sinks.BAD_RULES if found else sinks.OK}


def preview(spark: SparkSession, policy: Policy, text: str, file: str | None = None) -> dict:
    """What a policy makes of one pasted text."""
    row = spark.createDataFrame([(T.unicodedata.normalize("NFC", text), file)], "text string, path string")
    return G.graded(row, policy, file="path").select("security", "hits_rule", "hits_sensitive", "hits_stamp", "hits_name").first().asDict(recursive=True)


def guarded(args: list[str]) -> list[str]:
    for a in args:
        if (name := a.partition("=")[0]) in REMOVED:
            raise Failed("bad_option", f"{name} is gone: {REMOVED[name]}", sinks.BAD_INPUT)
    return args


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints one status object; the exit code says how it ended."""
    try:
        p = argparse.ArgumentParser(prog="docgrade", exit_on_error=False)
        p.add_argument("command", choices=("grade", "text", "check-rules"))
        for name in ("--dir", "--out", "--policy", "--pattern", "--files-from", "--manifest", "--form", "--texts"):
            p.add_argument(name)
        p.add_argument("--simple", action="store_true")
        o = p.parse_args(guarded(sys.argv[1:] if args is None else args))
        data = json.load(open(o.policy, encoding="utf-8")) if o.policy else None
        if o.command == "check-rules":
            done = check_rules(data or {})
        else:
            if not o.dir or not o.out:
                raise Failed("bad_option", "--dir and --out are needed", sinks.BAD_INPUT)
            spark = spark or SparkSession.builder.appName("docgrade").getOrCreate()
            source = {"pattern": o.pattern, "names": o.files_from, "manifest": o.manifest}
            if o.command == "grade":
                done = grade(spark, o.dir, o.out, load(data) if data else DEMO, o.form, o.simple, o.texts, **source)
            else:
                done = text_only(spark, o.dir, o.out, o.form, **source)
    except Failed as e:
        done = e.status
    except PolicyError as e:
        done = sinks.status("bad_rules", None, str(e), sinks.BAD_RULES)
    except M.ManifestError as e:
        done = sinks.status("bad_manifest", None, str(e), sinks.BAD_INPUT)
    except (argparse.ArgumentError, sinks.SinkError) as e:
        done = sinks.status("bad_option", None, str(e), sinks.BAD_INPUT)
    print(sinks.as_json(done))
    return done.get("exit", sinks.OK)


if __name__ == "__main__":
    sys.exit(main())
