"""Seeds: approved examples with grades, document types and vectors; their lifecycle as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        out = F.when(fails, name).otherwise(out)
    return out


def capped(rows: DataFrame, by: str, n: int, *order: Column | str) -> DataFrame:
    """At most n rows of each group, the first in order."""
    w = W.partitionBy(by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).drop("place")


def capped_jointly(rows: DataFrame, caps: dict[str, int], *order: str) -> DataFrame:
    """Rows in order, each kept if none of its groups is full yet.

    Whether a row is kept depends on all before it, so this is one ordered pass, row by row, holding a
    count for each group. It is for lists of candidate seeds, which people approve, not for corpora.
    """
    columns, names = rows.columns, list(caps)

    def run(batches):
        used: dict = {}
        for batch in batches:
            keep = []
            for groups in zip(*(batch.column(columns.index(c)).to_pylist() for c in names), strict=True):
                own = list(zip(names, groups, strict=True))
                keep.append(all(used.get(g, 0) < caps[g[0]] for g in own))
                if keep[-1]:
                    for g in own:
                        used[g] = used.get(g, 0) + 1
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, rows.schema)


def selection_reason(t_seed: float = 0.85, min_chars: int = 200, min_sources: int = 2) -> Column:
    """Why a record makes no seed of a document type, null if it does. The first reason counts.

    Columns: doctype_on, vector, labels (array<struct<dc_id,confidence,sources,stage,review>>), n_chars, known, leaf.
    """
    one = F.get("labels", 0)
    return reject_reason(
        [
            ("axis_off", ~F.coalesce("doctype_on", F.lit(False))),
            ("no_vector", F.col("vector").isNull()),
            ("not_one_label", F.size("labels") != 1),
            ("short", F.col("n_chars") < min_chars),
            ("review", F.coalesce(one["review"], F.lit(False))),
            ("embedded", one["stage"] == "embed"),
            ("unsure", one["confidence"] < t_seed),
            ("few_sources", F.size(F.filter(one["sources"], lambda s: s != "body")) < min_sources),
            ("unknown_node", ~F.coalesce("known", F.lit(False))),
            ("no_leaf", ~F.coalesce("leaf", F.lit(False))),
        ]
    )


def selected(records: DataFrame, tree: DataFrame, per_folder: int = 3, per_node: int = 5, **bounds) -> tuple[DataFrame, DataFrame]:
    """Seeds among records (file, folder, ...), the surest first, at most so many of a folder and a node; and the reasons' counts."""
    parents = tree.filter("parent IS NOT NULL").select(F.col("parent").alias("dc_id")).distinct().withColumn("inner", F.lit(True))
    about = tree.select("dc_id", F.lit(True).alias("known")).join(parents, "dc_id", "left").select("dc_id", "known", F.col("inner").isNull().alias("leaf"))
    rows = records.withColumn("dc_id", F.get("labels", 0)["dc_id"]).join(about, "dc_id", "left")
    rows = rows.withColumns({"reason": selection_reason(**bounds), "first": -F.get("labels", 0)["confidence"]})
    taken = capped_jointly(rows.filter("reason IS NULL").select("file", "folder", "dc_id", "first"), {"folder": per_folder, "dc_id": per_node}, "first", "file")
    return taken.select("file", "folder", "dc_id", (-F.col("first")).alias("confidence")), rows.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("records"))


def replaced(seeds: DataFrame, new: DataFrame, command: str, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """Seeds with the rows of one command exchanged for new ones; and the command's old rows that have none any more."""
    old = seeds.filter(F.col("source") == command)
    kept = seeds.filter(F.coalesce(F.col("source"), F.lit("")) != command)
    fresh = new.withColumn("source", F.lit(command)).join(kept.select(key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True), old.join(new.select(key), key, "left_anti")


STATES = ("active", "suspect", "retired")


def edited(seeds: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """Seeds after the last operation (key, line, op, reason) on each: retire, suspect, restore, remove; others stay.

    Only an active seed turns suspect, and restoring brings back suspect and retired ones.
    """
    last = ops.groupBy(key).agg(F.max_by(F.struct("op", "reason"), "line").alias("o"))
    j = seeds.join(last, key, "left")
    op = F.coalesce("o.op", F.lit(""))
    state = F.when(op == "retire", "retired").when((op == "suspect") & (F.col("state") == "active"), "suspect").when((op == "restore") & F.col("state").isin("suspect", "retired"), "active").otherwise(F.col("state"))
    note = F.when(op.isin("retire", "suspect"), F.col("o.reason")).when(op == "restore", F.lit(None))
    return j.filter(op != "remove").select(*[c for c in seeds.columns if c != "state"], state.alias("state"), note.alias("note"))


def plan_errors(rows: DataFrame, columns: tuple[str, ...], reviewer: str | None) -> list[str]:
    """What forbids a batch of edits: no reviewer, unknown columns, a doc_id twice; all of it."""
    out = [] if reviewer else ["no reviewer"]
    out += [f"unknown column {c}" for c in rows.columns if c not in columns]
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").orderBy("doc_id").limit(5).collect()
    return out + [f"doc_id {r[0]} is given {r[1]} times" for r in twice]


def upgraded(rows: DataFrame, newest: int = 3) -> DataFrame:
    """Seed lines of older versions (json strings) in today's shape; blank, broken and newer ones are left out.

    Version 1 had grade and vector on top; version 2 moved the grade under ``axes``; version 3 the vector under ``embed``.
    """
    shape = "version int, file string, grade string, vector array<double>, axes struct<security:string,doctype:array<string>>, embed struct<vector:array<double>,model:string>, state string, reviewer string"
    j = rows.select(F.from_json("value", shape).alias("s")).select("s.*").filter(F.col("file").isNotNull() & (F.coalesce("version", F.lit(1)) <= newest))
    return j.select(
        F.lit(newest).alias("version"),
        "file",
        F.coalesce("axes.security", "grade").alias("grade"),
        F.col("axes.doctype").alias("doctype"),
        F.coalesce("embed.vector", "vector").alias("vector"),
        F.col("embed.model").alias("model"),
        F.coalesce("state", F.lit("active")).alias("state"),
        "reviewer",
    )


def audit(events: DataFrame, who: str, when: Column) -> DataFrame:
    """Rows for the log of a sync: key, before, after, reason with who and when."""
    return events.withColumns({"reviewer": F.lit(who), "ts": when})


def upsert(seeds: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes win column by column where they say something; new keys are added."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    both = seeds.join(new, key, "full")
    return both.select(key, *[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in both.columns else F.col(c) for c in seeds.columns if c != key])


def health(seeds: DataFrame, records: DataFrame, key: str, tree: DataFrame | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """key, problems: no vector, odd dimension, stale hash, missing file, suspect, odd engine, orphan types, conflict.

    Columns that seeds do not have (state, engine, doctype) raise no problem; conflicts are pairs (a, b) of keys.
    """
    have = set(seeds.columns)
    modal = seeds.filter("vector IS NOT NULL").agg(F.mode(F.size("vector")).alias("usual"))
    joined = seeds.join(records.select(key, F.col("hash").alias("record_hash")), key, "left").join(F.broadcast(modal))  # one row
    found = [
        F.when(F.col("vector").isNull(), "no_vector"),
        F.when(F.size("vector") != F.col("usual"), "odd_dimension"),
        F.when(F.col("record_hash").isNull(), "missing"),
        F.when(F.col("record_hash") != F.col("hash"), "stale"),
    ]
    if "state" in have:
        found.append(F.when(F.col("state") == "suspect", "suspect"))
    if "engine" in have:
        joined = joined.join(F.broadcast(seeds.agg(F.mode("engine").alias("usual_engine"))))  # one row
        found.append(F.when(F.col("engine") != F.col("usual_engine"), "odd_engine"))
    if tree is not None and "doctype" in have:
        orphans = seeds.select(key, F.explode("doctype").alias("dc_id")).join(tree.select("dc_id"), "dc_id", "left_anti").select(key).distinct().withColumn("orphan", F.lit(True))
        joined = joined.join(orphans, key, "left")
        found.append(F.when(F.col("orphan"), "orphan_type"))
    if conflicts is not None:
        both = conflicts.select(F.col("a").alias(key)).unionByName(conflicts.select(F.col("b").alias(key))).distinct().withColumn("conflict", F.lit(True))
        joined = joined.join(both, key, "left")
        found.append(F.when(F.col("conflict"), "conflict"))
    problems = F.filter(F.array(*found), lambda x: x.isNotNull())
    return joined.select(key, problems.alias("problems")).filter(F.size("problems") > 0)


def sync(seeds: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """key, before, after, reason: an active seed turns suspect when its file is gone or changed, and back."""
    r = records.select(key, F.col("hash").alias("now_hash"))
    j = seeds.join(r, key, "left")
    reason = F.when(F.col("now_hash").isNull(), "missing").when(F.col("now_hash") != F.col("hash"), "stale")
    after = F.when((F.col("state") == "active") & reason.isNotNull(), "suspect").when((F.col("state") == "suspect") & reason.isNull(), "active")
    return j.select(key, F.col("state").alias("before"), after.alias("after"), F.coalesce(reason, F.lit("recovered")).alias("reason")).filter("after IS NOT NULL")


def balance(seeds: DataFrame) -> DataFrame:
    """grade, n, weak: a grade with none or fewer than a quarter of the largest is weak."""
    counts = seeds.groupBy("grade").agg(F.count("*").alias("n"))
    return counts.withColumn("weak", F.col("n") < F.max("n").over(W.partitionBy()) / 4)
