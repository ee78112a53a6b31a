"""Batch propagation: what rules left open is decided by the nearest approved seeds, and fused again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grading as G
from . import taxonomy as X
from . import vectors as V

STORED = ("rule", "sensitive", "stamp", "name")


def seed_index(records: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """seed, grade, vector: this run's graded and seed-eligible records, and the approved file, which wins where both have one."""
    own = records.filter("grade IS NOT NULL AND seed_eligible AND vector IS NOT NULL").select("seed", "grade", "vector")
    if external is None:
        return own
    return external.select("seed", "grade", "vector").unionByName(own.join(external.select("seed"), "seed", "left_anti"))


def security(records: DataFrame, seeds: DataFrame, id_col: str, vector: str = "vector", k: int = 10, dup: float = 0.95, min_sim: float = 0.55, min_share: float = 0.70, failsafe: str | None = None) -> DataFrame:
    """records with ``security`` fused again and ``outcome``: graded, no_vector, no_seed or the vote's method.

    records hold the stored signals (signal_rule ...), security and a vector; seeds are seed, grade,
    vector. Graded records are left as they are and never compared; a record is no seed of its own.

    Records are worked out once, however long their grading takes: both what is asked of the seeds and what the
    answers are joined to read one exchange by id, of lists that no column can be pruned from.
    """
    columns = records.columns
    listed = records.groupBy(id_col).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    sized = records.select(F.col(vector).alias("vector"))
    records = listed.select(F.explode("_rows").alias("_row")).select("_row.*")
    open_ = records.filter(F.col("security.grade").isNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("seed"), F.col(vector).alias("vector"))
    near = V.neighbours(open_, seeds, "seed", "vector", k, other_only=True, sized=sized)
    votes = V.grade_vote(near, seeds.select("seed", "grade"), dup, min_sim, min_share)
    votes = votes.select(F.col("query").alias(id_col), F.col("method").alias("_method"), F.struct(F.col("grade"), F.col("confidence"), F.lit(False).alias("seed_eligible")).alias("_embed"))
    both = records.join(votes, id_col, "left")
    signals: dict[str, Column] = {n: F.col(f"signal_{n}") for n in STORED if f"signal_{n}" in records.columns}
    fused = G.fuse(signals | {"embed": F.col("_embed")}, failsafe)
    graded = F.col("security.grade").isNotNull()
    outcome = F.when(graded, "graded").when(F.col(vector).isNull(), "no_vector").otherwise(F.coalesce("_method", F.lit("no_seed")))
    both = both.withColumns({"outcome": outcome, "security": F.when(graded, F.col("security")).otherwise(fused)})
    return both.drop("_method", "_embed")


def outcomes(propagated: DataFrame) -> DataFrame:
    """How many records ended how: one aggregate."""
    return propagated.groupBy("outcome").agg(F.count("*").alias("records"), F.count_if(F.col("security.grade").isNotNull()).alias("graded"))


def doctype(cands: DataFrame, docs: DataFrame, seeds: DataFrame, tree: DataFrame, id_col: str, vector: str = "vector", k: int = 10, dup: float = 0.95, min_sim: float = 0.55, min_share: float = 0.25, cap: float = 0.6) -> DataFrame:
    """id, dc_id, confidence, stage: rule candidates and the labels of near seeds (seed, labels, vector), merged.

    Every document with a vector takes part, decided or not; labels that the tree does not know are left out.
    """
    asked = docs.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("seed"), F.col(vector).alias("vector"))
    near = V.neighbours(asked, seeds, "seed", "vector", k, other_only=True)
    votes = V.label_vote(near, seeds.select("seed", "labels"), dup, min_sim, min_share)
    embedded = votes.groupBy(F.col("query").alias(id_col), F.col("label").alias("dc_id")).agg(F.max("confidence").alias("confidence"))
    return X.embed_merge(cands, embedded, id_col, cap, tree)


def needs_vector(grade: Column, seed_eligible: Column, has_doctype: Column) -> Column:
    """The model runs on these alone: no grade, a seed to be, or no document type."""
    return grade.isNull() | F.coalesce(seed_eligible, F.lit(False)) | ~F.coalesce(has_doctype, F.lit(False))
