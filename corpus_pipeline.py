"""A corpus pipeline: toxic documents go, near copies go, leaked benchmark items go, personal data is
redacted, the rest is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrade.llm import decontamination, nearcopies, packing, pii, toxicity
from docgrade.llm.common import by_place, lean, named, settle, table
from docgrade.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. Null texts are not toxic."""
    lean(spark)
    return toxicity.keep(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the least doc_id stays.

    Rows that share an id stay or go with it; of those that share id and text one stays. Null, empty
    and word-free texts and rows without an id stay.
    """
    lean(spark)
    marks = nearcopies.groups(docs, size=5).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    marks, _ = settle(marks.filter("NOT kept OR times > 1"))
    flat, at = by_place(docs)
    doc_id, text = at["doc_id"], at["text"]
    gone = marks.select(F.col("doc_id").alias(doc_id), "kept")
    once = flat.join(gone, doc_id, "left_anti").select(*flat.columns)
    # ids are meant to be unique, so this is mostly nothing
    again = flat.join(gone.filter("kept"), doc_id).withColumn("_text", F.md5(F.col(text).cast("binary"))).dropDuplicates([doc_id, "_text"])
    return named(once.unionByName(again.select(*flat.columns)), docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    lean(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    lean(spark)
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    lean(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("packing", pack),
]

#: A trained classifier and a tokenizer are among the stages; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    drop_last: Callable[[], None] | None = None
    for _, stage in STAGES:
        docs, drop = settle(stage(spark, docs, sf_dir))
        if drop_last:
            drop_last()
        drop_last = drop
    return docs
