"""Spans: overlaps resolved by risk, windows over long texts, merged counts. ``functions.pii.detect`` makes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = "array<struct<label:string,start:int,end:int,risk:int,conf:double>>"


def resolve(spans: Column) -> Column:
    """Greedy by risk, confidence and length falling, then start; what is kept never overlaps."""
    keyed = F.transform(
        spans,
        lambda s: F.struct((-s["risk"]).alias("a"), (-s["conf"]).alias("b"), (s["start"] - s["end"]).alias("c"), s["start"].alias("d"), s.alias("s")),
    )
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])
    kept = F.aggregate(
        ordered,
        F.array().cast(SPAN),
        lambda acc, s: F.when(F.exists(acc, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(s)).cast(SPAN)),
    )
    by_start = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("a"), s.alias("s"))))
    return F.transform(by_start, lambda k: k["s"])


def windows(docs: DataFrame, text: str = "text", size: int = 10_000, overlap: int = 128, covered: int = 1_000_000) -> DataFrame:
    """Long texts as overlapping windows (offset, piece), so that one document is many tasks' work."""
    n = F.least(F.length(text), F.lit(covered))
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return docs.withColumn("offset", F.explode(starts)).withColumn("piece", F.substr(F.col(text), F.col("offset") + 1, F.least(F.lit(size), n - F.col("offset"))))


def merged_count(spans: DataFrame, key: str) -> DataFrame:
    """Islands of touching spans by key: gaps found by the running maximum of the ends before."""
    w = W.partitionBy(key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    new = F.when(F.col("start") >= F.coalesce(F.max("end").over(w), F.lit(-1)), 1).otherwise(0)
    return spans.withColumn("new", new).groupBy(key).agg(F.sum("new").alias("n_merged"))
