"""Evaluation against people's labels: grades, document types, agreement of extractions, titles, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grading import rank


def weighted(rows: DataFrame, stratum: str | None, population: DataFrame | None) -> DataFrame:
    """``w``: how many documents of the population each sampled one stands for; one without a population."""
    if population is None:
        return rows.withColumn("w", F.lit(1.0))
    n = rows.groupBy(stratum).agg(F.count("*").alias("_n")).join(population.select(stratum, F.col("n").alias("_pop")), stratum, "left")
    return rows.join(n.select(stratum, (F.coalesce("_pop", "_n") / F.col("_n")).alias("w")), stratum)


def grades(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: recall and precision of C, shares of exact, over- and under-graded documents (no grade is the lowest)."""
    order = lambda c: F.when(F.col(c).isNull(), -1).otherwise(rank(F.col(c)))
    t, p = order(truth), order(predicted)
    total = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    is_c = lambda c: F.coalesce(F.col(c) == "C", F.lit(False))
    sums = rows.agg(
        F.sum("w").alias("n"), total(is_c(truth) & is_c(predicted)).alias("hit"), total(is_c(truth)).alias("of_truth"), total(is_c(predicted)).alias("of_predicted"),
        total(t == p).alias("exact"), total(p > t).alias("over"), total(p < t).alias("under"),
    )
    return sums.select(
        F.try_divide("hit", "of_truth").alias("c_recall"), F.try_divide("hit", "of_predicted").alias("c_precision"),
        *[F.try_divide(c, "n").alias(c) for c in ("exact", "over", "under")],
    )


def doctypes(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row over sets of labels: weighted precision and recall of labels, and the verdicts' counts
    (exact, partial, wrong, missed, extra, none)."""
    t, p = F.col(truth), F.col(predicted)
    both = F.size(F.array_intersect(t, p))
    verdict = doctype_verdict(t, p)
    kinds = ("exact", "partial", "wrong", "missed", "extra", "none")
    sums = rows.agg(F.sum(both * F.col("w")).alias("hit"), F.sum(F.size(p) * F.col("w")).alias("said"), F.sum(F.size(t) * F.col("w")).alias("true"), *[F.count_if(verdict == k).alias(f"n_{k}") for k in kinds])
    return sums.select(F.try_divide("hit", "said").alias("precision"), F.try_divide("hit", "true").alias("recall"), *[f"n_{k}" for k in kinds])


def doctype_verdict(t: Column, p: Column) -> Column:
    both = F.size(F.array_intersect(t, p))
    return (
        F.when((F.size(t) == 0) & (F.size(p) == 0), "none")
        .when(F.size(p) == 0, "missed")
        .when(F.size(t) == 0, "extra")
        .when(both == 0, "wrong")
        .when((both == F.size(t)) & (both == F.size(p)), "exact")
        .otherwise("partial")
    )


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[0-9a-zà-ɏ가-힣]+"), 0))


def extraction_agreement(rows: DataFrame, by: str = "extension", mine: str = "mine", other: str = "other", seconds: str | None = None, size: str | None = None) -> DataFrame:
    """By group: documents both could read, sets of words compared (recall, precision, Jaccard), ratio of signs,
    times where given, and who failed."""
    a, b = token_set(F.coalesce(mine, F.lit(""))), token_set(F.coalesce(other, F.lit("")))
    both = rows.withColumns({"_a": a, "_b": b}).withColumn("_i", F.size(F.array_intersect("_a", "_b")))
    fine = (F.size("_a") > 0) & (F.size("_b") > 0)
    mean = lambda c: F.avg(F.when(fine, c))
    extra = []
    if seconds:
        extra += [F.median(seconds).alias("median_seconds"), F.sum(seconds).alias("seconds")]
    if seconds and size:
        extra += [F.try_divide(F.sum(size) / 1e6, F.sum(seconds)).alias("mb_per_second")]
    return both.groupBy(by).agg(
        F.count("*").alias("docs"), F.count_if(fine).alias("compared"),
        mean(F.col("_i") / F.size("_b")).alias("recall"), mean(F.col("_i") / F.size("_a")).alias("precision"),
        mean(F.col("_i") / (F.size("_a") + F.size("_b") - F.col("_i"))).alias("jaccard"), mean(F.length(mine) / F.length(other)).alias("char_ratio"),
        F.count_if((F.size("_a") == 0) & (F.size("_b") > 0)).alias("only_other"), F.count_if((F.size("_a") > 0) & (F.size("_b") == 0)).alias("only_mine"), *extra,
    )


def title_check(judged: DataFrame, labels: DataFrame, most: float = 0.10) -> DataFrame:
    """One row: of titles that people call good, how many the judgement threw out, and whether that is few enough."""
    j = judged.join(labels, "dc_id")
    good = F.col("good")
    out = j.agg(F.count_if(good).alias("good"), F.count_if(good & (F.col("verdict") != "ok")).alias("thrown_out"), F.count_if(~good & (F.col("verdict") == "ok")).alias("let_in"))
    share = F.coalesce(F.try_divide("thrown_out", "good"), F.lit(0.0))
    return out.withColumns({"over_filter": share, "passed": share <= most})


def sheet(documents: DataFrame, records: DataFrame, key: Column, limit: int = 500) -> DataFrame:
    """An evaluation sheet: every document, what the engine said, and the beginning of its text for a person to judge."""
    d = documents.withColumn("_key", key)
    r = records.withColumn("_key", key).drop(*[c for c in records.columns if c in documents.columns])
    out = d.join(r, "_key", "left").drop("_key")
    return out.withColumn("excerpt", F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), 1, limit)).drop("text")
