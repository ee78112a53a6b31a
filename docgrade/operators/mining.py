"""Vocabulary mining: which words of labelled documents would make good rule terms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pii import PARTICLES, let


def words(text: Column, min_length: int = 3) -> Column:
    """Distinct lower-case words that are long enough and no numbers."""
    whole = rf"(?<![a-zà-ɏ0-9])[a-zà-ɏ]{{{min_length},}}+(?![0-9])"
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(whole), 0))


def cluster_weights(docs: DataFrame, *by: str) -> DataFrame:
    """by..., w: a folder counts once, however many documents it holds. Summed before the shuffle, whatever a folder's size."""
    return docs.groupBy(*by).agg((1.0 / F.count("*")).alias("w"))


def log_odds(df_pos: Column, df_neg: Column, n_pos: Column, n_neg: Column) -> Column:
    one = F.lit(1.0)
    return F.log((df_pos + 0.5 / F.greatest(n_pos, one)) / (df_neg + 0.5 / F.greatest(n_neg, one)))


def weighted_frequencies(docs: DataFrame, positive: Column, folder: str, rejected_weight: float = 1.0) -> DataFrame:
    """term, df_pos, df_neg (shares of the weight), docs, folders, log_odds for every positive term.

    Negatives are counted only for terms that some positive document has: a semi-join before the
    large side is summed.
    """
    # folders are few against documents, but their number is not bounded: Spark broadcasts their weights if they are small
    marked = docs.withColumns({"pos": positive, folder: F.coalesce(folder, F.lit(""))})
    long = marked.select("pos", folder, F.explode(words(F.col("text"))).alias("term"))
    weights = cluster_weights(marked, folder, "pos").withColumn("w", F.when(F.col("pos"), F.col("w")).otherwise(F.col("w") * rejected_weight))
    # each folder of either kind sums to its factor
    sides = weights.groupBy("pos").agg(F.sum(F.when(F.col("pos"), 1.0).otherwise(rejected_weight)).alias("whole"))
    totals = sides.agg(F.coalesce(F.sum(F.when(F.col("pos"), F.col("whole"))), F.lit(0.0)).alias("n_pos"), F.coalesce(F.sum(F.when(~F.col("pos"), F.col("whole"))), F.lit(0.0)).alias("n_neg"))
    # documents of a term by folder first, so texts and weights never meet
    counts = long.groupBy("term", folder, "pos").agg(F.count("*").alias("n")).join(weights.select(folder, "pos", "w"), [folder, "pos"])
    pos = counts.filter("pos").groupBy("term").agg(F.sum(F.col("n") * F.col("w")).alias("w_pos"), F.sum("n").alias("docs"), F.count("*").alias("folders"))
    neg = counts.filter("NOT pos").join(pos.select("term"), "term", "left_semi").groupBy("term").agg(F.sum(F.col("n") * F.col("w")).alias("w_neg"))
    out = pos.join(neg, "term", "left").join(F.broadcast(totals))
    df_pos = F.col("w_pos") / F.greatest("n_pos", F.lit(1e-12))
    df_neg = F.coalesce("w_neg", F.lit(0.0)) / F.greatest("n_neg", F.lit(1e-12))
    return out.select("term", df_pos.alias("df_pos"), df_neg.alias("df_neg"), "docs", "folders", log_odds(df_pos, df_neg, F.col("n_pos"), F.col("n_neg")).alias("log_odds"))


def verdict(min_docs: int = 3, min_folders: int = 2, max_neg: float = 0.05) -> Column:
    return (
        F.when(F.col("docs") < min_docs, "few_docs").when(F.col("folders") < min_folders, "few_folders").when(F.round("df_neg", 9) > max_neg, "too_common").otherwise("ok")
    )


# ---------------------------------------------------------------- words of documents


#: Signs of words, and words that are no words: numbers and what begins with a digit, one sign repeated, file extensions.
_SIGN = "[0-9a-zà-ɏ가-힣]"
_EXTENSION = "(?:pdf|docx?|xlsx?|pptx?|hwpx?|txt|html?)"


def tokens(text: Column, suffixes: tuple[str, ...] = (), endings: tuple[str, ...] = (), particles: tuple[str, ...] = tuple(PARTICLES), least: int = 2) -> Column:
    """Distinct words fit for rules: particles stripped (not from words that end like a document's name, two
    signs stay), without numbers, words with digits in front, file extensions, verb endings and short ones.

    One pattern finds them. Only in texts with a sign in the range of particles' last ones are words, each once, looked at one by one.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    whole = rf"(?<!{_SIGN})(?![0-9])(?!(.)\1*+(?!{_SIGN}))(?!{_EXTENSION}(?!{_SIGN})){_SIGN}{{{max(least, 1)},}}+"
    out = F.array_distinct(F.regexp_extract_all(low, F.lit(whole), 0))
    if particles:
        bare = rf"(?<=..)(?:{'|'.join(particles)})$"
        kept = rf"(?:{'|'.join(suffixes)})$" if suffixes else None
        strip = lambda w: F.regexp_replace(w, bare, "")
        each = F.array_distinct(F.regexp_extract_all(low, F.lit(f"{_SIGN}++"), 0))
        each = F.transform(each, (lambda w: F.when(w.rlike(kept), w).otherwise(strip(w))) if kept else strip)
        junk = rf"^[0-9]|^(.)\1*$|^{_EXTENSION}$"
        each = F.array_distinct(F.filter(each, lambda w: (F.length(w) >= least) & ~w.rlike(junk)))
        last = sorted(p[-1] for p in particles)
        out = F.when(low.rlike(f"[{re.escape(last[0])}-{re.escape(last[-1])}]"), each).otherwise(out)
    if endings:
        out = F.filter(out, lambda w: ~w.rlike(rf"(?:{'|'.join(endings)})$"))
    return out


def fields(title: Column, name: Column, head: Column, body: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """struct(title, name, head, body, loose): each field's words without those of the fields before it; loose are
    the words of the body that end like no document's name."""
    found = F.struct(*[tokens(c, suffixes).alias(k) for k, c in (("t", title), ("n", name), ("h", head), ("b", body))])
    ends = rf"(?:{'|'.join(suffixes)})$"

    def parted(w: Column) -> Column:
        t, n, h, b = (w[k] for k in "tnhb")
        return F.struct(
            t.alias("title"),
            F.array_except(n, t).alias("name"),
            F.array_except(h, F.array_union(t, n)).alias("head"),
            F.array_except(b, F.array_union(F.array_union(t, n), h)).alias("body"),
            (F.filter(b, lambda x: ~x.rlike(ends)) if suffixes else b).alias("loose"),
        )

    return let(found, parted)


def merged_labels(approved: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """key, labels: approved labels (key, labels) and confirmed ones without the rejected (key, confirmed, rejected)."""
    none = F.array().cast("array<string>")
    both = approved.join(reviewed, key, "full")
    labels = F.array_except(F.array_union(F.coalesce("labels", none), F.coalesce("confirmed", none)), F.coalesce("rejected", none))
    return both.select(key, F.array_sort(labels).alias("labels")).filter(F.size("labels") > 0)


def located(labels: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("hash", "path", "doc_id")) -> DataFrame:
    """labels with the text that the first key to find one gives, and which key that was."""
    out = labels
    for k in keys:
        one = texts.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("text").alias(f"_{k}"))
        out = out.join(one, k, "left")
    by = F.coalesce(*[F.when(F.col(f"_{k}").isNotNull(), F.lit(k)) for k in keys])
    return out.withColumns({"text": F.coalesce(*[F.col(f"_{k}") for k in keys]), "found_by": by}).drop(*[f"_{k}" for k in keys])


def lanes(in_folder: Column | None = None, *, min_docs: int = 3, min_folders: int = 2, max_neg: float = 0.05) -> Column:
    """Which way a term is let in, or why not: ``strict``, ``loose`` (common among positives, rare elsewhere),
    ``single_folder`` (long, in most documents of its one folder), else few_docs, few_folders or too_common."""
    pos, neg = F.round("df_pos", 9), F.round("df_neg", 9)
    out = F.when((F.col("docs") >= min_docs) & (F.col("folders") >= min_folders) & (neg <= max_neg), "strict")
    out = out.when((F.col("docs") >= min_docs) & (pos >= 0.5) & (neg <= 0.02), "loose")
    if in_folder is not None:
        out = out.when((F.col("folders") == 1) & (F.length("term") >= 3) & (F.col("docs") >= 5) & (in_folder >= 0.9) & (neg <= 0.02), "single_folder")
    return out.when(F.col("docs") < min_docs, "few_docs").when(F.col("folders") < min_folders, "few_folders").otherwise("too_common")


def below(mined: DataFrame, verdict_: Column, most: int = 15) -> DataFrame:
    """For each reason the strongest terms that it kept out."""
    w = W.partitionBy("reason").orderBy(F.col("log_odds").desc(), "term")
    out = mined.withColumn("reason", verdict_).filter(~F.col("reason").isin("strict", "loose", "single_folder"))
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def without_known(terms: DataFrame, *known: DataFrame) -> DataFrame:
    """Terms that no given table (term) holds: words of the rule itself, stop words, titles of other nodes."""
    out = terms
    for k in known:
        out = out.join(k.select("term").distinct(), "term", "left_anti")
    return out


def flagged(terms: DataFrame, owners: DataFrame, texts: DataFrame) -> DataFrame:
    """terms with ``owner`` (a rule that has the term already) and ``proper`` (always written with a capital, or part of a folder's name)."""
    own = owners.groupBy("term").agg(F.min("dc_id").alias("owner"))
    raw = texts.select("folder", F.explode(F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), r"[^0-9A-Za-zÀ-ɏ가-힣]+"), lambda w: w != ""))).alias("word"))
    seen = raw.groupBy(F.lower("word").alias("term")).agg(F.min((F.col("word") != F.lower("word"))).alias("capital"))
    folders = texts.select(F.explode(tokens(F.col("folder"))).alias("term")).distinct().withColumn("in_folder", F.lit(True))
    out = terms.join(own, "term", "left").join(seen, "term", "left").join(folders, "term", "left")
    return out.withColumn("proper", F.coalesce("capital", F.lit(False)) | F.coalesce("in_folder", F.lit(False))).drop("capital", "in_folder")


def focused(mined: DataFrame, document: DataFrame, most: int = 15) -> tuple[DataFrame, DataFrame]:
    """Terms of one document (its ``text``): those let in, and the nearest misses."""
    own = document.select(F.explode(words(F.col("text"))).alias("term")).distinct()
    there = mined.join(own, "term", "left_semi").withColumn("lane", lanes())
    fine = F.col("lane").isin("strict", "loose", "single_folder")
    return there.filter(fine), there.filter(~fine).orderBy(F.col("log_odds").desc(), "term").limit(most)


def applied(rules: dict[str, list[str]], node: str, picks: list[str], stop: dict[str | None, set[str]] | None = None) -> dict[str, list[str]]:
    """The rules with picked terms added to a node, stop words (of all nodes, of this one) left out."""
    stop = stop or {}
    barred = set(stop.get(None, ())) | set(stop.get(node, ()))
    have = rules.get(node, [])
    return rules | {node: have + [p for p in dict.fromkeys(picks) if p not in have and p not in barred]}
