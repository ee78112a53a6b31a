"""Vocabulary of document types: synonym layers, spelling variants, head words of titles, file names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def layered(*layers: dict[str, list[str]]) -> dict[str, list[str]]:
    """Later layers add to earlier ones; longest words first, then by spelling."""
    out: dict[str, list[str]] = {}
    for layer in layers:
        for word, others in layer.items():
            have = out.setdefault(word, [])
            have += [o for o in others if o not in have]
    return {w: out[w] for w in sorted(out, key=lambda w: (-len(w), w))}


def doubled(word: str) -> bool:
    """Whether a piece of two or more signs stands twice in a row."""
    return re.search(r"(.{2,})\1", word) is not None


def variants(title: str, synonyms: dict[str, list[str]], limit: int = 10, filename: bool = False) -> list[str]:
    """The title, its spacing forms and what replacing parts by synonyms gives, without doubled pieces."""
    out = [title, title.replace(" ", "")]
    for word, others in synonyms.items():
        if word in title:
            out += [title.replace(word, o) for o in others]
    out = [v for v in dict.fromkeys(out) if v and (v == title or not doubled(v))]
    if filename:
        out += [v.replace(" ", s) for v in out if " " in v for s in "_-"]
    return list(dict.fromkeys(out))[:limit]


def judge(title: str, others: list[str], endings: tuple[str, ...] = (), broad: tuple[str, ...] = ()) -> str:
    """ok, or why a title makes no head word: broad, too short, or the end of several other titles."""
    word = title.replace(" ", "")
    if word in broad:
        return "broad"
    if len(word) < 2:
        return "short"
    if endings and not word.endswith(endings):
        return "ending"
    if sum(o.replace(" ", "").endswith(word) and o != title for o in others) >= 2:
        return "common"
    return "ok"


def suffixes(names: DataFrame, column: str, least: int = 2) -> DataFrame:
    """suffix, kinds: names of two to six signs that end at least so many other names.

    Every name gives its own endings, so the two sides meet by equality, not by comparison of all.
    """
    distinct = names.select(F.col(column).alias("name")).distinct()
    ends = distinct.select("name", F.explode(F.sequence(F.lit(2), F.least(F.lit(6), F.greatest(F.length("name") - 1, F.lit(2))))).alias("n"))
    ends = ends.filter(F.length("name") > F.col("n")).select("name", F.expr("right(name, n)").alias("suffix"))
    alone = distinct.filter(F.length("name").between(2, 6)).select(F.col("name").alias("suffix"))
    return ends.join(alone, "suffix", "left_semi").groupBy("suffix").agg(F.count("*").alias("kinds")).filter(F.col("kinds") >= least)


def stem(file: Column, noise: tuple[str, ...] = ()) -> Column:
    """The file's name without extension, blanks and trailing dates, numbers, versions and noise words."""
    s = F.regexp_replace(F.lower(T.basename(file)), r"\.[a-z0-9]{1,5}$", "")
    tails = "|".join([r"[0-9]+", r"v[0-9.]+", r"final", r"copy", *map(re.escape, noise)])
    return T.despace(F.regexp_replace(s, rf"(?:[\s_().\-]*(?:{tails})[\s_().\-]*)+$", ""))


def by_name(docs: DataFrame, key: str, file: str, heads: dict[str, str], confidence: float) -> DataFrame:
    """key, dc_id, confidence, review: the longest head word that ends the stem, ties to the smaller node.

    heads: word -> node. Looked for among the stem's endings, one array test a document.
    """
    lexicon = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(n).alias("node")) for w, n in sorted(heads.items())])
    found = F.filter(lexicon, lambda h: F.endswith(F.col("_stem"), h["word"]))
    best = F.array_min(F.transform(found, lambda h: F.struct((-F.length(h["word"])).alias("a"), h["node"].alias("node"))))
    out = docs.withColumn("_stem", stem(F.col(file))).withColumn("_best", best).filter("_best IS NOT NULL")
    return out.select(key, F.col("_best.node").alias("dc_id"), F.lit(confidence).alias("confidence"), F.lit(True).alias("review"))


def head_rank(cands: DataFrame, key: str) -> DataFrame:
    """Candidates numbered by confidence within each document."""
    return cands.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.col("confidence").desc(), "dc_id")))
