"""Language ID by rank-order profiles.

A profile is the ranking of the most frequent character n-grams (one to three letters, words padded
by a blank on both sides). A document gets the language whose profile puts the document's own most
frequent n-grams least far out of place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_rows, pick, settle, sifted
from .toxicity import held_out

TOP = 300
SALTS = 16
PAD = 0x5F
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; built once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Every n-gram of the text as one integer of three code points; empty without a letter."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # the last of the characters before a word stands for them all
    keep[1:] |= letter[:-1]
    c = np.where(letter, codes, PAD).astype(np.int64)[keep]
    if len(c):  # two pads in a row, from words two or more characters apart, meet here; one is enough
        twice = (c[1:] == PAD) & (c[:-1] == PAD)
        c = np.concatenate([c[:1], c[1:][~twice]])
    if not len(c):
        return c
    inner = c != PAD
    two = (c[:-1] << 21) | c[1:]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inner[1:-1]]
    return np.concatenate([c[inner], two, three])


def ranked(values: np.ndarray, counts: np.ndarray | None = None, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties to the smaller code."""
    if counts is None:
        values, counts = np.unique(values, return_counts=True)
    if len(values) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        some = counts >= least
        values, counts = values[some], counts[some]
    return values[np.argsort(-counts, kind="stable")][:top]


@dataclass(frozen=True)
class Profiles:
    """For every n-gram of any profile the languages that rank it: as many entries as the profiles have ranks."""

    langs: tuple[str, ...]
    grams: np.ndarray  # sorted
    first: np.ndarray  # by n-gram, where its entries begin; one more at the end
    lang: np.ndarray  # by entry
    rank: np.ndarray  # by entry

    def distances(self, own: np.ndarray) -> np.ndarray:
        """For each language how far out of place the document's ranking is; an n-gram it lacks counts TOP."""
        far = np.full(len(self.langs), float(TOP * len(own)))
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            known = np.flatnonzero(self.grams[at] == own)
            a, n = self.first[at[known]], self.first[at[known] + 1] - self.first[at[known]]
            entry = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            place = np.repeat(known, n)
            far += np.bincount(self.lang[entry], np.abs(self.rank[entry] - place) - TOP, minlength=len(self.langs))
        return far

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(grams(text))
        if not len(own) or not self.langs:
            return "und", 0.0
        far = self.distances(own) / (TOP * len(own))
        best = int(far.argmin())
        if len(far) == 1:
            return self.langs[0], float(1 - far[0])
        # how much nearer the best is than the next: one half when they are equally near
        next_ = np.partition(far, 1)[1]
        return self.langs[best], float(next_ / (far[best] + next_)) if far[best] + next_ else 0.5


def profiles(tops: dict[str, np.ndarray]) -> Profiles:
    """From each language's n-grams, most frequent first."""
    langs = tuple(sorted(tops))
    if not langs:
        return Profiles((), *(np.zeros(0, np.int64) for _ in range(4)))
    gram = np.concatenate([tops[x] for x in langs])
    lang = np.repeat(np.arange(len(langs)), [len(tops[x]) for x in langs])
    rank = np.concatenate([np.arange(len(tops[x])) for x in langs])
    order = np.argsort(gram, kind="stable")
    every, first = np.unique(gram[order], return_index=True)
    return Profiles(langs, every, np.append(first, len(gram)), lang[order], rank[order])


def learn(texts_by_lang: dict[str, list[str | None]]) -> Profiles:
    tops = {}
    for lang, texts in texts_by_lang.items():
        values = [g for g in map(grams, texts) if len(g)]
        if values:
            tops[lang] = ranked(np.concatenate(values))
    return profiles(tops)


def fit(docs: DataFrame, per_lang: int = 400) -> Profiles:
    """The profile of every language there is, from at most ``per_lang`` rows of each, used whole.

    Rows are drawn in the order of a hash of id and text among those that may be learnt from (not
    held out, lang not null); equal rows in the draw count each. N-grams are counted where the texts
    are, summed by language, cut to TOP, and only the profiles go to the driver: TOP numbers a language.
    """
    rows = pick(docs, "doc_id", "lang", "text").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("order", F.xxhash64("doc_id", "text"))
    # numbers alone are ranked, a language in SALTS parts first, so that none gathers more than SALTS * per_lang
    drawn = rows.select("doc_id", "lang", "order", F.pmod("order", F.lit(SALTS)).alias("salt"))
    for by in (["lang", "salt"], ["lang"]):
        first = F.row_number().over(W.partitionBy(*by).orderBy("order", "doc_id"))
        drawn = drawn.withColumn("place", first).filter(F.col("place") <= per_lang)
    drawn, drop = settle(drawn.groupBy("doc_id", "lang", "order").agg(F.count("*").alias("times")))
    # texts move only if they may have been drawn
    texts = sifted(rows, F.col("order"), drawn, F.col("order")).join(drawn, ["doc_id", "lang", "order"])
    texts = texts.select("lang", "text", "times").dropDuplicates(["lang", "text"])

    def count(batches):
        for batch in batches:
            for lang, text, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values, n = np.unique(grams(text), return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(values), "gram": values, "n": n * times})

    sums = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP).select("lang", "rank", "gram")
    tops: dict[str, list] = {}
    for lang, _, gram in sorted(top.collect()):
        tops.setdefault(lang, []).append(gram)
    drop()
    return profiles({k: np.array(v, np.int64) for k, v in tops.items()})


def predict(docs: DataFrame, known: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, in one pass without a shuffle.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learnt. Repeated
    rows repeat, an empty table gives none, a long text is ranked whole; equally near languages
    go to the first by name.
    """

    def step(cols: dict[str, list]) -> dict[str, list]:
        got = [known.predict(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    out = map_rows(pick(docs, "doc_id", "text"), step, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
