"""Toxicity: a bag of subword vectors, averaged, into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams, so a misspelling that was
never seen still shares most of its vectors with the word it hides. A segment's vector is the mean
of its words', and a layer of two columns, clean and toxic, turns it into a softmax. Vectors and
layer start at random and are fitted together by Adagrad on the documents' log loss. A document is
as toxic as its most toxic segment: averaged over ten thousand words one insult would vanish.

Training starts from the plain average over all segments of a document and sharpens, epoch by
epoch, towards its most toxic one; clean documents speak for all of their segments throughout.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, in_child, map_rows, named, pick, remember, sparing

BUCKETS = 1 << 16
SEGMENT = 8
SIZES = (3, 4, 5)
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
CACHE = 200_000
DIM = 10
#: An n-gram of fewer documents can only be learnt by heart; its vector stays zero.
LEAST_DOCS = 4
RATE, BATCH = 0.5, 96
#: Batches an epoch has at least; few documents are gone through more than once.
STEPS = 30
#: How sharply each epoch picks a document's most toxic segments.
SHARP = (0.0, 0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 16.0, 16.0, 16.0)
#: Weight of toxic documents in the loss, and the share of them assumed when scores are calibrated.
TOXIC_WEIGHT = 0.5


@dataclass(frozen=True)
class Model:
    """Vectors by n-gram bucket, the layer's two columns (clean, toxic) and their biases."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    @property
    def lean(self) -> float:
        return float(self.bias[1] - self.bias[0])

    def pull(self) -> np.ndarray:
        """Each bucket's share of the toxic column's lead over the clean one: all steps up to the softmax are linear."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0])


def blank() -> Model:
    """What is learnt from nothing, or from one label alone: every text scores the same, near zero."""
    return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.array([8.0, 0.0]))


def word_logits(pull: np.ndarray, words: list[str]) -> np.ndarray:
    bucket, word = subwords(words)
    n = np.bincount(word, minlength=len(words))
    return np.bincount(word, pull[bucket], minlength=len(words)) / np.maximum(n, 1)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of ``<word>``, and the word that each belongs to."""
    joined = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters to the word's end
    out, of = [], []
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(codes) < n:
            break
        rolling = (rolling[: len(codes) - n + 1] * np.uint64(0x100000001B3)) ^ codes[n - 1 :]
        if n in SIZES:
            inside = left[: len(rolling)] >= n
            mixed = (rolling[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(64 - 16)).astype(np.int32) % np.int32(BUCKETS))
            of.append(owner[: len(rolling)][inside])
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(out), np.concatenate(of)


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def clean(token: str) -> str:
    return EDGE.sub("", token)


def runs(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin."""
    return np.cumsum(sizes) - sizes


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs with these starts and sizes, one run after the other."""
    return np.repeat(starts - runs(sizes), sizes) + np.arange(sizes.sum())


def means(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean of each run of rows; no run is empty."""
    return np.add.reduceat(rows, runs(sizes), axis=0) / sizes[:, None].astype(rows.dtype)


@dataclass
class Bags:
    """Documents as words and words as n-grams, in flat arrays."""

    words: list[np.ndarray]  # by document, the numbers of its words
    grams: np.ndarray  # by word, its n-grams, one word after the other
    n_grams: np.ndarray
    live: np.ndarray

    @classmethod
    def of(cls, texts: Iterable[str | None]) -> Bags:
        """Texts are taken one by one and never held together; n-grams are made some thousand words at a time."""
        index: dict[str, int] = {}
        words = [np.array([index.setdefault(w, len(index)) for w in (clean(t) for t in tokens(text)) if w], np.int32) for text in texts]
        grams, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        every = iter(index)
        while some := list(itertools.islice(every, 20_000)):
            bucket, owner = subwords(some)
            grams.append(bucket[np.argsort(owner, kind="stable")])
            sizes.append(np.bincount(owner, minlength=len(some)))
        grams, n_grams = np.concatenate(grams), np.concatenate(sizes)
        starts, docs_of_gram = runs(n_grams), np.zeros(BUCKETS, np.int32)
        for own in words:
            if len(own):
                some = np.unique(own)
                docs_of_gram[np.unique(grams[spread(starts[some], n_grams[some])])] += 1
        return cls(words, grams, n_grams, docs_of_gram >= LEAST_DOCS)

    def batch(self, docs: np.ndarray) -> dict:
        """The distinct words of some documents and how words, segments and documents follow from them."""
        every = np.concatenate([self.words[d] for d in docs])
        some, place = np.unique(every, return_inverse=True)
        n = self.n_grams[some]
        sizes = [np.diff(np.append(np.arange(0, len(self.words[d]), SEGMENT), len(self.words[d]))) for d in docs]
        return {
            "grams": self.grams[spread(self.starts[some], n)],
            "n_grams": n,
            "place": place,
            "n_words": np.concatenate(sizes),
            "n_segments": np.array([len(x) for x in sizes]),
        }

    def __post_init__(self):
        self.starts = runs(self.n_grams)


def forward(vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of segments, and the toxic column's lead in each."""
    of_word = means(vectors[b["grams"]], b["n_grams"])
    segments = means(of_word[b["place"]], b["n_words"])
    logits = segments @ layer + bias
    return segments, logits[:, 1] - logits[:, 0]


def softmax(lead: np.ndarray) -> np.ndarray:
    """The toxic column's part of the softmax over both."""
    return 1 / (1 + np.exp(-np.clip(lead, -30, 30)))


def train(texts: Iterable[str | None], marks: list[int], seed: int = 7) -> Model:
    """Fit the n-gram vectors and the layer together; the epoch that does best on a fifth left out is kept.

    ``marks`` may fill as texts are taken.

    Without both labels there is nothing to learn: the model then gives every text the same score.
    """
    bags = Bags.of(texts)
    y = np.array(marks, int)
    if not len(y) or y.min() == y.max():
        return blank()
    full = np.array([len(w) > 0 for w in bags.words])
    if not (full & (y > 0)).any() or not (full & (y == 0)).any():
        return blank()
    rng = np.random.default_rng(seed)
    check = full & (rng.random(len(y)) < 0.2) if min(y.sum(), len(y) - y.sum()) >= 20 else np.zeros(len(y), bool)
    fit_on = np.flatnonzero(full & ~check)
    check = np.flatnonzero(check) if check.any() else fit_on
    share = y[fit_on].mean()
    weight = np.where(y > 0, TOXIC_WEIGHT / max(share, 1e-9), (1 - TOXIC_WEIGHT) / max(1 - share, 1e-9))

    vectors = (rng.normal(0, 1 / DIM, (BUCKETS, DIM)) * bags.live[:, None]).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    # Adagrad: what has moved much moves less; an n-gram's dimensions share one speed
    seen = [np.full(BUCKETS, 1e-6, np.float32), np.full(layer.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
    best, kept, top = np.inf, None, None
    checks = [bags.batch(check[a : a + BATCH]) for a in range(0, len(check), BATCH)]
    passes = max(1, -(-STEPS * BATCH // len(fit_on)))
    for sharp in SHARP:
        order = np.concatenate([rng.permutation(fit_on) for _ in range(passes)])
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            b = bags.batch(docs)
            segments, lead = forward(vectors, layer, bias, b)
            n = b["n_segments"]
            first, doc = runs(n), np.repeat(np.arange(len(docs)), n)
            most = np.maximum.reduceat(lead, first)
            pick_ = np.exp(np.clip(sharp * (lead - most[doc]), -60, 0))
            pick_ /= np.add.reduceat(pick_, first)[doc]
            pooled = np.add.reduceat(pick_ * lead, first)
            toxic = y[docs] > 0
            # a toxic document pulls up the segments picked; a clean one pushes down all, its worst the most
            error = weight[docs] * (softmax(pooled) - toxic)
            slope = np.where(toxic[doc], error[doc] * pick_, weight[docs][doc] * softmax(lead) * (0.5 * pick_ + 0.5 / n[doc])) / len(docs)
            on_logits = np.stack([-slope, slope], axis=1).astype(np.float32)
            on_segments = on_logits @ layer.T
            on_words = np.zeros((len(b["n_grams"]), DIM), np.float32)
            each = np.repeat(on_segments / b["n_words"][:, None], b["n_words"], axis=0)
            for j in range(DIM):
                on_words[:, j] = np.bincount(b["place"], each[:, j], minlength=len(on_words))
            on_words /= b["n_grams"][:, None]
            moved, slot = np.unique(b["grams"], return_inverse=True)
            owner = np.repeat(np.arange(len(on_words)), b["n_grams"])
            on_grams = np.stack([np.bincount(slot, on_words[owner, j], minlength=len(moved)) for j in range(DIM)], axis=1).astype(np.float32)
            on_grams *= bags.live[moved, None]
            seen[0][moved] += (on_grams**2).mean(axis=1)
            vectors[moved] -= RATE * on_grams / np.sqrt(seen[0][moved])[:, None]
            for value, grad, total in ((layer, segments.T @ on_logits, seen[1]), (bias, on_logits.sum(axis=0), seen[2])):
                total += grad**2
                value -= 0.2 * RATE * grad / np.sqrt(total)
        leads = np.concatenate([np.maximum.reduceat(forward(vectors, layer, bias, b)[1], runs(b["n_segments"])) for b in checks])
        a, c = calibrated(leads, y[check])
        loss = -np.log(np.clip(np.where(y[check] > 0, softmax(a * leads + c), 1 - softmax(a * leads + c)), 1e-6, 1))
        now = (loss * weight[check]).sum() / weight[check].sum()
        if now < best:
            best, kept, top = now, (vectors.copy(), layer.copy(), bias.copy()), (a, c)
    vectors, layer, bias = kept
    # the calibration goes into the layer, so the softmax itself gives the score
    return Model(vectors, layer * top[0], bias.astype(float) * top[0] + np.array([0.0, top[1]]))


def calibrated(lead: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make a most toxic segment's lead a probability; smoothed targets keep both finite."""
    pos, neg = (y > 0).sum(), (y == 0).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = softmax(a * lead + c)
        g, h = p - goal, p * (1 - p) + 1e-9
        m = np.array([[(h * lead * lead).sum() + 1e-3, (h * lead).sum()], [(h * lead).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, np.array([(g * lead).sum(), g.sum()]))
        scale = min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, c = max(a - scale * step[0], 1e-3), c - scale * step[1]
    return float(a), float(c)


def scorer(model: Model):
    """texts -> scores, with a bounded cache of words kept by the worker."""
    known: dict[str, float] = {}
    pull, lean = model.pull(), model.lean

    def score(texts: list[str | None]) -> np.ndarray:
        per = [tokens(t) for t in texts]
        new = list({t for ts in per for t in ts if t not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list({t for ts in per for t in ts})
        if new:
            stems = [clean(t) for t in new]
            values = word_logits(pull, stems)
            known.update(zip(new, (v if s else None for v, s in zip(values.tolist(), stems)), strict=True))
        out = np.empty(len(texts))
        for i, ts in enumerate(per):
            own = np.array([v for v in map(known.__getitem__, ts) if v is not None], float)
            if not len(own):
                out[i] = np.nan
                continue
            at = np.arange(0, len(own), SEGMENT)
            mean = np.add.reduceat(own, at) / np.diff(np.append(at, len(own)))
            out[i] = mean.max() + lean
        return np.where(np.isnan(out), 0.0, softmax(out))

    return score


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def drawn(docs: DataFrame, labels: DataFrame, toxic: int, clean: int, most_bytes: int) -> list[tuple[int, int]]:
    """(doc_id, toxic) of the documents to learn from, in the order of a hash of the id."""
    marks = pick(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    sizes = pick(docs, "doc_id", "text").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    both = marks.join(sizes, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("n").alias("n"))
    out = []
    for label, most in ((1, toxic), (0, clean)):
        rows = both.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
        total = itertools.accumulate(r["n"] for r in rows)
        out += [(r["doc_id"], label) for i, (r, t) in enumerate(zip(rows, total, strict=True)) if t <= most_bytes // 2 or i == 0]
    return out


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 2000, clean: int = 4000, most_bytes: int = 48 << 20) -> Model:
    """Learn from at most so many labelled documents of each label and so many bytes of text.

    Documents are drawn in the order of a hash of the id, the same at every input size, and used
    whole; training runs in one task, and the driver gets the model alone. Held-out rows, null
    labels and null ids are left out. Rows of one id count once, with the least of their texts;
    of its labels the greater counts. Empty tables give a model that scores all texts alike.
    """
    ids = drawn(docs, labels, toxic, clean, most_bytes)
    if not ids:
        return blank()
    spark = docs.sparkSession
    # at most toxic + clean rows of two integers
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))
    rows = pick(docs, "doc_id", "text").join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def rows_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))

    def learn(parts) -> Model | None:
        marks: list[int] = []

        def texts():
            for mark, text in itertools.chain.from_iterable(parts):
                marks.append(mark)
                yield text

        m = train(texts(), marks)
        return m if marks else None

    def run(batches):
        remember("training", list)  # nothing; what others know need not stand in two processes
        if m := in_child(learn, rows_of(batches)):
            cells = [m.vectors.astype("<f4").tobytes(), m.layer.astype("<f8").tobytes(), m.bias.astype("<f8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["vectors", "layer", "bias"])

    with sparing(spark):
        found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "vectors binary, layer binary, bias binary").collect()
    if not found:
        return blank()
    v, layer, bias = found[0]
    return Model(np.frombuffer(v, "<f4").reshape(BUCKETS, DIM), np.frombuffer(layer, "<f8").reshape(DIM, 2), np.frombuffer(bias, "<f8"))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, in one pass without a shuffle.

    Null, empty and word-free texts score 0. Repeated rows are scored each for itself; an empty
    table gives none. A long text is scored whole, by its most toxic segment.
    """
    made: list = []

    def step(cols: dict[str, list]) -> dict[str, list]:
        if not made:
            remember("toxicity", list)
            made.append(scorer(model))
        return {"doc_id": cols["doc_id"], "score": made[0](cols["text"]).tolist()}

    out = map_rows(pick(docs, "doc_id", "text"), step, "doc_id long, score double", after=made.clear)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows that score below the threshold, all columns kept, whatever their names.

    Null, empty and word-free texts stay; repeated rows stay or go together; an empty table stays one.
    """
    made: list = []
    flat, at = by_place(docs)

    def step(cols: dict[str, list]) -> dict[str, list]:
        if not made:
            remember("toxicity", list)
            made.append(scorer(model))
        fine = (made[0](cols[at["text"]]) < threshold).tolist()
        return {c: list(itertools.compress(v, fine)) for c, v in cols.items()}

    return named(map_rows(flat, step, flat.schema, at["text"], after=made.clear), docs.columns)
