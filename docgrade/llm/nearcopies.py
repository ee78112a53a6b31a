"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

Each document's shingles are hashed once; the hash's top bits choose a bin and each bin keeps its
least value. Empty bins borrow from a bin drawn by hashing the bin's own number again and again
until a filled one is met. Bands of bins make the buckets in which candidates meet.

In a bucket only the edges from one member, the hub, to the others are formed; the hub is the member
that shares its buckets with most documents, which in a group of copies is the text that they come
from. Edges are confirmed on the full sets and turned into components. Members of a hub's buckets
that stayed outside its component are then held against all members of those buckets, in blocks of
bounded size that give confirmed links alone; so no two documents of a bucket that are linked stay
apart, and no pairs are listed. Equal sets are one node from the start, so exact copies form no
edges at all.

A hub of many edges is salted: its members are dealt over tasks FAN at a time and its set travels
once to each, not once for each edge. Full sets move only to (hub, salt) and to pairs of blocks;
the joins by bucket, hub and class move rows of a few numbers, which adaptive execution splits where
one key holds much.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pick, settle, tidy
from .wordhash import hashes, split, windows

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
TRIES = 512
#: Documents in a block that is held against another, and members of a hub that meet its set in one task.
NODES = 256
FAN = 512
SPREAD = 32
_draws: list[np.ndarray] = []


def draws() -> np.ndarray:
    """For each bin the bins that it tries in turn when it is empty."""
    if not _draws:
        _draws.append(np.random.default_rng(2017).integers(0, BINS, (BINS, TRIES)).astype(np.int64))
    return _draws[0]


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words in a row; fewer words are one shingle; none, none."""
    h = hashes(split(text, lower=True))
    if not len(h):
        return h
    if len(h) < size:  # a length of its own keeps it apart from longer shingles
        return windows(h, len(h)) ^ np.uint64(len(h))
    return np.unique(windows(h, size))


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each bin, empty bins densified."""
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    at = np.searchsorted(s >> shift, np.arange(BINS + 1, dtype=np.uint64))
    filled = at[1:] > at[:-1]
    out = np.where(filled, s[np.minimum(at[:-1], len(s) - 1)], np.uint64(0))
    for tries in (16, TRIES):
        empty = np.flatnonzero(~filled)
        if not len(empty):
            return out
        tried = draws()[empty, :tries]
        lit = (at[1:] > at[:-1])[tried]
        first = lit.argmax(axis=1)
        found = lit.any(axis=1)
        out[empty[found]] = out[tried[np.arange(len(empty)), first][found]]
        filled = filled.copy()
        filled[empty[found]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        out[empty] = s[0]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One bucket number for each band."""
    rows = sig.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for j in range(ROWS):
        out = (out ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    def step(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n": [], "key": [], "bands": []}
        for t in cols["text"]:
            s = shingles(t, size)
            out["n"].append(len(s))
            out["key"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            out["bands"].append(bands(signature(s)) if len(s) else None)
        return out

    return map_rows(pick(docs, "doc_id", "text"), step, "doc_id long, n long, key binary, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, set: the sorted shingles of the documents named in ``nodes``."""

    def step(cols: dict[str, list]) -> dict[str, list]:
        return {"node": cols["node"], "own": [shingles(t, size).tobytes() for t in cols["text"]]}

    text = pick(docs, "doc_id", "text").withColumnRenamed("doc_id", "node")
    return map_rows(text.join(nodes.hint("shuffle_hash"), "node"), step, "node long, own binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: those edges from a hub (hub, node, salt) whose full sets agree."""

    def run(batches):
        rows = (r for batch in batches for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist())
        for (hub, _), own in itertools.groupby(rows, key=lambda r: (r["hub"], r["salt"])):
            held, found = [], set()
            for r in own:
                values = np.frombuffer(r["own"], np.uint64)
                if r["side"] == 0:
                    held.append(values)
                elif any(linked(h, values, percent) for h in held):
                    found.add(r["node"])
            if found:
                yield pa.RecordBatch.from_pydict({"a": [hub] * len(found), "b": sorted(found)}, schema=SCHEMA_LINKS)
        tidy()

    hubs = stars.select("hub", "salt").distinct().join(sets.withColumnRenamed("node", "hub"), "hub")
    hubs = hubs.select("hub", "salt", F.lit(0).alias("side"), F.col("hub").alias("node"), "own")
    members = stars.select("hub", "salt", "node").join(sets, "node").select("hub", "salt", F.lit(1).alias("side"), "node", "own")
    met = hubs.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side")
    return met.mapInArrow(run, "a long, b long")


def within(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents around the same hub that lie in different components so far.

    Around each hub, those outside its component (left) meet those inside it and each other, block
    by block; those inside are one component already and are not held against each other.
    """
    known = labels.select("node", "label")
    around = stars.select("hub", "node").unionByName(stars.select("hub", F.col("hub").alias("node")).distinct())
    around = around.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = around.groupBy("hub", "label").agg(F.count("*").alias("n"), F.max(F.col("node") == F.col("hub")).alias("own"))
    sizes = counts.groupBy("hub").agg(
        F.sum(F.when(~F.col("own"), F.col("n"))).alias("n_left"), F.sum(F.when(F.col("own"), F.col("n"))).alias("n_in"), F.max(F.when(F.col("own"), F.col("label"))).alias("hub_label")
    )
    sizes = sizes.filter("n_left > 0 AND n_left + n_in > 2").select(
        "hub", "hub_label", F.ceil(F.col("n_left") / NODES).cast("int").alias("left_blocks"), F.ceil(F.col("n_in") / NODES).cast("int").alias("in_blocks")
    )
    # what is known of each hub with some left outside, a few numbers, stands in SPREAD places, so a hub's members need not meet in one
    spread = F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int")
    sizes = sizes.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = around.withColumn("spread", spread).join(sizes, ["hub", "spread"]).drop("spread").withColumn("left", F.col("label") != F.col("hub_label"))
    left, inside = rows.filter("left"), rows.filter("NOT left")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    one = left.withColumn("i", block("left_blocks"))
    against_in = one.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("in_blocks") - 1)))
    against_left = one.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)))
    asked = against_in.selectExpr("hub", "0 AS kind", "i", "j", "0 AS side", "node", "label")
    asked = asked.unionByName(
        against_left.selectExpr("hub", "1 AS kind", "least(i, k) AS i", "greatest(i, k) AS j", "CAST(i > k AS INT) AS side", "node", "label")
    )
    other = inside.withColumn("j", block("in_blocks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)))
    asked = asked.unionByName(other.selectExpr("hub", "0 AS kind", "i", "j", "1 AS side", "node", "label"))
    keys = ["hub", "kind", "i", "j"]

    def run(batches):
        rows = (r for batch in batches for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist())
        for (_, kind, i, j), own in itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            nodes, labels_, values, sides = [], [], [], []
            for r in own:
                nodes.append(r["node"])
                labels_.append(r["label"])
                values.append(np.frombuffer(r["own"], np.uint64))
                sides.append(r["side"])
            found = merging(nodes, labels_, values, sides, percent, alone=kind == 1 and i == j)
            if found:
                yield pa.RecordBatch.from_pydict({"a": [x[0] for x in found], "b": [x[1] for x in found]}, schema=SCHEMA_LINKS)

    held = asked.join(sets, "node").select(*keys, "side", "node", "label", "own")
    return held.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def merging(nodes: list, labels: list, sets: list, sides: list, percent: int, alone: bool) -> list[tuple[int, int]]:
    """Confirmed links between the two sides (or within one) that join components not yet joined here."""
    up: dict = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    right = [k for k in range(len(nodes)) if alone or sides[k] == 1]
    if not right:
        return []
    sizes = np.array([len(sets[k]) for k in right])
    owner = np.repeat(np.arange(len(right)), sizes)
    every = np.concatenate([sets[k] for k in right])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    out = []
    for k in range(len(nodes)):
        if not alone and sides[k] != 0:
            continue
        s = sets[k]
        a, b = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(right))
        for m in np.flatnonzero((both > 0) & (100 * both >= percent * (len(s) + sizes - both))).tolist():
            x, y = root(labels[k]), root(labels[right[m]])
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((nodes[k], nodes[right[m]]))
    return out


SCHEMA_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def components(edges: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """node, label: the least node that can be reached, for every node with an edge.

    Labels fall to the least label next to them and then to their label's own label, until none
    falls any more; each round is written to the shared folder.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels, drop = settle(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("m"))
        fallen, drop_fallen = settle(labels.join(near, "node").select("node", "label", F.least("label", "m").alias("now")))
        jump = fallen.select(F.col("node").alias("now"), F.col("now").alias("further"))
        after, drop_after = settle(fallen.join(jump, "now", "left").select("node", F.col("label").alias("was"), F.least("now", F.coalesce("further", "now")).alias("label")))
        still = after.filter("label < was").limit(1).count()
        drop()
        drop_fallen()
        labels, drop = after.select("node", "label"), drop_after
        if not still:
            return labels, drop


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Documents are linked if 100 * |A and B| >= percent * |A or B| over their sets of ``size``-word
    shingles; component_id is the smallest doc_id that links reach. Null, empty and word-free texts
    have no shingles and are linked with nothing. Rows of one id are one document, linked with what
    any of their texts is linked with. A row without an id is linked with nothing and kept; its
    component_id is null. An empty table gives none. A long text counts whole.
    """
    sketch, drop_sketch = settle(sketches(docs, size))
    known = sketch.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    least = known.groupBy("key").agg(F.min("doc_id").alias("node"))
    # texts without words and rows without an id have no class; they never meet under one null key
    alone = sketch.filter("key IS NULL OR doc_id IS NULL").select("doc_id", "n", F.lit(None).cast("long").alias("node"))
    classes, _ = settle(known.select("doc_id", "n", "key").join(least, "key").select("doc_id", "n", "node"))
    # by key and id: a class of copies keeps its bands with its first document alone
    first = known.join(least.withColumnRenamed("node", "doc_id"), ["key", "doc_id"]).dropDuplicates(["key", "doc_id"])
    members = first.select(F.col("doc_id").alias("node"), "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets, drop_buckets = settle(members.join(shared, "bucket"))
    central = buckets.groupBy("node").agg(F.sum("size").alias("score"))
    sets, drop_sets = settle(sets_of(docs, central.select("node"), size))
    hubs = buckets.join(central, "node").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("first"), "n")).alias("h"))
    hubs = hubs.select("bucket", (-F.col("h.first")).alias("hub"), F.col("h.n").alias("hub_n"))
    stars = buckets.join(hubs, "bucket").filter("node <> hub").groupBy("hub", "node", "n", "hub_n").agg(F.max("size").alias("size"))
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / FAN)).cast("int")
    stars, drop_stars = settle(stars.select("hub", "node", "n", "hub_n", salt.alias("salt")))
    drop_buckets()
    near = stars.filter(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    links, drop_links = settle(confirmed(near, sets, percent))
    inner, drop_inner = components(links)
    more, drop_more = settle(within(stars, inner, sets, percent))
    drop_inner()
    labels, _ = components(links.unionByName(more))
    alone, _ = settle(alone)
    for drop in (drop_sets, drop_stars, drop_links, drop_more, drop_sketch):
        drop()
    rows = classes.join(labels, "node", "left").select("doc_id", "n", F.coalesce("label", "node").alias("component_id"))
    rows = rows.unionByName(alone.select("doc_id", "n", F.col("doc_id").alias("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
