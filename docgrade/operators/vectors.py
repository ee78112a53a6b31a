"""Vectors: cosine, nearest neighbours, label propagation, near-duplicate and conflicting pairs.

Neighbours are found on a grid of cells: vectors travel packed as bytes, a cell holds one group of
queries of bounded size and takes seeds block by block as a stream, products are taken as matrices and
cut to the k best before anything is shuffled. A vector travels once for each group of the other side.
What a cell holds does not grow with the tables: their size makes more cells, each a task of its own.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.layout import sparing

#: Bytes of vectors, in double precision, in a block, and in the group that a cell holds.
BLOCK_BYTES, GROUP_BYTES = 1 << 19, 16 << 20
#: Rows of either side of a product.
TILE = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def unit(a: Column) -> Column:
    """L2-normalised; the zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def half(a: Column) -> Column:
    """Single to half precision and back."""

    @F.pandas_udf("array<float>")
    def rounded(s):
        return s.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))

    return rounded(a)


def dimensions(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.groupBy(F.size(column).alias("dim")).agg(F.count("*").alias("n"))


PACKED = "dim int, block long, n int, ids binary, v binary"


def packed(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """Blocks of vectors, one dimension each, in their own precision. Null ids and vectors, empty ones and null or non-finite components take no part."""
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = "float" if dict(df.dtypes)[column] == "array<float>" else "double"
    rows = df.filter(F.col(id_col).isNotNull() & (F.size(column) > 0) & whole).select(F.col(id_col).cast("long").alias("id"), F.col(column).cast(f"array<{kind}>").alias("v"))

    def run(batches):
        base, made, held = TaskContext.get().partitionId() << 32, 0, {}
        for batch in batches:
            v = batch.column(1)
            sizes, flat, ids = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(), batch.column(0).to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own, most = np.flatnonzero(sizes == dim), max(1, BLOCK_BYTES // (8 * dim))
                for a in range(0, len(own), most):
                    some = own[a : a + most]
                    held.setdefault(dim, []).append((ids[some], flat[starts[some][:, None] + np.arange(dim)]))
                    if sum(len(h[0]) for h in held[dim]) >= most:
                        yield block(dim, base + made, held.pop(dim))
                        made += 1
        for dim, parts in held.items():
            yield block(dim, base + made, parts)
            made += 1

    def block(dim: int, number: int, parts: list) -> pa.RecordBatch:
        ids, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        cells = [dim, number, len(ids), ids.astype(np.int64).tobytes(), m.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["dim", "block", "n", "ids", "v"])

    return rows.mapInArrow(run, PACKED)


def unpacked(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """ids and unit vectors in double precision; the zero vector stays as it is."""
    ids = np.frombuffer(r["ids"], np.int64)
    m = np.frombuffer(r["v"], np.float32 if len(r["v"]) == 4 * r["n"] * r["dim"] else np.float64).reshape(r["n"], r["dim"]).astype(np.float64)
    length = np.sqrt((m**2).sum(axis=1))
    m /= np.where(length == 0, 1.0, length)[:, None]
    return ids, m


def grid(held: DataFrame, streamed: DataFrame, id_col: str, column: str, visit, schema: str, same: bool = False, sized: DataFrame | None = None) -> DataFrame:
    """``visit(stream of (dim, ids, vectors), held by dim, meets itself)`` on every cell, giving record batches.

    With ``same`` both sides are one table: of two groups only one order is visited, and a group
    meets itself. ``sized`` is a table that holds all of ``held``'s vectors and is cheaper to measure.
    Groups are as many as keep each within its bytes and all cores busy: a cell is a partition.
    """
    spark = held.sparkSession
    sparing(spark)
    total = (held if sized is None else sized).select(F.sum(F.size(column).cast("long") * 8)).first()[0] or 0
    groups, slots = max(1, -(-total // GROUP_BYTES)), 2 * spark.sparkContext.defaultParallelism
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # a partition's blocks are dealt in turn, each partition from a place of its own
    own = lambda n: F.pmod(F.pmod(F.xxhash64(F.shiftright("block", 32)), F.lit(n)) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(n)).cast("int")
    keep = ["dim", "block", "n", "ids", "v"]
    if same:
        groups = max(groups, math.isqrt(2 * slots) + 1)
        rows = packed(held, id_col, column).withColumn("g", own(groups)).withColumn("o", each(groups))
        cells = rows.select(F.least("g", "o").alias("g"), F.greatest("g", "o").alias("h"), (F.col("g") > F.col("o")).cast("int").alias("side"), *keep)
        cells = cells.repartitionById(groups * (groups + 1) // 2, (F.expr("h * (h + 1) div 2") + F.col("g")).cast("int"))
    else:
        streams = max(1, -(-slots // groups))
        a = packed(held, id_col, column).select(own(groups).alias("g"), each(streams).alias("h"), F.lit(0).alias("side"), *keep)
        b = packed(streamed, id_col, column).select(each(groups).alias("g"), own(streams).alias("h"), F.lit(1).alias("side"), *keep)
        cells = a.unionByName(b).repartitionById(groups * streams, (F.col("g") * streams + F.col("h")).cast("int"))

    def run(batches):
        rows = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows))
        for (g, h), mine in itertools.groupby(rows, key=lambda r: (r["g"], r["h"])):
            parts: dict[int, list] = {}
            rest = []
            for r in mine:
                if r["side"]:
                    rest = itertools.chain([r], mine)
                    break
                parts.setdefault(r["dim"], []).append(unpacked(r))
            by_dim = {}
            while parts:
                d, p = parts.popitem()
                by_dim[d] = tuple(np.concatenate(x) for x in zip(*p, strict=True))
            p = None
            meets = same and g == h
            own_ = ((d, ids[a : a + TILE], v[a : a + TILE]) for d, (ids, v) in by_dim.items() for a in range(0, len(ids), TILE)) if meets else ()
            yield from visit(itertools.chain(own_, ((r["dim"], *unpacked(r)) for r in rest)), by_dim, meets)

    return cells.sortWithinPartitions("g", "h", "side", "block").mapInArrow(run, schema)


def neighbours(queries: DataFrame, seeds: DataFrame, id_col: str, column: str, k: int, other_only: bool = False, sized: DataFrame | None = None) -> DataFrame:
    """query, seed, sim, rank: the k most similar seeds of the query's dimension, ties (to nine digits) to the smaller id.

    other_only leaves out pairs of one id. Vectors that are null or empty or hold null or non-finite
    components take no part; the zero vector is like nothing. ``sized`` holds all of the queries' vectors.
    """

    def visit(stream, held, _):
        best = {d: (np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)) for d, (ids, _) in held.items()}
        for dim, ids, v in stream:
            if dim not in held:
                continue
            q_ids, q = held[dim]
            for a, b in itertools.product(range(0, len(q_ids), TILE), range(0, len(ids), TILE)):
                s, i = (x[a : a + TILE] for x in best[dim])
                better(s, i, q_ids[a : a + TILE], ids[b : b + TILE], q[a : a + TILE] @ v[b : b + TILE].T)
        for d, (s, i) in best.items():
            real = np.isfinite(s)
            yield pa.RecordBatch.from_pydict({"query": np.repeat(held[d][0], k)[real.ravel()], "seed": i[real], "sim": s[real]})

    def better(s, i, q_ids, ids, sims) -> None:
        """What a tile's products put among the best so far, in place: cut and ranked by nine digits, given back as they are."""
        if other_only:
            sims[q_ids[:, None] == ids[None]] = -np.inf
        least = np.round(s[:, -1], 9)
        if len(ids) > k and np.isneginf(least).any():  # not yet k: all that may be among the k best of the tile, ties included
            least = np.maximum(least, np.round(np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k], 9))
        j, at = np.nonzero(sims >= (least - 1e-9)[:, None])
        if not len(j):
            return
        rows = np.unique(j)
        row = np.concatenate([np.repeat(rows, k), j])
        all_s, all_i = np.concatenate([s[rows].ravel(), sims[j, at]]), np.concatenate([i[rows].ravel(), ids[at]])
        order = np.lexsort((all_i, -np.round(all_s, 9), row))
        # each row's first k: rows have k at least, those that they had
        first = np.searchsorted(row[order], rows)
        order = order[first[:, None] + np.arange(k)]
        s[rows], i[rows] = all_s[order], all_i[order]

    found = grid(queries, seeds, id_col, column, visit, "query long, seed long, sim double", sized=sized)
    w = W.partitionBy("query").orderBy(F.round("sim", 9).desc(), "seed")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def grade_vote(near: DataFrame, grades: DataFrame, dup: float = 0.95, min_sim: float = 0.55, min_share: float = 0.70) -> DataFrame:
    """query, method, grade, confidence: inherited from a duplicate, else voted by similarity, else none.

    Ties between grades go to the grade of the nearest neighbour.
    """
    n = near.join(grades, "seed")
    votes = n.groupBy("query", "grade").agg(F.sum(F.greatest("sim", F.lit(0.0))).alias("weight"), F.min("rank").alias("best_rank"))
    best = votes.groupBy("query").agg(
        F.sum("weight").alias("total"), F.max(F.struct(F.round("weight", 9).alias("w"), (-F.col("best_rank")).alias("r"), "grade", "weight")).alias("win")
    )
    top = n.groupBy("query").agg(F.min_by(F.struct("sim", "grade"), "rank").alias("top"))
    out = best.join(top, "query")
    share = F.when(F.col("total") > 0, F.col("win.weight") / F.col("total")).otherwise(0.0)
    method = F.when(F.col("top.sim") >= dup, "dup_inherit").when(F.col("top.sim") < min_sim, "too_far").when(share < min_share, "mixed").otherwise("knn_vote")
    return out.select(
        "query",
        method.alias("method"),
        F.when(method == "dup_inherit", F.col("top.grade")).when(method == "knn_vote", F.col("win.grade")).alias("grade"),
        F.when(method == "dup_inherit", F.col("top.sim")).when(method == "knn_vote", share).otherwise(0.0).alias("confidence"),
    )


def label_vote(near: DataFrame, labels: DataFrame, dup: float = 0.95, min_sim: float = 0.55, min_share: float = 0.25) -> DataFrame:
    """query, label, confidence: every label of a duplicate, else those with enough of the whole weight."""
    top = near.groupBy("query").agg(F.max("sim").alias("top"), F.sum(F.greatest("sim", F.lit(0.0))).alias("total"), F.min_by("seed", "rank").alias("nearest"))
    each = near.join(top, "query").filter(F.col("top") >= min_sim).join(labels, "seed").withColumn("label", F.explode("labels"))
    inherited = each.filter((F.col("top") >= dup) & (F.col("seed") == F.col("nearest"))).select("query", "label", F.col("top").alias("confidence"))
    voted = each.filter(F.col("top") < dup).groupBy("query", "label").agg((F.sum(F.greatest("sim", F.lit(0.0))) / F.max("total")).alias("confidence"))
    return inherited.unionByName(voted.filter(F.col("confidence") >= min_share))


def near_duplicates(vectors: DataFrame, id_col: str, column: str, least: float, sized: DataFrame | None = None) -> DataFrame:
    """a < b, sim: pairs of different ids of at least that similarity. Every two groups meet once. ``sized`` as for ``grid``."""

    def visit(stream, held, meets):
        for dim, ids, v in stream:
            if dim not in held:
                continue
            h_ids, h = held[dim]
            for a, b in itertools.product(range(0, len(h_ids), TILE), range(0, len(ids), TILE)):
                sims = h[a : a + TILE] @ v[b : b + TILE].T
                i, j = np.nonzero(sims >= least - 1e-12)
                x, y = h_ids[a : a + TILE][i], ids[b : b + TILE][j]
                # a group that meets itself sees each pair both ways
                some = x < y if meets else x != y
                x, y, s = x[some], y[some], sims[i, j][some]
                if len(x):
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y), "sim": s})

    # ids that repeat give a pair more than once
    return grid(vectors, vectors, id_col, column, visit, "a long, b long, sim double", same=True, sized=sized).groupBy("a", "b").agg(F.max("sim").alias("sim"))


def conflicts(pairs: DataFrame, grades: DataFrame) -> DataFrame:
    """Near pairs whose grades differ."""
    a = grades.select(F.col("seed").alias("a"), F.col("grade").alias("grade_a"))
    b = grades.select(F.col("seed").alias("b"), F.col("grade").alias("grade_b"))
    return pairs.join(a, "a").join(b, "b").filter("grade_a <> grade_b")


def chunk_windows(n: Column, size: int, overlap: int) -> Column:
    """array<struct<start,end>>: windows step by size - overlap; the one that reaches the end is the last."""
    step = size - overlap
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step))
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end")))


def greedy_distinct(candidates: DataFrame, seeds: DataFrame, id_col: str, column: str, order: str, least: float = 0.985) -> DataFrame:
    """id, verdict (added, no_vector, existing, near_seed, near_added): candidates taken in order unless
    there already or as near as ``least`` to what is there, also to one just taken.

    Candidates near a seed are found on the grid, then pairs of near candidates among those that seeds
    leave undecided: no other can be taken, so no other can stand in one's way. Only these pairs, not
    the vectors, go to the one ordered pass.
    """
    near = neighbours(candidates, seeds, id_col, column, 1).filter(F.round("sim", 9) >= least).select(F.col("query").alias(id_col), F.lit(True).alias("near_seed"))
    there = seeds.select(F.col(id_col), F.lit(True).alias("there")).distinct()
    undecided = candidates.select(id_col, column).join(there, id_col, "left_anti").join(near, id_col, "left_anti")
    pairs = near_duplicates(undecided, id_col, column, least, sized=candidates)
    both = pairs.select(F.col("a").alias(id_col), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias(id_col), F.col("a").alias("other")))
    others = both.groupBy(id_col).agg(F.collect_set("other").alias("others"))
    rows = candidates.select(id_col, F.col(order).alias("place"), F.col(column).isNull().alias("bare")).join(there, id_col, "left").join(near, id_col, "left").join(others, id_col, "left")
    base = F.when(F.col("bare"), "no_vector").when(F.col("there"), "existing").when(F.col("near_seed"), "near_seed")
    rows = rows.select(id_col, "place", "others", base.alias("verdict"))
    # those without a near candidate are decided; the rest is a list of names and their near ones
    free = rows.filter("verdict IS NOT NULL OR others IS NULL").select(id_col, F.coalesce("verdict", F.lit("added")).alias("verdict"))

    def pick(batches):
        taken: set = set()
        for batch in batches:
            out = []
            for i, near_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append("near_added" if taken.intersection(near_) else "added")
                if out[-1] == "added":
                    taken.add(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "verdict"])

    bound = rows.filter("verdict IS NULL AND others IS NOT NULL").repartition(1).sortWithinPartitions("place", id_col).select(F.col(id_col).cast("long").alias(id_col), "others")
    return free.unionByName(bound.mapInArrow(pick, f"{id_col} long, verdict string"))
