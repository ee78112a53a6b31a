"""Exact top-k by inner product: norms descending, SVD-rotated partial sums, Cauchy-Schwarz bounds.

The rows are numbered and dealt by ranges of falling length, so that blocks, in the order of their
numbers, are the table sorted by length. The first block, the longest vectors of all, gives every
query a floor that its k-th best cannot fall below. Then the work is a grid of cells: a cell holds
one group of queries (of bounded size) and takes one group of blocks as a stream, longest first.
Once length times length cannot reach a query's floor, no later vector of the cell can. For those
that might, the inner product over the leading rotated coordinates plus the product of what is left
of both lengths bounds the whole; only survivors are multiplied out, in whole numbers. Cells are
dealt by their own number, so no key gathers more than one cell.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick, settle

#: Bytes of vectors in a block, and of a group of queries that a cell holds.
BLOCK_BYTES, GROUP_BYTES = 2 << 20, 32 << 20
CHUNK = 512
LEAD = 16
#: Rotations and first blocks are made for so many dimensions, the most frequent ones, up to such a
#: dimension: both go to the driver. Other dimensions are searched by lengths and plain coordinates.
DIMS, MOST_DIM = 8, 1024
NONE = -(1 << 62)
LAST = np.iinfo(np.int64).max
PACKED = "dim int, block long, n int, n_asked int, rows binary, ids binary, asked binary, vectors binary"
ASKED = "dim int, block long, rows binary, ids binary, vectors binary, floors binary"
FOUND = "query_row long, query_id long, vec_id long, score long"


def usable(df: DataFrame, asked: Column) -> DataFrame:
    """row, vec_id, asked, v, size: whole-number vectors under a number of their own.

    Without null ids, null or empty vectors and null or non-finite components.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = pick(df, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.coalesce(asked, F.lit(False)).alias("asked"), v.alias("v"))
    return rows.withColumn("size", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of bounded size as one row each; their numbers rise as lengths fall. Equal lengths spread by row."""

    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            v = batch.column(at["v"])
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            row, ids = batch.column(at["row"]).to_numpy(), batch.column(at["vec_id"]).to_numpy().astype(np.int64)
            asked = batch.column(at["asked"]).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                most = max(1, BLOCK_BYTES // (8 * dim))
                for a in range(0, len(own), most):
                    some = own[a : a + most]
                    vectors = flat[starts[some][:, None] + np.arange(dim)]
                    held.setdefault(dim, []).append((row[some], ids[some], asked[some], vectors))
                    if sum(len(h[0]) for h in held[dim]) >= most:
                        yield pack(dim, base + made, held.pop(dim))
                        made += 1
        for dim, parts in held.items():
            yield pack(dim, base + made, parts)
            made += 1

    def pack(dim: int, number: int, parts: list) -> pa.RecordBatch:
        row, ids, asked, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        cells = [dim, number, len(row), int(asked.sum()), row.tobytes(), ids.tobytes(), asked.tobytes(), vectors.astype(np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, TYPES, strict=True)], names=NAMES)

    dealt = rows.repartitionByRange(F.col("size").desc(), F.col("row")).sortWithinPartitions(F.col("size").desc(), "row")
    return dealt.mapInArrow(run, PACKED)


NAMES = [c.split()[0] for c in PACKED.split(", ")]
TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]


def vectors_of(r: dict) -> np.ndarray:
    return np.frombuffer(r["vectors"], np.int64).reshape(-1, r["dim"])


def rotation(blocks: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """For each of ``dims`` the right singular vectors of all its rows, by their summed products.

    Blocks are summed before the shuffle and again after it; the driver gets at most DIMS matrices
    of at most MOST_DIM columns. Any rotation gives exact results, this one prunes most.
    """

    def gram(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                v = vectors_of(r).astype(float)
                total[r["dim"]] = total.get(r["dim"], 0) + v.T @ v
        for dim, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(g.tolist(), pa.list_(pa.float64()))], names=["dim", "i", "row"])

    def added(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, i, row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                total[dim, i] = total.get((dim, i), 0) + np.array(row)
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))],
                names=["dim", "i", "row"],
            )

    schema = "dim int, i int, row array<double>"
    some = blocks.filter(F.col("dim").isin(dims)).select("dim", "vectors")
    rows = some.mapInArrow(gram, schema).repartition(8, "dim", "i").mapInArrow(added, schema).collect()
    grams = {dim: np.zeros((dim, dim)) for dim in {r[0] for r in rows}}
    for r in rows:
        grams[r[0]][r[1]] += np.array(r[2])
    return {dim: np.ascontiguousarray(np.linalg.eigh(g)[1][:, ::-1]) for dim, g in grams.items()}


class Search:
    """The k best candidates of some queries of one dimension, fed block by block, longest first."""

    def __init__(self, rows: np.ndarray, q: np.ndarray, k: int, turn: np.ndarray | None, floors: np.ndarray | None = None):
        self.rows, self.q, self.k, self.turn = rows, q, k, turn
        self.qr = self.turned(q)
        self.all, self.rest = self.lengths(q, self.qr)
        self.best = np.full((len(q), k), NONE)
        self.ids = np.full((len(q), k), LAST)
        self.floor = np.full(len(q), NONE) if floors is None else floors
        self.open = np.arange(len(q))

    def turned(self, v: np.ndarray) -> np.ndarray:
        """The leading rotated coordinates; the plain ones where the dimension has no rotation."""
        return v[:, :LEAD].astype(float) if self.turn is None else v @ self.turn[:, :LEAD]

    @staticmethod
    def lengths(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = (v.astype(float) ** 2).sum(axis=1)
        return np.sqrt(whole), np.sqrt(np.maximum(whole - (r**2).sum(axis=1), 0))

    def least(self) -> np.ndarray:
        return np.maximum(self.best[self.open, self.k - 1], self.floor[self.open]).astype(float)

    def feed(self, rows: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        if not len(self.open):
            return
        cr = self.turned(c)
        c_all, c_rest = self.lengths(c, cr)
        for a in range(0, len(c), CHUNK):
            b = min(a + CHUNK, len(c))
            # rounding of doubles stays far below one part in 10^9 of length times length
            slack = 1e-6 + 1e-9 * self.all[self.open] * c_all[a]
            self.open = self.open[self.all[self.open] * c_all[a] + slack >= self.least()]  # no later vector is longer
            if not len(self.open):
                return
            o = self.open
            bound = self.qr[o] @ cr[a:b].T + np.outer(self.rest[o], c_rest[a:b])
            bound += 1e-6 + 1e-9 * self.all[o, None] * c_all[a]
            may = (bound >= self.least()[:, None]) & (self.rows[o][:, None] != rows[None, a:b])
            for j in np.flatnonzero(may.any(axis=1)):
                some = a + np.flatnonzero(may[j])
                i = o[j]
                score = np.concatenate([self.best[i], c[some] @ self.q[i]])
                own = np.concatenate([self.ids[i], ids[some]])
                order = np.lexsort((own, -score))[: self.k]
                self.best[i], self.ids[i] = score[order], own[order]


def topk(vectors: DataFrame, asked: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each asked row the k other rows of highest inner product.

    ``asked`` is a condition on vec_id. Components are floor(256 * x). Ties go to the smaller vec_id.
    A row is no candidate of its own, but a row that repeats it is, and a repeated query asks again.
    Rows with a null id, a null or empty vector or a null or non-finite component take no part; a
    vector of another dimension than a query's is no candidate of it. Fewer than k candidates give
    fewer rows, an empty table none. Sums must fit 64 bits.
    """
    blocks, drop_blocks = settle(packed(usable(vectors, asked)))
    sums = blocks.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("n_asked") * F.col("dim") * 8).alias("bytes"))
    frequent = sums.filter(F.col("dim") <= MOST_DIM).orderBy(F.col("n").desc(), "dim").limit(DIMS)
    dims = [r[0] for r in frequent.collect()]
    asked_bytes = sums.agg(F.sum("bytes")).first()[0] or 0
    turns = rotation(blocks, dims) if dims else {}
    # at most DIMS blocks of BLOCK_BYTES
    firsts = blocks.filter(F.col("dim").isin(dims)).groupBy("dim").agg(F.min("block").alias("block")) if dims else None
    heads = {r["dim"]: r for r in (x.asDict() for x in blocks.join(F.broadcast(firsts), ["dim", "block"]).collect())} if dims else {}

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                flag = np.frombuffer(r["asked"], bool)
                rows, ids, v = np.frombuffer(r["rows"], np.int64)[flag], np.frombuffer(r["ids"], np.int64)[flag], vectors_of(r)[flag]
                s = Search(rows, v, k, turns.get(r["dim"]))
                if head := heads.get(r["dim"]):
                    s.feed(np.frombuffer(head["rows"], np.int64), np.frombuffer(head["ids"], np.int64), vectors_of(head))
                cells = [r["dim"], r["block"], rows.tobytes(), ids.tobytes(), v.tobytes(), s.best[:, k - 1].tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], t) for c, t in zip(cells, [pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)], names=[x.split()[0] for x in ASKED.split(", ")]
                )

    # groups of queries by memory; groups of blocks only as many as keep the cluster busy: each costs one more copy of the queries
    groups = max(1, -(-asked_bytes // GROUP_BYTES))
    slots = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    streams = max(1, -(-slots // groups))
    mine, other = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64("block"), F.lit(streams)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("binary")
    questions = blocks.filter("n_asked > 0").mapInArrow(ask, ASKED)
    questions = questions.select(mine.alias("g"), each(streams).alias("h"), F.lit(0).alias("side"), "dim", "block", "rows", "ids", "vectors", "floors")
    streamed = blocks.select(each(groups).alias("g"), other.alias("h"), F.lit(1).alias("side"), "dim", "block", "rows", "ids", "vectors", none.alias("floors"))
    cells = questions.unionByName(streamed).repartition(groups * streams, "g", "h").sortWithinPartitions("g", "h", "side", "block")

    def run(batches):
        rows = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows))
        for _, own in itertools.groupby(rows, key=lambda r: (r["g"], r["h"])):
            held: dict[int, list] = {}
            searches: dict[int, tuple[np.ndarray, Search]] | None = None
            for r in own:
                numbers, ids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
                if r["side"] == 0:
                    held.setdefault(r["dim"], []).append((numbers, ids, vectors_of(r), np.frombuffer(r["floors"], np.int64)))
                    continue
                if searches is None:
                    searches = {}
                    for dim, parts in held.items():
                        q_rows, q_ids, q, floors = (np.concatenate(x) for x in zip(*parts, strict=True))
                        searches[dim] = q_ids, Search(q_rows, q, k, turns.get(dim), floors)
                if r["dim"] in searches:
                    searches[r["dim"]][1].feed(numbers, ids, vectors_of(r))
            for q_ids, s in (searches or {}).values():
                real = s.ids != LAST
                yield pa.RecordBatch.from_pydict({"query_row": np.repeat(s.rows, k)[real.ravel()], "query_id": np.repeat(q_ids, k)[real.ravel()], "vec_id": s.ids[real], "score": s.best[real]})

    # each cell gives at most k rows a query; Spark cuts them to k before the shuffle too. Written, so that the blocks can go
    found, _ = settle(cells.mapInArrow(run, FOUND))
    drop_blocks()
    best = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
