"""What the training-data operators share: reading, column picking, shared storage.

Conventions of every operator here:

* a null text counts as the empty text unless its docstring says otherwise;
* columns are picked by exact name, so extra columns never clash, whatever their case;
* rows are never dropped for their size: a long text is processed whole.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import multiprocessing
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own removal of shuffle files when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch between Spark and a Python worker: both ends and the way between hold some at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
SPARING = {
    CLEANUP: "true",
    BATCH: str(8 << 20),
    # rows that a reader decodes at once, each text of them; a column of arrays is read row by row, since its rows may be large
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
    "spark.sql.parquet.enableNestedColumnVectorizedReader": "false",
}
LEAN = (BATCH, "spark.sql.parquet.columnarReaderBatchSize")
#: Bytes that a writer of a settled table, and a reader after it, holds at once for each task.
ROW_GROUP = 16 << 20
#: Characters of text that one step of a Python worker holds at once.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, by exact case; safe when other columns differ only in case."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"no column {missing} among {df.columns}")
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{at[n]}").alias(n) for n in names])


#: What the operator that this worker ran last remembers from task to task: its name and the way to forget it.
_remembered: list[tuple[str, Callable[[], None]]] = []


def remember(owner: str, forget: Callable[[], None]) -> None:
    """Workers live on from operator to operator: what another one remembered goes before this one's words come."""
    if _remembered and _remembered[0][0] == owner:
        return
    for _, before in _remembered:
        before()
    _remembered[:] = [(owner, forget)]
    tidy()


def tidy() -> None:
    """Give back what this worker has freed; it lives on, idle or in another task, beside the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(
    df: DataFrame,
    step: Callable[[dict[str, list]], dict[str, list]],
    schema: str | object,
    text: str = "text",
    after: Callable[[], None] = list,
) -> DataFrame:
    """``step`` over lists of column values, a bounded number of characters at a time.

    ``step`` may return any number of rows; ``after`` drops what it has kept, at the task's end.
    Empty partitions call no step.
    """
    schema_ = schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                out = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        after()
        tidy()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = schema_ if isinstance(schema_, StructType) else _parse_datatype_string(schema_)
    arrow = to_arrow_schema(parsed)
    return df.mapInArrow(run, parsed)


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK_CHARS bytes of the text column, at least one row each."""
    import pyarrow.compute as pc

    if not batch.num_rows or text not in batch.schema.names:
        if batch.num_rows:
            yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns _c0, _c1 ... and the place of each exact name (the first, if it repeats).

    Safe where names differ only in case; ``named`` gives the names back.
    """
    places = {c: f"_c{i}" for i, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), places


def named(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns _c0, _c1 ... under their own names."""
    return df.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only in local mode where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        at = context._jsc.sc().getCheckpointDir()
        if at.isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: a cluster's executors share no temporary folder")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="docgrade-"))
            at = context._jsc.sc().getCheckpointDir()
        found = at.get()
    return found.rstrip("/")


#: Words of 64 bits in the bitmap of ``sifted``: at most 2 MB, however many keys there are.
BITMAP = 1 << 18


def sifted(rows: DataFrame, key: Column, keys: DataFrame, own: Column) -> DataFrame:
    """The rows whose key may be among ``keys`` (a column of that table), before a join by that key decides.

    A bitmap of fixed size, filled from a hash of the keys, is broadcast: it leaves most other rows
    out while keys are few, ever fewer as they become many, and never one that belongs.
    """
    word = lambda h: F.pmod(h, F.lit(BITMAP)).cast("int")
    bit = lambda h: F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")
    h = F.xxhash64(own)
    bits = keys.select(word(h).alias("_word"), F.lit(1).cast("long").alias("_one"), bit(h).alias("_bit"))
    bits = bits.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(_one, _bit)")).alias("_bits"))
    marked = rows.withColumns({"_word": word(F.xxhash64(key)), "_bit": bit(F.xxhash64(key))})
    return marked.join(F.broadcast(bits), "_word").filter("getbit(_bits, _bit) = 1").select(*rows.columns)


#: Tables written by ``settle`` and not removed yet; those that a result still reads go when the driver ends.
_left: dict[str, Callable[[], None]] = {}


@atexit.register
def remove_left() -> None:
    for drop in list(_left.values()):
        try:
            drop()
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


@contextlib.contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """Settings for a job whose result is written or small, put back behind it."""
    before = {k: spark.conf.get(k) for k in SPARING}
    for k, v in SPARING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def lean(spark: SparkSession) -> None:
    """Small batches for the session, for results that are lazy and run when someone writes them; a smaller setting stays.

    Settings of memory alone: no result depends on them.
    """
    for k in LEAN:
        text = spark.conf.get(k)
        if int(text.rstrip("b")) > int(SPARING[k]):
            spark.conf.set(k, SPARING[k])


def in_child(work: Callable[[Iterator], object], items: Iterable) -> object:
    """``work(items)`` in a process of its own, which takes its memory with it when it ends; workers live on from task to task."""
    context = multiprocessing.get_context("fork")
    here, there = context.Pipe()

    def run() -> None:
        here.close()
        try:
            answer = True, work(iter(there.recv, None))
        except BaseException as e:  # noqa: BLE001 - told to the task, which fails
            answer = False, repr(e)
        there.send(answer)
        there.close()
        os._exit(0)

    child = context.Process(target=run)
    child.start()
    there.close()
    try:
        for item in items:
            here.send(item)
        here.send(None)
        fine, answer = here.recv()
    finally:
        here.close()
        child.join(5)
        child.kill()
    if not fine:
        raise RuntimeError(f"the child failed: {answer}")
    return answer


def settle(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing.

    The second value removes the files, for tables that nothing reads any more; what is never removed
    goes when the driver ends. Columns are written by place, so their names may clash. Shuffle files
    of the write itself are removed with it: the written table stands for them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docgrade-{uuid.uuid4().hex}"
    flat, _ = by_place(df)
    with sparing(spark):
        flat.write.option("parquet.block.size", ROW_GROUP).parquet(path)

    def drop() -> None:
        _left.pop(path, None)
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    _left[path] = drop
    return named(spark.read.schema(flat.schema).parquet(path), df.columns), drop
