"""How small tables are laid out over a cluster, and in what portions rows reach Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SMALL = 1 << 30
#: Bytes of a batch between Spark and a Python worker; the worker holds one, and often what it made of it, for each core.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def dealt(table: DataFrame, most: int = SMALL) -> DataFrame:
    """The table, dealt over all cores where its files are small.

    A file of one row group is read by one task, however many cores there are, and what is computed from its
    texts stays in that task. Moving at most ``most`` bytes is cheaper than that. Larger tables have
    row groups enough and are not moved; rows are the same either way.
    """
    if int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most:
        return table
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism)


def sparing(spark: SparkSession) -> None:
    """Small batches for the session's Python workers, for results that run when someone writes them; a smaller setting stays. No result depends on it."""
    now = int(spark.conf.get(BATCH).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
