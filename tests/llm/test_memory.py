"""What a worker holds at once, and what it gives back."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from docgrade.llm import common, substrings, wordhash


def test_lazy_stages_move_small_batches(spark):
    before = {k: spark.conf.get(k) for k in common.LEAN}
    try:
        corpus_pipeline.pack(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
        docs = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("word "), 2000).alias("text"))  # 20 MB in one task

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 10 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_worker_forgets_another_operators_words():
    wordhash.hashes([b"some", b"words"])
    wordhash.hashes([b"more"])
    assert len(wordhash._known) >= 3
    common.remember("another operator", list)
    assert not wordhash._known
    assert len(wordhash.hashes([b"some"])) == 1


def test_settled_tables_have_small_row_groups(spark):
    out, drop = common.settle(spark.range(400_000, numPartitions=1).select(F.concat(F.sha2(F.col("id").cast("string"), 512)).alias("x")))
    paths = [f.removeprefix("file:") for f in out.inputFiles()]
    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(p).metadata.num_row_groups for p in paths]
    assert out.count() == 400_000 and max(groups) > 1
    drop()


def test_units_are_small_rows():
    texts = ["some words " * 5_000] * 40  # 2.2 million characters
    found = list(substrings.units(texts))
    assert [i for a, b in found for i in range(a, b)] == list(range(40))
    assert max(sum(map(len, texts[a:b])) for a, b in found) <= 500_000
    assert list(substrings.units(["x" * 3_000_000])) == [(0, 1)]  # a long text is taken whole
