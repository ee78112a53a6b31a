"""The grid of vectors: what a cell holds stays small, cells are many, results are those of all pairs."""

import numpy as np
import pytest

from docgrade.operators import vectors as V
from docgrade.plans import layout


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (60, 4)).astype(float)  # few directions: many ties, and zero vectors
    v[7] = 0
    return v, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>")


def all_pairs(v):
    length = np.linalg.norm(v, axis=1)
    u = v / np.where(length == 0, 1, length)[:, None]
    return u @ u.T


def test_neighbours_are_those_of_all_pairs(spark, some, monkeypatch):
    v, df = some
    sims = np.round(all_pairs(v), 9)
    for tile, block in ((1024, 1 << 19), (4, 256)):
        monkeypatch.setattr(V, "TILE", tile)
        monkeypatch.setattr(V, "BLOCK_BYTES", block)
        for k in (1, 3, 70):
            got = sorted((r.query, r["rank"], r.seed) for r in V.neighbours(df, df, "id", "v", k, other_only=True).collect())
            best = [[j for j in np.lexsort((np.arange(60), -sims[i])) if j != i][:k] for i in range(60)]
            assert got == [(i, n + 1, j) for i, js in enumerate(best) for n, j in enumerate(js)]
        pairs = sorted((r.a, r.b) for r in V.near_duplicates(df, "id", "v", 0.9).collect())
        assert pairs == [(i, j) for i in range(60) for j in range(i + 1, 60) if all_pairs(v)[i, j] >= 0.9 - 1e-12]


def test_small_tables_meet_in_many_tasks_and_small_batches(spark, some):
    _, df = some
    spark.conf.unset(layout.BATCH)
    nothing = lambda stream, held, *_: iter(())
    assert V.grid(df, df, "id", "v", nothing, "a long", same=True).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert int(spark.conf.get(layout.BATCH)) <= 8 << 20


def test_only_what_seeds_leave_undecided_meets_itself(spark, some, monkeypatch):
    v, df = some
    seeds, asked = df.filter("id < 20"), []
    monkeypatch.setattr(V, "near_duplicates", lambda vectors, *a, **k: asked.append(vectors) or whole(vectors, *a, **k))
    got = {r.id: r.verdict for r in V.greedy_distinct(df.withColumn("place", -df.id), seeds, "id", "v", "place", 0.95).collect()}
    sims, taken, want = np.round(all_pairs(v), 9), [], {}
    for i in range(59, -1, -1):
        want[i] = "existing" if i < 20 else "near_seed" if (sims[i, :20] >= 0.95).any() else "near_added" if (sims[i, taken] >= 0.95).any() else "added"
        taken += [i] * (want[i] == "added")
    assert got == want and set(got.values()) == {"existing", "near_seed", "near_added", "added"}
    assert {r.id for r in asked[0].collect()} == {i for i, x in got.items() if x in ("added", "near_added")}


whole = V.near_duplicates


def test_records_are_graded_once_for_propagation(spark):
    from docgrade.plans.lifecycle import propagated

    plan = propagated(spark, "/root/testdata/sf0.001").select("doc_id", "outcome", "security.grade")
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
    assert sum("FileScan parquet" in x and "text" in x.split("Batched")[0] for x in final.splitlines()) == 1
