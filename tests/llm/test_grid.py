"""The grid range join, by itself and as the source of the pipeline's candidates."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from palimpsest.llm import common, grid, similar


def test_join_rows_are_narrow(spark):
    """Both sides of the join are the same two longs, so that one shuffle serves both; cells of different grids never meet."""
    fps = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 40).tolist()
    points = spark.createDataFrame([(x,) for x in fps], "fp long")
    cells = grid.cells_of(points, 4)
    assert cells.dtypes == [("fp", "bigint"), ("cell", "bigint")] and cells.count() == 70 * len(fps)
    chosen = {r["c"]: r["n"] for r in cells.groupBy(grid.chosen_of(F.col("cell")).alias("c")).agg(F.count("*").alias("n")).collect()}
    assert len(chosen) == 70 and set(chosen.values()) == {len(fps)} and {c.bit_count() for c in chosen} == {4}


def test_pipeline_candidates_from_the_grid(spark, monkeypatch):
    """The stage's candidates come from the grid range join of SimHash fingerprints: near copies are found where no member of their sets is used."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = [word(400) for _ in range(12)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join([*t, "one", "more"])) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alone = lambda keyed, similarity, crowded: keyed.sparkSession.createDataFrame([], "a long, b long, band long")
    monkeypatch.setattr(similar, "thin_pairs", alone)
    assert sorted(r["doc_id"] for r in p.drop_near_duplicates(spark, docs, "").collect()) == list(range(12))


def test_grid_pairs(spark):
    fps = [(0, 5), (1, 5), (2, 7), (3, -1), (4, 5)]
    points = spark.createDataFrame(fps, "id long, fp long")
    for most in (10, 0):
        assert sorted(tuple(r) for r in similar.grid_pairs(points, 4, most).collect()) == [(0, 1), (0, 2), (0, 4)]


def test_cells_are_never_broadcast(spark):
    """Spark takes the cells for no more than their fingerprints, of which there are 70 times fewer; sent to all executors they fill the driver."""
    rng = np.random.default_rng(7)
    far = rng.integers(-(2**63), 2**63 - 1, 400).tolist()
    near = [x ^ 1 for x in far[:50]]
    points = spark.createDataFrame([(x,) for x in {*far, *near}], "fp long").repartition(2)
    for more, sides in (((), 0), ((40, 10**6), 3), ((40, 0), 0)):
        found = grid.links(points, 4, *more)
        assert {(min(a, b), max(a, b)) for a, b in zip(far, near, strict=False)} <= {tuple(r) for r in found.collect()}
        # Only the crowded cells, by which cells are ruled out on both sides and taken for blocks, may be sent.
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= sides


def test_few_rows_are_broadcast(spark):
    """Above the bound a join is by a shuffle even where Spark takes the table for small."""
    left, right = spark.range(100), spark.range(50).withColumn("x", F.col("id"))
    for most, kind in ((50, "BroadcastHashJoin"), (49, "SortMergeJoin")):
        joined = left.join(common.small(right, most), "id")
        assert joined.count() == 50
        assert kind in joined._jdf.queryExecution().executedPlan().toString()


def test_each_link_once_in_code_that_compiles(spark):
    """Links of fingerprints that share several cells are listed once, by a condition that is small enough for Spark to compile: without falling back it was an error."""
    rng = np.random.default_rng(8)
    fps = set(rng.integers(-(2**63), 2**63 - 1, 30).tolist())
    for x in sorted(fps):
        for _ in range(6):
            fps.add(int(np.bitwise_xor.reduce([x, *(grid.signed(1 << int(b)) for b in rng.integers(0, 64, rng.integers(1, 5)))])))
    fps = sorted(fps)
    want = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert len(want) > 300
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert sorted(tuple(r) for r in grid.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4).collect()) == want
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
