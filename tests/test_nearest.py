import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators import nearest, ranking
from evalweave.plans.queries import QUERIES

NAN, INF = math.nan, math.inf


def test_best_of_odd_vectors_as_by_all_scores(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 7)
    noise = np.random.default_rng(3)
    rows = [(i, noise.normal(size=5).astype(np.float32).astype(float).tolist(), i % 4) for i in range(400)]
    rows += [(400 + i, rows[i % 9][1], 9) for i in range(120)]
    odd = [None, [], [1.0], [1.0, None, 0.0, 2.0, 3.0], [NAN] * 5, [INF, 0.0, 1.0, 1.0, 1.0], [-INF] * 5, [3e38] * 5, [-3e38] * 5, [1e-40] * 5, [0.0] * 5, [0.5] * 6]
    rows += [(600 + i, v, None) for i, v in enumerate(odd * 2)]
    for kind in ("float", "double"):
        chunks = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
        queries = chunks.where("vec_id % 20 = 0 or vec_id >= 600").select(F.col("vec_id").alias("query_no"), F.col("embedding").alias("query"))
        for k in (3, 130, 1000):
            want = ranking.top_k(ranking.scored(chunks, queries), k, "vec_id")
            got = nearest.nearest(chunks, queries, k, "vec_id", ("label",))
            columns = ("query_no", "rank", "vec_id", "label", F.col("score").cast("string"))
            assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect())), (kind, k)
    assert nearest.nearest(chunks, queries.limit(0), 3, "vec_id").collect() == nearest.nearest(chunks.limit(0), queries, 3, "vec_id").collect() == []


def test_few_rows_are_left_and_dropped_rows_go():
    noise = np.random.default_rng(1)
    q, c = noise.normal(size=(50, 16)).astype(np.float32), noise.normal(size=(40000, 16)).astype(np.float32)
    best, asked, scored = nearest.Best(50, 10), nearest.vectors(nearest.pa.array(list(q))), 0
    plain = nearest.exact

    def counted(*args):
        nonlocal scored
        scored += len(args[2])
        return plain(*args)

    nearest.exact = counted
    try:
        for a in range(0, len(c), 2000):
            part = nearest.pa.table({"vec_id": np.arange(a, a + 2000)})
            nearest.add_block(best, asked, nearest.pa.array(list(c[a : a + 2000])), part, "vec_id")
            best.settle()
    finally:
        nearest.exact = plain
    best.compact()
    assert scored < 50 * 40000 // 200 and best.table.num_rows <= 500
    ids = best.table["vec_id"].to_numpy()[best.held[4]].reshape(50, 10)
    assert (ids == np.argsort(-(q.astype(float) @ c.T.astype(float)), axis=1)[:, :10]).all()


@pytest.mark.parametrize("name", ["a4_o3_rank_fusion", "p5_p6_filtered_vector_search", "o10_a24_clustered_display", "a3_o4_group_sum_top_files", "w8_diverse_pick", "a1_a2_w2_o2_hybrid_group_score", "o1_w1_vector_top_k"])
def test_hits_leave_their_task_as_the_best_only(spark, tmp_path, name):
    """Of all scores, only the best of each block may be written to a shuffle."""
    rows = [(i, [math.sin(i * j) for j in range(1, 9)], i % 10) for i in range(1500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "inline" not in plan


def test_fusion_ranks_once(spark, tmp_path, monkeypatch):
    rows = [(i, [math.sin(i * j) for j in range(1, 9)], i % 10) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    counted = []
    plain = type(spark.range(1)).count
    monkeypatch.setattr(type(spark.range(1)), "count", lambda df: counted.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    assert QUERIES["a4_o3_rank_fusion"](spark, str(tmp_path)).count() == 10
    assert not any("Window" in p for p in counted[:-1])


def _block(seed, queries=600, rows=10000):
    noise = np.random.default_rng(seed)
    q, c = noise.normal(size=(queries, 16)).astype(np.float32), noise.normal(size=(2 * rows, 16)).astype(np.float32)
    best = nearest.Best(queries, 10)
    asked, parts = nearest.vectors(nearest.pa.array(list(q))), [nearest.pa.array(list(c[a : a + rows])) for a in (0, rows)]
    keep = [nearest.pa.table({"vec_id": np.arange(a, a + rows)}) for a in (0, rows)]
    nearest.add_block(best, asked, parts[0], keep[0], "vec_id")
    return best, lambda: nearest.add_block(best, asked, parts[1], keep[1], "vec_id")


def test_products_stay_in_tiles():
    best, second = _block(5)
    best.settle()
    tracemalloc.start()
    try:
        second()
        assert tracemalloc.get_traced_memory()[1] < 10 << 20
    finally:
        tracemalloc.stop()


def test_only_ties_are_sorted(monkeypatch):
    best, second = _block(6)
    second()
    ordered, plain = [], np.lexsort
    monkeypatch.setattr(nearest.np, "lexsort", lambda keys: ordered.append(len(keys[0])) or plain(keys))
    best.settle()
    assert sum(ordered) == 0
    assert (np.bincount(best.held[0]) == 10).all()


def test_display_searches_once(spark, tmp_path):
    rows = [(i, [math.sin(i * j) for j in range(1, 9)], i % 10) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    plan = QUERIES["o10_a24_clustered_display"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_first_floors_leave_few_candidates(monkeypatch):
    """Of the first chunks no more than a few a query are scored, and the floors bound the k-th best score."""
    noise = np.random.default_rng(8)
    q, c = noise.normal(size=(30, 16)).astype(np.float32), noise.normal(size=(20000, 16)).astype(np.float32)
    best, lists = nearest.Best(30, 10), nearest.pa.array(list(c))
    asked, scored, plain = nearest.vectors(nearest.pa.array(list(q))), [], nearest.exact
    monkeypatch.setattr(nearest, "exact", lambda *args: scored.append(len(args[2])) or plain(*args))
    nearest.first_floors(best, asked, [lists])
    scores = np.sort(q.astype(float) @ c.T.astype(float), axis=1)[:, -10]
    assert (best.floor <= scores).all() and (best.floor > -np.inf).all()
    for a in range(0, len(c), 2000):
        nearest.add_block(best, asked, lists.slice(a, 2000), nearest.pa.table({"vec_id": np.arange(a, a + 2000)}), "vec_id")
    best.order()
    assert sum(scored) < 30 * 10 * 2
    assert (best.held[3].reshape(30, 10) == np.argsort(-(q.astype(float) @ c.T.astype(float)), axis=1)[:, :10]).all()


def test_null_scores_do_not_lower_floors():
    best = nearest.Best(1, 2)
    best.floor[:] = 0.5
    best.add(np.zeros(2, int), np.zeros(2), np.arange(2), np.arange(2), null=True)
    best.settle()
    assert best.floor[0] == 0.5


def test_blocks_and_stripes_fill_the_cores():
    for queries in (0, 1, 511, 5128, 30770, 40000, 10**6):
        for cores in (1, 4, 6, 8, 1000):
            blocks, stripes = nearest.dealt_out(queries, cores)
            assert blocks * stripes % cores == 0 and blocks * nearest.BLOCK >= queries
    assert nearest.dealt_out(30770, 8) == (8, 1) and nearest.dealt_out(250, 8) == (1, 8)


def test_marked_places():
    noise = np.random.default_rng(9)
    for shape in ((3, 7), (5, 64), (9, 130), (512, 512)):
        for part in (0.0, 0.01, 0.5, 1.0):
            mask = noise.random(shape) < part
            assert (nearest.marked(mask) == np.flatnonzero(mask)).all()


def test_blocks_give_final_ranks(spark, tmp_path, monkeypatch):
    """Where a task sees all chunks, no window ranks the hits again; the sums by file are made before the exchange."""
    noise = np.random.default_rng(4)
    rows = [(i, noise.normal(size=8).tolist(), i % 10 if i % 7 else None) for i in range(2000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {}
    for least in (10, 10**6):
        monkeypatch.setattr(nearest, "LEAST", least)
        out = QUERIES["a3_o4_group_sum_top_files"](spark, str(tmp_path))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("vec_id" in plan.split("MapInArrow")[0]) == (least > 10), plan
        found[least] = sorted(map(str, out.collect()))
    assert found[10] == found[10**6] and len(found[10]) == 500


def test_queries_of_one_number_share_their_ranks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAST", 2)
    noise = np.random.default_rng(5)
    chunks = spark.createDataFrame([(i, noise.normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    queries = chunks.where("vec_id < 40").select((F.col("vec_id") % 17).cast("string").alias("query_no"), F.col("embedding").alias("query"))
    queries = queries.withColumn("query_no", F.expr("nullif(query_no, '3')"))
    want = ranking.top_k(ranking.scored(chunks, queries), 9, "vec_id")
    got = nearest.nearest(chunks, queries, 9, "vec_id")
    assert nearest.dealt_out(40, 4)[1] == 1
    assert sorted(map(str, got.select("query_no", "rank", "score").collect())) == sorted(map(str, want.select("query_no", "rank", "score").collect()))
