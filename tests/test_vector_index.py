"""The trained index against exact search, its append, and the stored vectors by symbol."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockyard.operators import vector_index as vi
from stockyard.operators.retrieval import cosine_topk
from stockyard.operators.vector_store import VectorStore


def embeddings(spark, sf="sf0.1"):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    return e, e.where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id"))


def test_recall_and_share_scored(spark, tmpdir_path):
    e, q = embeddings(spark)
    n = e.count()
    index = vi.VectorIndex.build(e, f"{tmpdir_path}/index")
    found = index.topk(q, k=11)
    assert vi.recall(found, cosine_topk(e, q, k=11)) >= 0.9
    scored = found.groupBy("QueryId").agg(F.max("Scored").alias("s")).agg(F.avg("s"), F.count("*")).first()
    assert scored[0] <= 0.1 * n and scored[1] == q.count()
    # exact scores: the same numbers as the exact search gives those pairs
    exact = {(r.QueryId, r.vec_id): r.Score for r in cosine_topk(e, q, k=n).collect()}
    assert all(exact[r.QueryId, r.vec_id] == r.Score for r in found.collect())
    assert index.rows().count() == n == index.rows().select("vec_id").distinct().count()


def test_append_does_not_train_again(spark, tmpdir_path):
    e, q = embeddings(spark)
    index = vi.VectorIndex.build(e.where("vec_id < 1500"), f"{tmpdir_path}/index")
    model = index.model
    for _ in range(2):                                       # a replayed batch replaces itself
        index.append(e.where("vec_id >= 1500"), "second")
    again = vi.VectorIndex(spark, f"{tmpdir_path}/index")
    assert np.array_equal(again.model.centres, model.centres) and again.rows().count() == 2000
    found = again.topk(q, k=11)
    assert vi.recall(found, cosine_topk(e, q, k=11)) >= 0.9
    assert found.where("vec_id >= 1500").count() > 0


def test_hot_cells_ties_and_odd_rows(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(vi, "LOT_ROWS", 64)
    monkeypatch.setattr(vi, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(1)
    hot = rng.normal(size=10)
    rows = [(i, (hot if i % 3 == 0 else rng.normal(size=10)).tolist()) for i in range(900)]
    rows += [(900, None), (901, [0.0] * 10), (902, [1.0] * 4), (903, [float("nan")] * 10), (904, [1.0, None] * 5), (None, hot.tolist())]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = e.where("vec_id % 20 = 0 or vec_id >= 900").withColumn("query_id", F.col("vec_id"))
    index = vi.VectorIndex.build(e, f"{tmpdir_path}/index", cells=12)
    got = index.topk(q, k=10).collect()
    assert {r.QueryId for r in got} == {i for i in range(0, 900, 20)}
    for i in range(0, 900, 60):                              # a hot query's ten are the least ids of the equal rows
        assert [r.vec_id for r in sorted((r for r in got if r.QueryId == i), key=lambda r: r.Rank)] == list(range(0, 30, 3))
    assert index.rows().count() == 900
    assert index.topk(q.where("false")).collect() == []
    with pytest.raises(ValueError):
        vi.VectorIndex.build(e.where("vec_id >= 900 and vec_id <> 902"), f"{tmpdir_path}/none")


def test_lots_hold_what_they_should():
    counts = {0: 5, 1: 30, 2: 100, 3: 2, 5: 8, 9: 3}
    lots = vi.lots(counts, 32)
    assert lots[2][1] == 4 and all(n == 1 for c, (_, n) in lots.items() if c != 2)
    filled = {}
    for c, (first, n) in lots.items():
        for lot in range(first, first + n):
            filled.setdefault(lot, []).append(c)
    assert all(own == [2] for own in filled.values() if 2 in own) and sorted(filled) == list(range(len(filled)))
    assert all(sum(counts[c] for c in own) <= 32 for own in filled.values() if own != [2])


def test_store_replaces_documents_and_prunes(spark, tmpdir_path):
    store = VectorStore(spark, f"{tmpdir_path}/store")
    assert store.rows().collect() == []
    rows = [(s, d, c, f"{s}{d}{c}", [float(c), 1.0]) for s in "AB" for d in range(20) for c in range(5)]
    schema = "symbol string, doc_id long, chunk_id int, text string, embedding array<float>"
    store.replace(spark.createDataFrame(rows + rows[:3] + [(None, 1, 1, "x", [1.0]), ("A", None, 1, "x", [1.0])], schema))
    new = [("A", d, 0, "new", [0.5, 0.5]) for d in (3, 4)]
    for _ in range(2):
        store.replace(spark.createDataFrame(new, schema))
    want = sorted([r[:4] for r in rows if not (r[0] == "A" and r[1] in (3, 4))] + [r[:4] for r in new])
    assert sorted(tuple(r)[:4] for r in store.rows().collect()) == want
    asked = spark.createDataFrame([("A",)], "symbol string")
    plan = store.rows(asked)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert {r.symbol for r in store.rows(asked).collect()} == {"A"}
    queries = spark.createDataFrame([(7, "B", [4.0, 1.0])], "query_id long, symbol string, embedding array<float>")
    top = store.topk(queries, k=3).collect()
    assert [(r.symbol, r.doc_id, r.chunk_id) for r in sorted(top, key=lambda r: r.Rank)] == [("B", d, 4) for d in (0, 1, 2)]
