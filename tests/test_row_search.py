"""Searches whose queries are all rows with an id divisible by 20: whole, exact, and the recall of the index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stockyard.operators import retrieval

from conftest import SMALL


@pytest.mark.parametrize("name", ["cosine_topk_rows", "cosine_topk_symbol_rows", "lsh_topk_rows"])
def test_every_twentieth_row_is_a_query(spark, name):
    asked = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 20 = 0")
    got = {r.QueryId for r in entry.queries()[name](spark, SMALL).select("QueryId").distinct().collect()}
    assert got == {r.vec_id for r in asked.collect()}


def test_lsh_recall_is_at_least_nine_tenths(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id"))
    # one more than ten, as a query finds its own row for certain
    found = lambda df: {(r.QueryId, r.vec_id) for r in df.collect() if r.QueryId != r.vec_id}
    exact, near = found(retrieval.cosine_topk(e, q, k=11)), found(retrieval.lsh_topk(e, q, k=11))
    assert len(exact & near) / len(exact) >= 0.9


@pytest.mark.parametrize("unrolled", [256, 2])
def test_levels_and_blocks_give_the_exact_rows(spark, monkeypatch, unrolled):
    for name, value in {"UNROLLED": unrolled, "FIRST_ROWS": 8, "GROWTH": 3, "QUERY_ROWS": 16, "CORPUS_ROWS": 40}.items():
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(5)
    hot = [0.5, -0.25, 1.0]
    rows = [(i, hot if i % 4 == 0 else rng.normal(size=3).tolist(), i % 3) for i in range(300)]
    rows += [(300, None, 0), (301, [0.0] * 3, 0), (302, [1.0, 2.0], 0), (303, [1.0, None, 2.0], 0), (304, [2.0, 1.0], 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = e.where("vec_id % 5 = 0 or vec_id > 299").withColumn("query_id", F.col("vec_id"))
    usable = [(i, np.array(v), b) for i, v, b in rows if v and None not in v and any(v)]
    for by in (None, "label"):
        got = {}
        for r in retrieval.cosine_topk(e, q, k=4, by=by, digits=None).collect():
            got.setdefault(r.QueryId, {})[r.Rank] = (r.vec_id, r.Score)
        want = [u for u in usable if u[0] % 5 == 0 or u[0] > 299]
        assert set(got) == {i for i, _, _ in want}
        for i, v, b in want:
            scores = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w, c in usable
                            if len(w) == len(v) and (by is None or c == b))[:4]
            assert [got[i][n + 1][0] for n in range(len(scores))] == [j for _, j in scores] and len(got[i]) == len(scores)
