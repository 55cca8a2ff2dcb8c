"""Searches by blocks: the rows of the plain expression on odd vectors, and no pairs written or gathered by value."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockyard.operators import retrieval
from stockyard.operators.block_search import packed
from stockyard.operators.vector_store import VectorStore

ROWS = "vec_id long, embedding array<double>, label string"


def odd_vectors(spark):
    inf, nan, tiny, huge = float("inf"), float("nan"), 1e-170, 1e170
    kinds = [[1.0, 2.0], [2.0, 4.0], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [tiny, tiny], [huge, -huge], [-1.0, 0.5], [1.0, 2.0, 3.0],
             [1.0], [], None, [1.0, None]]
    return spark.createDataFrame([(i, kinds[i * 7 % len(kinds)], [None, "a", "b"][i % 3]) for i in range(150)], ROWS)


@pytest.mark.parametrize("by", [None, "label"])
def test_odd_vectors_give_the_rows_of_the_expression(spark, monkeypatch, by):
    for name, value in {"FIRST_ROWS": 16, "GROWTH": 2, "QUERY_ROWS": 8, "CORPUS_ROWS": 8}.items():
        monkeypatch.setattr(retrieval, name, value)
    e = odd_vectors(spark)
    q = e.where("vec_id % 3 < 2").withColumn("query_id", F.col("vec_id"))
    pairs = q.select("query_id", F.col("embedding").alias("a"), F.col("label").alias("x")).crossJoin(e)
    if by:
        pairs = pairs.where(F.col("x").eqNullSafe(F.col("label")))
    score = retrieval.cosine(F.col("a"), F.col("embedding"))
    w = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "vec_id")
    want = (pairs.where(F.size("a") == F.size("embedding")).withColumn("s", score).where("s is not null")
            .withColumn("n", F.row_number().over(w)).where("n <= 3").select("query_id", "n", "vec_id", "s"))
    text = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert text(retrieval.cosine_topk(e, q, k=3, by=by, digits=None)) == text(want)


def test_lsh_writes_no_candidate_pairs(spark):
    e = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    found = retrieval.lsh_topk(e, e.withColumn("query_id", F.col("vec_id")), k=2)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert found.count() == 120


def test_one_symbol_is_searched_in_many_blocks(spark, monkeypatch, tmpdir_path):
    rows = spark.range(500).select(F.lit("HOT").alias("_by"), F.col("id").alias("_place"))
    sizes = [len(r["rows"]) for r in packed(rows, 10, ["_by", "_place"], "_by").collect()]
    assert sum(sizes) == 500 and max(sizes) < 200
    monkeypatch.setattr(retrieval, "CORPUS_ROWS", 40)
    store = VectorStore(spark, f"{tmpdir_path}/store")
    store.replace(spark.range(300).select(F.lit("HOT").alias("symbol"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_id"),
                                          F.concat(F.lit("t"), "id").alias("text"),
                                          F.array(F.cos(F.col("id") / 100), F.sin(F.col("id") / 100)).alias("embedding")))
    asked = store.rows().where("doc_id % 50 = 0").withColumn("query_id", F.col("doc_id"))
    got = store.topk(asked, k=1)
    assert sorted((r.QueryId, r.doc_id, r.text) for r in got.collect()) == [(i, i, f"t{i}") for i in range(0, 300, 50)]
