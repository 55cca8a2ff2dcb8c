"""V1 as stored: chunk vectors in a table partitioned by symbol.

A row is one chunk of a document: (symbol, doc_id, chunk_id, text, embedding). The table is
partitioned by symbol and, inside a symbol, by a hash of the document into ``parts`` folders, so
that a change rewrites the folders of its documents and not a whole symbol, and a
symbol that holds much of the corpus is many files.

``replace`` puts a batch in place of all chunks that its documents had: the folders the batch touches are read,
other documents' rows are carried over, and the folders are overwritten (dynamic partition overwrite). A
replace that was interrupted is run again and ends in the same state. A search reads the folders of the asked
symbols only (dynamic partition pruning by a broadcast of the symbols, which are size-checked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.functions.rounding import rnd
from stockyard.operators.retrieval import _kept, _with_norm, best_rows
from stockyard.session import fits_broadcast

PARTS = 8
COLUMNS = ["symbol", "doc_id", "chunk_id", "text", "embedding"]
ROWS = "doc_id long, chunk_id int, text string, embedding array<float>, symbol string, part int"


class VectorStore:
    """Store under ``root``; ``parts`` is fixed for the life of a store."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _table(self) -> DataFrame:
        try:
            return self.spark.read.schema(ROWS).parquet(self.root)
        except Exception as e:  # noqa: BLE001 - nothing stored yet
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
            return self.spark.createDataFrame([], ROWS)

    def rows(self, symbols: DataFrame | None = None) -> DataFrame:
        """Stored chunks; with ``symbols`` (a column symbol) those of the asked symbols only."""
        table = self._table()
        if symbols is not None:
            table = self._within(table, symbols, ["symbol"])
        return table.select(*COLUMNS)

    @staticmethod
    def _within(table: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
        # an explicit comparison, so that the planner takes the list as selective and prunes by it
        wanted = wanted.where(F.length("symbol") >= 0).select(*by).distinct()
        return table.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, by, "left_semi")

    def replace(self, chunks: DataFrame) -> None:
        """Store ``chunks`` in place of all chunks of the same (symbol, doc_id). Rows without a symbol,
        document or chunk number take no part; of repeated (symbol, doc_id, chunk_id) one stays."""
        new = chunks.where("symbol IS NOT NULL AND doc_id IS NOT NULL AND chunk_id IS NOT NULL").select(
            F.col("symbol").cast("string"), F.col("doc_id").cast("long"), F.col("chunk_id").cast("int"),
            F.col("text").cast("string"), F.col("embedding").cast("array<float>"))
        new = new.groupBy("symbol", "doc_id", "chunk_id").agg(F.min(F.struct("text", "embedding")).alias("c")).select(
            "symbol", "doc_id", "chunk_id", "c.text", "c.embedding")
        staged = _kept(new.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int")), "chunks")
        documents = staged.select("symbol", "doc_id").distinct()
        touched = self._within(self._table(), staged, ["symbol", "part"])
        others = touched.join(F.broadcast(documents) if fits_broadcast(documents) else documents, ["symbol", "doc_id"], "left_anti")
        (others.unionByName(staged).hint("rebalance", F.col("symbol"), F.col("part"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "part").parquet(self.root))

    def topk(self, queries: DataFrame, k: int = 10, digits: int | None = 6) -> DataFrame:
        """(QueryId, Rank, symbol, doc_id, chunk_id, text, Score): for each query (query_id, symbol, embedding) the
        k chunks of its own symbol with the highest cosine; ties by document and chunk."""
        q = _kept(_with_norm(queries.select(F.col("query_id").alias("_q"), F.col("symbol").alias("_by"), F.col("embedding").alias("_e")),
                             "_e", "_v").drop("_e").where("_by IS NOT NULL"), "queries")
        rows = self.rows(queries.select("symbol"))
        own = _kept(_with_norm(rows.select(F.struct("symbol", "doc_id", "chunk_id").alias("_id"), F.col("symbol").alias("_by"),
                                           F.col("embedding").alias("_e")), "_e", "_c").drop("_e"), "vectors")
        ranked = best_rows(q, own, k, by=True).select("_q", "Rank", "_id.*", "_score")
        out = F.col("_score") if digits is None else rnd(F.col("_score"), digits)
        # a chunk is stored once
        return ranked.join(rows.select("symbol", "doc_id", "chunk_id", "text"), ["symbol", "doc_id", "chunk_id"]).select(
            F.col("_q").alias("QueryId"), "Rank", "symbol", "doc_id", "chunk_id", "text", out.alias("Score"))
