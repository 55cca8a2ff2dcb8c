"""Retrieval over stored embeddings and text (V1-V4).

* V1 exact cosine top-k: within a query's own symbol an equi-join; over a whole
  corpus, a product of query blocks and corpus blocks (``block_search``) that
  passes on only pairs which beat the k-th result known so far, and
  ``row_number() <= k`` per query gets a partial WindowGroupLimit before the shuffle,
  so each map task ships at most k rows per query.
* V2 approximate top-k: random-projection LSH (pyspark.ml) on unit vectors;
  candidates are corpus rows sharing a hash bucket with a query, found and scored exactly
  inside the same product of blocks, so that no candidate pair is stored or shuffled.
* V3 word-window chunking of whole documents; V4 keyword tagging.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.functions.rounding import rnd
from stockyard.operators.block_search import best_of_blocks
from stockyard.session import scratch_path
from stockyard.functions.text import chunk_starts, keyword_flags, sentence_ends, sentence_pieces, sentence_spans, words

# Blocks of the search: so many queries meet so many rows at once, fewer if vectors are long.
QUERY_ROWS, CORPUS_ROWS, BLOCK_VALUES = 4_096, 8_192, 1 << 20
# Rows of its first hash level, and how much larger each further one is than those before.
FIRST_ROWS, GROWTH = 8_192, 16
# Components up to which a dot product is written out as one sum.
UNROLLED = 256


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """dot(a, b) / (|a| |b|); NULL for a zero vector."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def _as_double(c: str) -> Column:
    return F.transform(F.col(c), lambda x: x.cast("double"))


def _with_norm(df: DataFrame, vec: str, out: str) -> DataFrame:
    """Vector as doubles and its norm, once for each row of this side."""
    d = df.withColumn(out, _as_double(vec))
    return d.withColumn(f"{out}_norm", F.sqrt(_dot(F.col(out), F.col(out))))


def _ranked(scored: DataFrame, by: str, id_col: str, k: int, digits: int | None) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col("_score").desc_nulls_last(), F.col(id_col).asc())
    top = (scored.where(F.col("_score").isNotNull())
                 .withColumn("Rank", F.row_number().over(w)).where(F.col("Rank") <= k))
    score = F.col("_score") if digits is None else rnd(F.col("_score"), digits)
    return top.select(F.col(by).alias("QueryId"), "Rank", F.col(id_col), score.alias("Score"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back."""
    path, schema = scratch_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _dot_of(a: Column, b: Column, dims: int) -> Column:
    """_dot of vectors without nulls, of up to ``dims`` components, as one compiled sum; NULL if lengths differ."""
    if dims > UNROLLED:
        return _dot(a, b)
    terms = (F.coalesce(F.get(a, F.lit(i)) * F.get(b, F.lit(i)), F.lit(0.0)) for i in range(dims))
    return F.when(F.size(a) == F.size(b), reduce(Column.__add__, terms, F.lit(0.0)))


def best_rows(queries: DataFrame, corpus: DataFrame, k: int, by: bool = False) -> DataFrame:
    """(_q, _id, _score, Rank): for each query (_q, _v, _v_norm) the k rows (_id, _c, _c_norm) of the highest cosine, ties
    by _id; both stored. ``by``: among the rows of the query's own _by; with hashes (_h), of those that share one.

    Both sides may be of any size: every query meets every row in a block-by-block product. The corpus is taken in
    hash levels, each GROWTH times as large as those before; a level's pairs leave the product
    only if they beat the k-th result known from the levels before, so a query gets about
    GROWTH * k rows from each, however large the corpus is.
    """
    # a vector without a norm has no score
    q = queries.where(F.col("_v_norm").isNotNull()).withColumn("_place", F.xxhash64("_q"))
    own = corpus.where(F.col("_c_norm").isNotNull())
    m, q_dims = q.agg(F.count("*"), F.coalesce(F.max(F.size("_v")), F.lit(0))).first()
    n, c_dims = own.agg(F.count("*"), F.coalesce(F.max(F.size("_c")), F.lit(0))).first()
    rows = lambda most, dims: max(1, min(most, BLOCK_VALUES // max(dims, 1)))
    ends = [FIRST_ROWS]
    while ends[-1] < n:
        ends.append(ends[-1] * GROWTH)
    own = own.withColumn("_place", F.pmod(F.xxhash64("_id"), F.lit(max(n, 1))))
    id_type = own.schema["_id"].dataType
    best = Window.partitionBy("_q").orderBy(F.col("_score").desc(), F.col("_id").asc())
    found = None
    for start, end in zip([0, *ends], ends):
        level = own.where((F.col("_place") >= start) & (F.col("_place") < end))
        if found is None:
            asked = q.withColumns({"_kth": F.lit(None).cast("double"), "_kth_id": F.lit(None).cast(id_type)})
        else:
            kth = found.where(F.col("Rank") == k).select("_q", F.col("_score").alias("_kth"), F.col("_id").alias("_kth_id"))
            asked = q.join(kth, "_q", "left")
        scored = best_of_blocks(asked.select("_q", *[c for c in asked.columns if c != "_q"]),
                                level.select("_id", *[c for c in level.columns if c != "_id"]), k,
                                rows(QUERY_ROWS, q_dims), rows(CORPUS_ROWS, c_dims), m, min(end, n) - min(start, n), by)
        if found is not None:
            scored = scored.where(F.col("_kth").isNull() | (F.col("_score") > F.col("_kth")) | (F.col("_id") < F.col("_kth_id")))
        scored = scored.select("_q", "_id", "_score")
        if found is not None:
            scored = scored.unionByName(found.drop("Rank"))
        found = _kept(scored.withColumn("Rank", F.row_number().over(best)).where(F.col("Rank") <= k), "found")
    return found


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
                vec_col: str = "embedding", query_id_col: str = "query_id",
                query_vec_col: str = "embedding", digits: int | None = 6, by: str | None = None) -> DataFrame:
    """V1 over a whole corpus: for every query, the k rows with the highest cosine similarity,
    with ``by`` only among the rows of the query's own value there.

    Query ids are distinct, ties are broken by ``id_col`` ascending. Each side's norms are computed once.
    """
    same = [F.col(by).alias("_by")] if by else []
    q = _kept(_with_norm(queries.select(F.col(query_id_col).alias("_q"), *same, F.col(query_vec_col).alias("_e")),
                         "_e", "_v").drop("_e"), "queries")
    own = _kept(_with_norm(corpus.select(F.col(id_col).alias("_id"), *same, F.col(vec_col).alias("_e")), "_e", "_c").drop("_e"),
                "vectors")
    found = best_rows(q, own, k, by is not None)
    out = F.col("_score") if digits is None else rnd(F.col("_score"), digits)
    return found.select(F.col("_q").alias("QueryId"), "Rank", F.col("_id").alias(id_col), out.alias("Score"))


def cosine_topk_within(corpus: DataFrame, queries: DataFrame, by: str, k: int = 10, id_col: str = "vec_id",
                       vec_col: str = "embedding", query_id_col: str = "query_id",
                       digits: int | None = 6) -> DataFrame:
    """V1 as the retriever asks it: each query searches only its own symbol's vectors
    (an equi-join on ``by``; the runtime splits a symbol that holds much of the corpus)."""
    q = _with_norm(queries.select(F.col(query_id_col).alias("_q"), F.col(by), F.col(vec_col).alias("_e")), "_e", "_v")
    own = _with_norm(corpus.select(F.col(id_col), F.col(by), F.col(vec_col)), vec_col, "_c")
    scored = own.join(q.drop("_e"), by).withColumn(
        "_score", F.try_divide(_dot(F.col("_v"), F.col("_c")), F.col("_v_norm") * F.col("_c_norm")))
    return _ranked(scored, "_q", id_col, k, digits)


def unit_vectors(df: DataFrame, vec_col: str = "embedding", out_col: str = "unit") -> DataFrame:
    """L2-normalised vectors as ml Vectors (L2 order on unit vectors = cosine order)."""
    from pyspark.ml.functions import array_to_vector
    v = _as_double(vec_col)
    norm = F.sqrt(_dot(v, v))
    return df.withColumn(out_col, array_to_vector(F.transform(v, lambda x: x / norm)))


def lsh_topk(corpus: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
             vec_col: str = "embedding", query_id_col: str = "query_id",
             bucket_length: float = 0.25, tables: int = 4, seed: int = 7,
             digits: int | None = 6) -> DataFrame:
    """V2: approximate top-k by cosine through random-projection LSH buckets.

    Recall depends on ``bucket_length`` and ``tables``; candidates (pairs that share a bucket in some
    table) are scored exactly, so every returned score is the true cosine. They are formed block by
    block inside the tasks: the pairs grow with the square of the input and are never written.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import vector_to_array
    c = unit_vectors(corpus.where(F.col(vec_col).isNotNull()), vec_col)
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="h", bucketLength=bucket_length,
                                        numHashTables=tables, seed=seed).fit(c)

    def hashed(df: DataFrame, id_col: str, name: str, vec: str) -> DataFrame:
        """Rows with their vector, its norm and its bucket in each table."""
        h = [F.element_at(vector_to_array(F.element_at("h", t + 1)), 1) for t in range(tables)]
        return _kept(_with_norm(model.transform(df).select(F.col(id_col).alias(name), F.array(*h).alias("_h"),
                                                           F.col(vec_col).alias("_e")), "_e", vec).drop("_e"), "hashed")

    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(query_id_col), F.col(vec_col))
    found = best_rows(hashed(unit_vectors(asked, vec_col), query_id_col, "_q", "_v"), hashed(c, id_col, "_id", "_c"), k)
    score = F.col("_score") if digits is None else rnd(F.col("_score"), digits)
    return found.select(F.col("_q").alias("QueryId"), "Rank",
                        F.col("_id").alias(id_col), score.alias("Score"))


def chunk_documents(docs: DataFrame, size: int = 256, overlap: int = 32,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """V3: overlapping word windows covering every word of every document.

    Output: doc_id, chunk_id (0-based), n_words, text.
    """
    stride = size - overlap
    w = docs.select(F.col(id_col), words(text_col).alias("_w"))
    starts = chunk_starts(F.size("_w"), size, overlap)
    c = w.select(id_col, "_w", F.posexplode(starts).alias("chunk_id", "_start"))
    piece = F.slice("_w", F.col("_start") + 1, F.lit(size))
    assert stride > 0
    return c.select(id_col, F.col("chunk_id").cast("int").alias("chunk_id"),
                    F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("text"))


def sentence_chunks(docs: DataFrame, size: int = 256, overlap: int = 32,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """V3: chunks of whole sentences, at most ``size`` words each, that overlap in whole sentences.

    Every word is covered; a sentence is cut only if it has more than ``size`` words. A null text,
    or one without words, has no chunks; repeated rows are chunked each by itself.
    Output: doc_id, chunk_id (0-based), n_words, text.
    """
    w = docs.select(F.col(id_col), words(text_col).alias("_w"))
    # a step's result is a column that the next one uses more than once, so plans do not inline it
    ends = w.withColumn("_e", sentence_ends(F.col("_w")))
    pieces = ends.select(id_col, "_w", sentence_pieces(F.col("_e"), size).alias("_p"))
    spans = pieces.select(id_col, "_w", sentence_spans(F.col("_p"), size, overlap).alias("_s"))
    # outer: for an inner one Spark adds a filter on the array's size, pushes it below and folds every text twice
    c = spans.select(id_col, "_w", F.posexplode_outer("_s").alias("chunk_id", "_at")).filter("chunk_id is not null")
    n = F.col("_at.upto") - F.col("_at.from")
    return c.select(id_col, F.col("chunk_id").cast("int").alias("chunk_id"), n.alias("n_words"),
                    F.array_join(F.slice("_w", F.col("_at.from") + 1, n), " ").alias("text"))


def tag_questions(df: DataFrame, text_col: str = "text",
                  labels: dict[str, list[str]] | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """V4: one boolean per question type (case-insensitive substring keywords)."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    return df.select(*keep, *keyword_flags(text_col, labels))
