"""Exact best k of a product of query blocks and corpus blocks (V1, V2).

Both sides are packed by range into rows that hold a block each, and Spark pairs the blocks; nothing but the
blocks themselves is shuffled, once a side. A task takes one pair after another: a matrix product finds, for each
query, the rows that can be among its k best, and only these get their exact score - the sum of products in the
order of the components, divided by the product of the norms, as the column expression of ``retrieval`` computes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scores of one matrix product, and pairs that are scored exactly at once.
CELLS, PAIRS = 1 << 22, 1 << 18
# Norms between these bounds neither overflow nor lose digits; other vectors are scored exactly right away.
LEAST_NORM, MOST_NORM = 1e-100, 1e100


def packed(rows: DataFrame, blocks: int, keys: list[str], by: str | None) -> DataFrame:
    """A row for each block: its rows in the order of their first column, and the range of ``by`` it holds."""
    dealt = rows.repartitionByRange(blocks, *keys).withColumn("_block", F.spark_partition_id())
    span = [F.min(by).alias("low"), F.max(by).alias("high"), (F.count_if(F.col(by).isNull()) > 0).alias("null")] if by else []
    held = F.sort_array(F.collect_list(F.struct(*rows.columns)))
    return dealt.groupBy("_block").agg(*span, held.alias("rows")).drop("_block").repartition(blocks)


def best_of_blocks(queries: DataFrame, rows: DataFrame, k: int, query_rows: int, corpus_rows: int, n_queries: int,
                   n_rows: int, by: bool = False) -> DataFrame:
    """(_q, _id, _score, _kth_id): for each query (_q, _v, _v_norm, and _kth, _kth_id: its k-th result known so far or
    nulls) at most k rows (_id, _c, _c_norm) of each block, among them all that belong to the k best and are no worse than
    that result. ``by``: rows with the query's _by only. With hashes (_h) on both sides, rows that share one only."""
    ranged = ["_by"] if by else []
    q = packed(queries, max(1, -(-n_queries // query_rows)), [*ranged, "_place"], "_by" if by else None)
    c = packed(rows, max(1, -(-n_rows // corpus_rows)), [*ranged, "_place"], "_by" if by else None)
    names = ["low", "high", "null"] if by else []
    q = q.select(F.col("rows").alias("q"), *[F.col(n).alias(f"q_{n}") for n in names])
    c = c.select(F.col("rows").alias("c"), *[F.col(n).alias(f"c_{n}") for n in names])
    meet = F.lit(True)
    if by:
        meet = ((F.col("q_low") <= F.col("c_high")) & (F.col("c_low") <= F.col("q_high"))) | (F.col("q_null") & F.col("c_null"))
    pairs = q.hint("shuffle_replicate_nl").join(c, meet).select("q", "c")
    one, two = queries.schema, rows.schema
    out = T.StructType([T.StructField("_q", one["_q"].dataType), T.StructField("_id", two["_id"].dataType),
                        T.StructField("_score", T.DoubleType()), T.StructField("_kth", T.DoubleType()),
                        T.StructField("_kth_id", two["_id"].dataType)])
    return pairs.mapInArrow(_searching(k), out)


def _searching(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _best_of_pair(batch.column("q")[i].values, batch.column("c")[i].values, k)
    return search


def _best_of_pair(q: pa.StructArray, c: pa.StructArray, k: int) -> Iterator[pa.RecordBatch]:
    q_size, c_size = (pc.list_value_length(x.field(n)).to_numpy(zero_copy_only=False) for x, n in ((q, "_v"), (c, "_c")))
    groups = _codes(q.field("_by"), c.field("_by")) if "_by" in [f.name for f in c.type] else None
    hashes = [np.array(x.field("_h").to_pylist(), dtype=np.float64) for x in (q, c)] if "_h" in [f.name for f in c.type] else None
    kth = q.field("_kth")
    known = kth.is_valid().to_numpy(zero_copy_only=False)
    kth = np.where(known, kth.to_numpy(zero_copy_only=False).astype(np.float64), -np.inf)
    # vectors of different lengths have no score
    for size in np.intersect1d(q_size, c_size):
        qi, ci = np.flatnonzero(q_size == size), np.flatnonzero(c_size == size)
        code = None if groups is None else groups[1][ci]
        rows = _matrix(c.field("_c"), ci, size)
        few = _first_copies(rows, code, k)
        ci, rows = ci[few], rows[few]
        found = _best(_matrix(q.field("_v"), qi, size), _doubles(q.field("_v_norm"))[qi], rows, _doubles(c.field("_c_norm"))[ci],
                      None if groups is None else (groups[0][qi], code[few]),
                      None if hashes is None else (hashes[0][qi], hashes[1][ci]), kth[qi], k)
        for at, of, score in found:
            at, of = pa.array(qi[at]), pa.array(ci[of])
            yield pa.RecordBatch.from_arrays([q.field("_q").take(at), c.field("_id").take(of), pa.array(score),
                                              q.field("_kth").take(at), q.field("_kth_id").take(at)],
                                             names=["_q", "_id", "_score", "_kth", "_kth_id"])


def _doubles(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def _matrix(lists: pa.ListArray, at: np.ndarray, size: int) -> np.ndarray:
    """Vectors ``at`` of one length, a row each."""
    chosen = lists if len(at) == len(lists) else lists.take(pa.array(at))
    return _doubles(chosen.flatten()).reshape(len(at), size)


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values are; nulls are equal."""
    codes = pa.concat_arrays([a, b]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[:len(a)], codes[len(a):]


def _first_copies(rows: np.ndarray, code: np.ndarray | None, k: int) -> np.ndarray:
    """Places of rows with fewer than ``k`` equal ones before them: later ones tie with k rows of smaller id."""
    if not rows.shape[1]:
        return np.arange(len(rows))
    keyed = rows if code is None else np.column_stack([rows, code.astype(np.float64)])
    whole = np.ascontiguousarray(keyed).view(f"V{keyed.shape[1] * 8}").ravel()
    _, same = np.unique(whole, return_inverse=True)
    order = np.argsort(same, kind="stable")
    starts = np.searchsorted(same[order], same[order])
    return np.sort(order[np.arange(len(order)) - starts < k])


def _unit(v: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (0 for others), and which have norm 0 or one that the product cannot take."""
    plain = (norm > LEAST_NORM) & (norm < MOST_NORM)
    out = np.zeros_like(v)
    out[plain] = v[plain] / norm[plain, None]
    return out, norm == 0, ~plain & (norm != 0)


def _best(v: np.ndarray, v_norm: np.ndarray, c: np.ndarray, c_norm: np.ndarray, groups, hashes, kth: np.ndarray,
          k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    off = (v.shape[1] + 16) * 1e-15                  # more than the product's rounding can move a cosine
    vu, v_zero, v_odd = _unit(v, v_norm)
    cu, c_zero, c_odd = _unit(c, c_norm)
    vt, ct = np.ascontiguousarray(v.T), np.ascontiguousarray(c.T)
    step = max(1, CELLS // max(len(c), 1))
    for start in range(0, len(v), step):
        part = slice(start, start + step)
        barred = np.zeros((len(v[part]), len(c)), dtype=bool)
        if groups is not None:
            barred |= groups[0][part, None] != groups[1][None, :]
        if hashes is not None:
            shared = np.zeros_like(barred)
            for t in range(hashes[1].shape[1]):
                shared |= hashes[0][part, t, None] == hashes[1][None, :, t]
            barred |= ~shared
        rough = vu[part] @ cu.T
        plain = ~(v_zero | v_odd)[part, None] & ~(c_zero | c_odd)[None, :]
        rough[barred | ~plain] = -np.inf
        least = np.where(np.isnan(kth[part]), np.inf, kth[part] - off)
        if len(c) > k:
            many = np.flatnonzero((rough >= least[:, None]).sum(axis=1) > 2 * k)
            if len(many):
                cut = np.partition(rough[many], len(c) - k, axis=1)[:, len(c) - k]
                least[many] = np.maximum(least[many], cut - 2 * off)
        may = (rough >= least[:, None]) & (rough > -np.inf)
        if v_odd[part].any() or c_odd.any():
            may |= (v_odd[part, None] | c_odd[None, :]) & ~barred
        at, of = np.nonzero(may)
        if len(at):
            yield _top(vt, v_norm, ct, c_norm, at + start, of, kth, k)


def _top(vt: np.ndarray, v_norm: np.ndarray, ct: np.ndarray, c_norm: np.ndarray, at: np.ndarray, of: np.ndarray,
         kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (at, of) each query's k with the highest exact score, no worse than ``kth``; ties by place."""
    dot = np.zeros(len(at))
    with np.errstate(all="ignore"):
        for start in range(0, len(at), PAIRS):
            part = slice(start, start + PAIRS)
            for a, b in zip(vt, ct, strict=True):
                dot[part] += a[at[part]] * b[of[part]]
        norms = v_norm[at] * c_norm[of]
        score = dot / norms
        nan = np.isnan(score)                        # Spark orders NaN above all numbers
        kept = (norms != 0) & (nan | (score >= kth[at]))
    at, of, score, nan = at[kept], of[kept], score[kept], nan[kept]
    order = np.lexsort((of, -np.where(nan, 0.0, score), ~nan, at))
    at, of, score = at[order], of[order], score[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], of[first], score[first]
