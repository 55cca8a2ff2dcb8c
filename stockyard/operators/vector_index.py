"""V2: a trained vector index for cosine top-k - coarse cells, product-quantised residuals, multi-probe.

*Training* takes a bounded, hash-chosen sample (``SAMPLE_ROWS``, a parameter). k-means over
unit vectors gives the cells; what a vector differs from its cell's centre is cut into ``PARTS``
pieces, and each piece is written as one byte, the nearest of 256 trained pieces. Rows of the
sample that took no part in the training decide two numbers: how many cells a query has to
probe, and by how much the score from codes may fall short (``margin``), so that neighbours found
reach ``TARGET``.

*The index* is a table of (vec_id, code, embedding), partitioned by cell and, inside a cell, by
batch. ``append`` encodes further vectors with the stored model, without training again, and a batch
that is written twice replaces itself.

*A search* reads codes only. Queries find their cells against the centres; cells are laid into lots of
about ``LOT_ROWS`` rows (a large cell is spread over several), queries into blocks by their home cell, and
only pairs of a lot and a block that need each other meet in a task. A task looks the scores up
from codes. It does so twice: first it passes on each query's k best, which together give the query's k-th best score
from codes; then only rows that come within ``margin`` of that, and those are scored exactly against the stored vectors. So every
returned score is a true cosine, and a few rows in a hundred are scored exactly.

The driver holds the model and one number for each cell (at most ``MAX_CELLS``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockyard.functions.rounding import rnd
from stockyard.operators.retrieval import _dot_of, _kept, _with_norm

SAMPLE_ROWS = 20_000
MAX_CELLS = 4_096
PARTS = 16                   # bytes of a code
ROUNDS = 10                  # of k-means
TARGET = 0.97                # share of neighbours that each of the two cuts must leave, on unseen sample rows
NEIGHBOURS = 10              # neighbours that the cuts are tuned for
TUNING_QUERIES = 256
LOT_ROWS, BLOCK_QUERIES = 8_192, 1_024
ROW = "vec_id long, code binary, embedding array<float>, cell int, batch string"
MODEL = "dims int, probes int, margin double, centres binary, pieces binary"


def nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, dtype=np.int64)] + [
        np.argmax(x[a:a + step] @ centres.T - half, axis=1) for a in range(0, len(x), step)])


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres by Lloyd's rounds from random rows; a centre that loses all rows takes a random one."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        size = np.bincount(own, minlength=len(centres))
        have = np.flatnonzero(size)
        centres[have] = np.add.reduceat(x[order], (np.cumsum(size) - size)[have], axis=0) / size[have, None]
        lost = np.flatnonzero(size == 0)
        centres[lost] = x[rng.choice(len(x), len(lost))]
    return centres


@dataclass(frozen=True)
class Model:
    """Centres [cells, dims], pieces [parts, 256, dims of a part], and the two tuned numbers."""
    centres: np.ndarray
    pieces: np.ndarray
    probes: int
    margin: float

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def cut(self, x: np.ndarray) -> np.ndarray:
        """[rows, parts, dims of a part], padded with zeros."""
        parts, _, width = self.pieces.shape
        out = np.zeros((len(x), parts * width), dtype=np.float32)
        out[:, :x.shape[1]] = x
        return out.reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code [rows, parts]) of unit vectors."""
        cell = nearest(x, self.centres)
        rest = self.cut(x - self.centres[cell])
        code = np.stack([nearest(rest[:, p], self.pieces[p]) for p in range(len(self.pieces))], axis=1)
        return cell, code.astype(np.uint8)

    def probed(self, q: np.ndarray, count: int | None = None) -> np.ndarray:
        """The nearest cells of each query, nearest first."""
        count = min(count or self.probes, len(self.centres))
        far = (self.centres * self.centres).sum(axis=1) / 2 - q @ self.centres.T
        some = np.argpartition(far, count - 1, axis=1)[:, :count] if count < far.shape[1] else np.tile(
            np.arange(far.shape[1]), (len(q), 1))
        return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[queries, parts, 256]: score of each trained piece for each query."""
        return np.einsum("qpd,pkd->qpk", self.cut(q), self.pieces, optimize=True)

    def scores(self, q: np.ndarray, tables: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """[queries, rows] scores from codes of one cell's rows."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(code), axis=1)
        for p in range(code.shape[1]):
            out += tables[:, p][:, code[:, p]]
        return out

    def row(self) -> tuple:
        return (self.dims, self.probes, float(self.margin), self.centres.astype("<f4").tobytes(),
                self.pieces.astype("<f4").tobytes())

    @classmethod
    def of(cls, row) -> Model:
        width = -(-row.dims // PARTS)
        return cls(np.frombuffer(bytes(row.centres), dtype="<f4").reshape(-1, row.dims),
                   np.frombuffer(bytes(row.pieces), dtype="<f4").reshape(PARTS, -1, width), row.probes, row.margin)


def fitted(x: np.ndarray, cells: int, seed: int) -> Model:
    """Model of a sample of different unit vectors."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    held = len(x) // 4 if len(x) >= 400 else 0
    learn, unseen = (x[held:], x[:held]) if held else (x, x)
    centres = k_means(learn, cells, ROUNDS, rng)
    width = -(-x.shape[1] // PARTS)
    model = Model(centres, np.zeros((PARTS, 1, width), dtype=np.float32), len(centres), 0.0)
    rest = model.cut(learn - centres[nearest(learn, centres)])
    pieces = np.zeros((PARTS, 256, width), dtype=np.float32)
    for p in range(PARTS):
        some = k_means(rest[:, p], 256, ROUNDS, rng)
        pieces[p] = some[np.arange(256) % len(some)]           # fewer rows than codes: repeated
    model = Model(centres, pieces, len(centres), 0.0)
    return tuned(model, unseen)


def tuned(model: Model, x: np.ndarray) -> Model:
    """Probes and margin that leave TARGET of the nearest rows among ``x``."""
    q = x[:TUNING_QUERIES]
    k = min(NEIGHBOURS, len(x) - 1)
    if k < 1:
        return model
    cell, code = model.encode(x)
    exact, tables = q @ x.T, model.tables(q)
    rough = np.empty_like(exact)
    for c in np.unique(cell):
        rough[:, cell == c] = model.scores(q, tables, int(c), code[cell == c])
    own = np.arange(len(q))
    exact[own, own] = rough[own, own] = -np.inf
    near = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    place = np.argsort(model.probed(q, len(model.centres)), axis=1)        # of each cell in a query's order
    needed = np.take_along_axis(place, cell[near], axis=1) + 1
    kth = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
    short = kth[:, None] - np.take_along_axis(rough, near, axis=1)
    probes = int(np.ceil(np.quantile(needed, TARGET)))
    return Model(model.centres, model.pieces, max(1, min(probes, len(model.centres))),
                 max(0.0, float(np.quantile(short, TARGET))))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a float matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def usable(df: DataFrame, id_col: str, vec_col: str, dims: int | None = None) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a finite vector that is not zero."""
    v = F.col(vec_col).cast("array<float>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.size(v) == dims if dims else F.size(v) > 0
    good = F.coalesce(fit & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    return df.where(good & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"))


def lots(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """cell -> (first lot, number of lots): neighbours in the order of cells share a lot up to
    ``size``, a cell above it gets lots of its own."""
    out: dict[int, tuple[int, int]] = {}
    lot, filled = 0, 0
    for cell, n in sorted(counts.items()):
        if n > size:
            lot += filled > 0
            own = -(-n // size)
            out[cell] = (lot, own)
            lot, filled = lot + own, 0
            continue
        if filled + n > size:
            lot, filled = lot + 1, 0
        out[cell] = (lot, 1)
        filled += n
    return out


class VectorIndex:
    """Index under ``root``: the model and the rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._model: Model | None = None

    # ---- building ------------------------------------------------------------
    @classmethod
    def build(cls, vectors: DataFrame, root: str, id_col: str = "vec_id", vec_col: str = "embedding",
              cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> VectorIndex:
        """Train on a sample of ``vectors`` and index all of them as the first batch."""
        index = cls(vectors.sparkSession, root)
        index.train(vectors, id_col, vec_col, cells, sample_rows, seed)
        index.append(vectors, "first", id_col, vec_col)
        return index

    def train(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
              cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> None:
        """Write the model. The number of cells defaults to the root of the number of rows; all vectors of the
        commonest length are indexed, others take no part."""
        rows = usable(vectors, id_col, vec_col)
        by_length = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
        most = by_length.orderBy(F.desc("n"), "d").first()
        if most is None:
            raise ValueError("no usable vector to train on")
        dims, n = most
        chosen = rows.where((F.size("embedding") == dims) & (F.pmod(F.xxhash64("vec_id"), F.lit(n)) < sample_rows))
        wanted = min(cells or int(n ** 0.5), MAX_CELLS)

        def fit(sample: pa.Table) -> pa.Table:
            x = np.unique(unit(matrix(sample["embedding"])), axis=0)
            model = fitted(x, max(1, min(wanted, len(x) // 8)), seed)
            return pa.table([[v] for v in model.row()], schema=pa.schema(
                [("dims", pa.int32()), ("probes", pa.int32()), ("margin", pa.float64()), ("centres", pa.binary()),
                 ("pieces", pa.binary())]))

        # one group, bounded by sample_rows
        chosen.groupBy().applyInArrow(fit, MODEL).write.mode("overwrite").parquet(f"{self.root}/model")
        self._model = None

    @property
    def model(self) -> Model:
        if self._model is None:
            self._model = Model.of(self.spark.read.schema(MODEL).parquet(f"{self.root}/model").first())
        return self._model

    def append(self, vectors: DataFrame, batch: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """Encode and add a batch with the stored model; the same batch again replaces itself."""
        model = self.model

        def encode(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                cell, code = model.encode(unit(matrix(b.column("embedding"))))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array([c.tobytes() for c in code], pa.binary()), b.column("embedding"),
                     pa.array(cell, pa.int32()), pa.array([batch] * b.num_rows)],
                    names=["vec_id", "code", "embedding", "cell", "batch"])

        rows = usable(vectors, id_col, vec_col, model.dims).mapInArrow(encode, ROW)
        # rebalanced by cell: few files for a small cell, several for a large one
        (rows.hint("rebalance", F.col("cell")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("cell", "batch").parquet(f"{self.root}/rows"))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(f"{self.root}/rows")

    # ---- search ----------------------------------------------------------------
    def candidates(self, queries: DataFrame, k: int = 10, query_id_col: str = "query_id",
                   vec_col: str = "embedding") -> DataFrame:
        """(query_id, vec_id, cell) to be scored exactly: rows whose score from codes comes within the
        margin of the query's k-th best over the probed cells."""
        model = self.model
        asked = _kept(usable(queries, query_id_col, vec_col, model.dims).withColumnRenamed("vec_id", "query_id"), "asked")
        cell_rows = dict(map(tuple, self.rows().groupBy("cell").count().collect()))

        def homes(batches):
            for b in batches:
                if b.num_rows:
                    x = unit(matrix(b.column("embedding")))
                    yield pa.RecordBatch.from_arrays([pa.array(model.probed(x, 1)[:, 0], pa.int32())], names=["cell"])

        home_rows = dict(map(tuple, asked.select("embedding").mapInArrow(homes, "cell int").groupBy("cell").count().collect()))
        lot_of, block_of = lots(cell_rows, LOT_ROWS), lots(home_rows, BLOCK_QUERIES)

        def probe(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                ids, x = b.column("query_id").to_pylist(), unit(matrix(b.column("embedding")))
                out = []
                for i, (query, cells) in enumerate(zip(ids, model.probed(x).tolist(), strict=True)):
                    first, many = block_of[cells[0]]
                    block, by_lot = first + query % many, {}
                    for c in cells:
                        if c in lot_of:
                            for lot in range(lot_of[c][0], sum(lot_of[c])):
                                by_lot.setdefault(lot, []).append(c)
                    v = x[i].tobytes()
                    out += [(lot, block, query, v, own) for lot, own in by_lot.items()]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds, strict=True)],
                    names=["lot", "block", "query_id", "v", "cells"])

        probes = _kept(asked.mapInArrow(probe, "lot int, block int, query_id long, v binary, cells array<int>"), "probes")
        # at most MAX_CELLS rows
        place = self.spark.createDataFrame([(c, lot, many) for c, (lot, many) in lot_of.items()],
                                           "cell int, lot int, many int")
        coded = (self.rows().select("cell", "vec_id", "code").join(F.broadcast(place), "cell")
                 .withColumn("lot", (F.col("lot") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int")).drop("many"))
        met = coded.join(probes.select("lot", "block").distinct().toDF("lot", "block"), "lot")

        def look(left: pa.Table, right: pa.Table) -> pa.Table:
            """Rows of at least the query's ``least`` score, or its k best where that is not known yet."""
            found: list[list[np.ndarray]] = [[], [], [], []]
            if left.num_rows and right.num_rows:
                cell = left["cell"].to_numpy()
                order = np.argsort(cell, kind="stable")
                cell, ids = cell[order], left["vec_id"].to_numpy()[order]
                code = np.frombuffer(b"".join(left["code"].to_pylist()), dtype=np.uint8).reshape(len(order), -1)[order]
                q = np.frombuffer(b"".join(right["v"].to_pylist()), dtype=np.float32).reshape(right.num_rows, -1)
                query, tables = right["query_id"].to_numpy(), model.tables(q)
                least = right["least"].to_numpy()                 # NaN: not known yet
                wants: dict[int, list[int]] = {}
                for i, own in enumerate(right["cells"].to_pylist()):
                    for c in own:
                        wants.setdefault(c, []).append(i)
                parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in query]
                for c, who in wants.items():
                    who_at = np.array(who)
                    a, b = np.searchsorted(cell, [c, c + 1])
                    for s in range(a, b, 1024):                    # so many rows at a time
                        rows = np.arange(s, min(s + 1024, b))
                        score = model.scores(q[who_at], tables[who_at], c, code[rows])
                        kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else score.min(axis=1)
                        x, y = np.nonzero(score >= np.where(np.isnan(least[who_at]), kth, least[who_at])[:, None])
                        ends = np.searchsorted(x, np.arange(len(who) + 1))
                        for j, i in enumerate(who):
                            own = slice(ends[j], ends[j + 1])
                            parts[i].append((rows[y[own]], score[j, y[own]]))
                for i, some in enumerate(parts):
                    if not some:
                        continue
                    rows = np.concatenate([r for r, _ in some])
                    score = np.concatenate([v for _, v in some])
                    if np.isnan(least[i]) and len(score) > k:
                        best = np.argpartition(-score, k - 1)[:k]
                        rows, score = rows[best], score[best]
                    for into, what in zip(found, (np.full(len(rows), query[i]), ids[rows], cell[rows], score), strict=True):
                        into.append(what)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float32())
            return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(found, kinds, strict=True)],
                            names=["query_id", "vec_id", "cell", "score"])

        def run(asking: DataFrame) -> DataFrame:
            return met.groupBy("lot", "block").cogroup(asking.groupBy("lot", "block")).applyInArrow(
                look, "query_id long, vec_id long, cell int, score float")

        best = _kept(run(probes.withColumn("least", F.lit(float("nan")).cast("float"))), "best")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"))
        kth = best.withColumn("r", F.row_number().over(by)).where(F.col("r") == k).select(
            "query_id", (F.col("score") - F.lit(model.margin + 1e-5)).cast("float").alias("known"))
        # a query with fewer than k rows in its cells takes them all
        limited = probes.join(kth, "query_id", "left").withColumn(
            "least", F.coalesce("known", F.lit(float("-inf")).cast("float"))).drop("known")
        return run(_kept(limited, "limited")).select("query_id", "vec_id", "cell")

    def topk(self, queries: DataFrame, k: int = 10, query_id_col: str = "query_id", vec_col: str = "embedding",
             digits: int | None = 6) -> DataFrame:
        """(QueryId, Rank, vec_id, Score, Scored): the k best by cosine among the candidates, ties by
        vec_id; Scored: the rows scored exactly for the query. Query ids are distinct."""
        few = self.candidates(queries, k, query_id_col, vec_col)
        q = _with_norm(usable(queries, query_id_col, vec_col, self.model.dims)
                       .select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_e")), "_e", "_v").drop("_e")
        own = self.rows().select("cell", "vec_id", "embedding")
        pairs = own.join(few, ["cell", "vec_id"]).select("query_id", "vec_id", "embedding").join(q, "query_id")
        pairs = _with_norm(pairs, "embedding", "_c")
        score = F.try_divide(_dot_of(F.col("_v"), F.col("_c"), self.model.dims), F.col("_v_norm") * F.col("_c_norm"))
        best = Window.partitionBy("query_id").orderBy(F.desc("_score"), "vec_id")
        ranked = pairs.select("query_id", "vec_id", score.alias("_score")).withColumn(
            "Scored", F.count("*").over(Window.partitionBy("query_id"))).withColumn("Rank", F.row_number().over(best))
        out = F.col("_score") if digits is None else rnd(F.col("_score"), digits)
        return ranked.where(F.col("Rank") <= k).select(
            F.col("query_id").alias("QueryId"), "Rank", "vec_id", out.alias("Score"), "Scored")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (own rows left out) that were found."""
    want = exact.where("QueryId <> vec_id").select("QueryId", "vec_id")
    have = found.select("QueryId", "vec_id").withColumn("hit", F.lit(1))
    return want.join(have, ["QueryId", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
