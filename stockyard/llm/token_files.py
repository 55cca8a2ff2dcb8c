"""Binary token files: a wavelet matrix for each shard of the corpus.

The corpus is cut into parts of about ``PART_BYTES`` of text in the order of document ids; only ids
and lengths are sorted for that, and the parts' first keys are all that the driver gets. Texts are
encoded in the map tasks, dealt by part and sorted within it. A task walks a part in order and closes a shard once it
holds ``SHARD_IDS`` ids (a text is never cut, so a shard is at most that much and one text). A shard is one
row: the planes of its ``WaveletMatrix`` with their rank directories, and id and end of each document.
``FILE_SHARDS`` shards at most make a file, zstd-compressed; a shard lies in one file as a whole. Files are
written by Spark's own writer, so they land in any store that Spark can write to, and a lost
task's files are written again.

Everything else works on the files alone. ``read`` decodes them in order; ``token_at``
looks up single places, ``token_counts`` counts ids by two ranks a plane, and
``token_places`` finds an id's occurrences by selects; none of the last three unpacks
the ids. Global starts come from the parts' totals: one number for each part.

Defined results: a null or empty text is its end id alone; a null id counts as the largest;
rows that share an id are ordered by a hash of their text and then by row, and each is written; other
columns are ignored; an empty table gives no file, and reading it an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm.common import keyed, longs, parts_for, slices, stored
from stockyard.llm.encoding import text_encoder
from stockyard.llm.wavelet import WaveletMatrix
from stockyard.session import scratch_path

END = 2                        # id that closes each document
SHARD_IDS = 1 << 20
FILE_SHARDS = 16
PART_BYTES, MAX_PARTS = 32 << 20, 50_000
ORDER = ["doc", "text_hash", "row"]
SHARD = ("part int, seq int, first long, n long, planes array<binary>, ones array<binary>, "
         "doc_ids array<long>, ends array<long>")
DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


def part_starts(docs: DataFrame) -> list[tuple[int, int, int]]:
    """First key (doc, text_hash, row) of each part, in order, for ``keyed`` docs with rows: at most
    MAX_PARTS, and one for each task that sorts the keys."""
    spark = docs.sparkSession
    light = stored(docs.select(*ORDER, F.octet_length("text").alias("size")), "text_sizes")
    n, total = light.agg(F.count("*"), F.sum("size")).first()
    each = max(PART_BYTES, (total or 0) // MAX_PARTS)

    def cut(batches):
        filled = None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = longs(batch.column("size"))
            before = np.cumsum(size) - size + (filled or 0)
            new = np.diff(before // each, prepend=-1 if filled is None else filled // each) != 0
            filled = int(before[-1] + size[-1])
            yield batch.select(ORDER).filter(pa.array(new))

    rows = light.repartitionByRange(parts_for(n, 5_000_000, spark), *ORDER).sortWithinPartitions(*ORDER).mapInArrow(
        cut, "doc long, text_hash long, row long").collect()
    return sorted(tuple(r) for r in rows)


def shard_row(part: int, seq: int, first: int, bodies: list[bytes], doc_ids: list, dtype: np.dtype,
              width: int) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(bodies), dtype=dtype)
    planes, ones = WaveletMatrix.of(ids, width).packed()
    ends = np.cumsum([len(b) // dtype.itemsize for b in bodies])
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()),
             pa.list_(pa.int64()), pa.list_(pa.int64())]
    cells = [part, seq, first, len(ids), planes, ones, doc_ids, ends]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)],
                                      names=[c.split(" ")[0] for c in SHARD.split(", ")])


def write(docs: DataFrame, target: str, path: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> str:
    """Token files of ``docs`` under ``target``."""
    named = keyed(docs).withColumn("row", F.monotonically_increasing_id())
    starts = part_starts(named)

    def encode(batches):
        encoder = text_encoder(path)
        close = encoder.packed([end])
        for batch in slices(batches):
            keys = zip(*(batch.column(c).to_pylist() for c in ORDER), strict=True)
            part = [max(0, bisect_right(starts, key) - 1) for key in keys]
            bodies = [encoder.encode(t) + close for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), *(batch.column(c) for c in (*ORDER, "doc_id")), pa.array(bodies, pa.binary())],
                names=["part", *ORDER, "doc_id", "body"])

    def build(batches):
        encoder = text_encoder(path)
        width = max(1, max(encoder.size - 1, end).bit_length())
        part, seq, first, size = -1, 0, 0, 0
        bodies: list[bytes] = []
        doc_ids: list[int | None] = []
        for batch in batches:
            for own, doc_id, body in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "body")), strict=True):
                if bodies and (own != part or size >= shard_ids):
                    yield shard_row(part, seq, first, bodies, doc_ids, encoder.dtype, width)
                    seq, first, size, bodies, doc_ids = seq + 1, first + size, 0, [], []
                if own != part:
                    part, seq, first = own, 0, 0
                bodies.append(body)
                doc_ids.append(doc_id)
                size += len(body) // encoder.dtype.itemsize
        if bodies:
            yield shard_row(part, seq, first, bodies, doc_ids, encoder.dtype, width)

    dealt = named.select(*ORDER, "doc_id", "text").mapInArrow(
        encode, "part int, doc long, text_hash long, row long, doc_id long, body binary")
    (dealt.repartitionById(max(1, len(starts)), "part").sortWithinPartitions("part", *ORDER)
     .select("part", "doc_id", "body").mapInArrow(build, SHARD)
     .write.option("maxRecordsPerFile", FILE_SHARDS).option("compression", "zstd").parquet(target))
    return target


def shards(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(target)


def bases(spark: SparkSession, target: str) -> dict[int, int]:
    """Ids before each part of the corpus: one number for each, at most MAX_PARTS and a few."""
    totals = shards(spark, target).groupBy("part").agg(F.sum("n").alias("n")).collect()
    out, at = {}, 0
    for part, n in sorted(tuple(r) for r in totals):
        out[part] = at
        at += n
    return out


def matrices(batches: Iterator[pa.RecordBatch]):
    """(row, matrix) of each shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            yield row, WaveletMatrix.unpacked(row["n"].as_py(), row["planes"].as_py(), row["ones"].as_py())


def _decoded(spark: SparkSession, target: str, schema: str, name: str, kind: pa.DataType, value: Callable) -> DataFrame:
    before = bases(spark, target)

    def run(batches):
        for row, matrix in matrices(batches):
            ids, ends = matrix.values(), np.array(row["ends"].as_py(), dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            base = before[row["part"].as_py()] + row["first"].as_py()
            step = 4096
            for a in range(0, len(ends), step):
                own = slice(a, a + step)
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values[own].cast(pa.int64()), pa.array(base + starts[own]),
                     pa.array(ends[own] - starts[own]),
                     pa.array([value(ids[i:j]) for i, j in zip(starts[own], ends[own], strict=True)], kind)],
                    names=["doc_id", "start", "n_tokens", name])

    return shards(spark, target).mapInArrow(run, schema)


def read(spark: SparkSession, target: str) -> DataFrame:
    """DOCUMENT for every document of the files: ``ids`` are little-endian unsigned 32-bit."""
    return _decoded(spark, target, DOCUMENT, "ids", pa.binary(), lambda ids: ids.tobytes())


def token_at(spark: SparkSession, target: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, position, token) for wanted (doc_id, position) pairs; a position outside its document,
    or an unknown id, gives a null token."""
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position")).distinct()
    places = shards(spark, target).select("part", "seq", "ends", F.posexplode("doc_ids").alias("at", "doc_id")).select(
        "part", "seq", "doc_id", F.col("ends")[F.col("at")].alias("stop"),
        F.when(F.col("at") > 0, F.col("ends")[F.col("at") - 1]).otherwise(0).alias("start"))
    inside = asked.join(places, "doc_id").filter("position >= 0 AND start + position < stop").select(
        "part", "seq", "doc_id", "position", (F.col("start") + F.col("position")).alias("place"))

    def look(key, left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = np.zeros(0, dtype=np.int64)
        if left.num_rows and right.num_rows:
            _, matrix = next(matrices(iter(left.combine_chunks().to_batches())))
            tokens = matrix.access(right["place"].to_numpy()).astype(np.int64)
        return pa.table([right["doc_id"], right["position"], pa.array(tokens, pa.int64())], names=["doc_id", "position", "token"])

    found = shards(spark, target).groupBy("part", "seq").cogroup(inside.groupBy("part", "seq")).applyInArrow(
        look, "doc_id long, position long, token long")
    return asked.join(found, ["doc_id", "position"], "left")


def token_counts(spark: SparkSession, target: str, tokens: list[int]) -> DataFrame:
    """(token, n) over all files, for the asked ids."""
    def run(batches):
        for _, matrix in matrices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()),
                                              pa.array([matrix.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return shards(spark, target).select("n", "planes", "ones").mapInArrow(run, "token long, n long").groupBy(
        "token").agg(F.sum("n").alias("n"))


def token_places(spark: SparkSession, target: str, token: int) -> DataFrame:
    """(doc_id, position) of every occurrence of ``token``."""
    def run(batches):
        for row, matrix in matrices(batches):
            ends = np.array(row["ends"].as_py(), dtype=np.int64)
            for a in range(0, matrix.count(token), 1 << 16):
                k = np.arange(a, min(a + (1 << 16), matrix.count(token)))
                at = matrix.select(token, k)
                doc = np.searchsorted(ends, at, side="right")
                starts = np.concatenate([[0], ends[:-1]])[doc]
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values.take(pa.array(doc)), pa.array(at - starts)],
                                                 names=["doc_id", "position"])

    return shards(spark, target).mapInArrow(run, "doc_id long, position long")


def digest(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    target = write(docs, scratch_path(spark, "token_files"))
    return _decoded(spark, target, "doc_id long, start long, n_tokens long, ids_crc32 long", "ids_crc32", pa.int64(),
                    lambda ids: zlib.crc32(ids.tobytes()))
