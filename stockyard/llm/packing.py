"""Cost-balanced packing of token ids into training sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (dense layers and
attention within the piece). Rows are dealt into buckets of about BUCKET_DOCS rows by their
place in the table, so that repeated rows spread like any others;
full stretches of ``capacity`` tokens are sequences of their own, and the rests of
a bucket are assigned in descending order to the sequence of the lowest cost so
far that still has room for them. The bucket opens just as many sequences as its
tokens need, so a rest that fits nowhere whole is cut over the cheapest
sequences with room, and at most one sequence of a bucket is not full.

Tokenizing runs in the map tasks; only the rests' ids are shuffled, two bytes
each for vocabularies below 65,536.

Defined results: a null or empty text is the closing id alone; each row is
packed, so repeated rows each get their pieces; null ids stay null; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import keyed, parts_for, slices
from stockyard.llm.encoding import text_encoder

CAPACITY = 1024
END = 0                       # id that closes each document
BUCKET_DOCS = 4096
LINEAR, QUADRATIC = 12_288.0, 4.0     # multiply-adds of a token; of a pair of tokens
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def assign(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """Pieces (start in the rest, length, sequence, offset) of each rest.

    ``sizes`` descend; the k-th list belongs to the k-th rest.
    """
    sequences = -(-sum(sizes) // capacity)
    used = [0] * sequences
    heap = [(0.0, s) for s in range(sequences)]

    def put(cost: float, s: int, size: int) -> None:
        used[s] += size
        if used[s] < capacity:
            heapq.heappush(heap, (cost + LINEAR * size + QUADRATIC * size * size, s))

    out = []
    for size in sizes:
        passed = []
        while heap and capacity - used[heap[0][1]] < size:
            passed.append(heapq.heappop(heap))
        pieces = []
        if heap:
            cost, s = heapq.heappop(heap)
            pieces.append((0, size, s, used[s]))
            put(cost, s, size)
            for other in passed:
                heapq.heappush(heap, other)
        else:                   # no sequence has room: cut over the cheapest ones
            at = 0
            for n, (cost, s) in enumerate(passed):
                take = min(size - at, capacity - used[s])
                pieces.append((at, take, s, used[s]))
                put(cost, s, take)
                at += take
                if at == size:
                    for other in passed[n + 1:]:
                        heapq.heappush(heap, other)
                    break
        out.append(pieces)
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None,
           with_ids: bool = True) -> DataFrame:
    """Pieces (PIECES): ``ids`` holds the piece's ids, little-endian unsigned 32-bit
    (null without ``with_ids``)."""
    rows = docs.count()
    buckets = max(1, -(-rows // BUCKET_DOCS))
    row = F.monotonically_increasing_id()       # the same again for a scan that is read again
    named = keyed(docs).withColumn("bucket", F.pmod(F.xxhash64("doc", row), F.lit(buckets)))

    def tokenize(batches):
        encoder = text_encoder(path)
        width, close = encoder.dtype, encoder.packed([END])
        for batch in slices(batches):
            total, crcs, bodies = [], [], []
            for text in batch.column("text").to_pylist():
                body = encoder.encode(text) + close
                n = len(body) // width.itemsize
                full = n // capacity * capacity
                ids = np.frombuffer(body, dtype=width, count=full).astype("<u4")
                total.append(n)
                crcs.append([crc(ids[i:i + capacity]) for i in range(0, full, capacity)])
                bodies.append(body if with_ids else body[full * width.itemsize:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket"), batch.column("doc"), batch.column("text_hash"), batch.column("doc_id"),
                 pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(bodies, pa.binary()),
                 pa.array([width.itemsize] * len(total), pa.int32())],
                names=["bucket", "doc", "text_hash", "doc_id", "total", "crcs", "body", "width"])

    def fill(batches):
        key, members = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "doc", "text_hash", "doc_id", "total", "crcs", "body", "width")]
            for row in zip(*(c.to_pylist() for c in columns), strict=True):
                if row[0] != key and members:
                    yield sequences(key, members)
                    members = []
                key = row[0]
                members.append(row[1:])
        if members:
            yield sequences(key, members)

    def sequences(bucket, members):
        """All pieces of a bucket; its packed sequences come before the full ones."""
        members.sort(key=lambda m: (-(m[3] % capacity), m[0], m[1]))
        plan = assign([m[3] % capacity for m in members if m[3] % capacity], capacity)
        plan += [[]] * (len(members) - len(plan))
        following = (bucket << 32) + -(-sum(m[3] % capacity for m in members) // capacity)
        out = []
        for (_, _, doc_id, total, crcs, body, width), pieces in zip(members, plan, strict=True):
            ids = np.frombuffer(body, dtype=f"<u{width}").astype("<u4")
            full = len(crcs) * capacity
            for i, value in enumerate(crcs):
                own = ids[i * capacity:(i + 1) * capacity].tobytes() if with_ids else None
                out.append((doc_id, i * capacity, capacity, value, total, following, 0, own))
                following += 1
            rest = ids[full if with_ids else 0:]
            for start, length, s, offset in pieces:
                own = rest[start:start + length]
                out.append((doc_id, full + start, length, crc(own), total, (bucket << 32) + s, offset,
                            own.tobytes() if with_ids else None))
        names = [c.split(" ")[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if n != "ids" else pa.binary()) for n, c in zip(names, zip(*out), strict=True)],
            names=names)

    return (named.select("bucket", "doc", "text_hash", "doc_id", "text").mapInArrow(
        tokenize, "bucket long, doc long, text_hash long, doc_id long, total long, crcs array<long>, "
                  "body binary, width int")
        .repartition(parts_for(buckets, 8, docs.sparkSession), "bucket").sortWithinPartitions("bucket")
        .mapInArrow(fill, PIECES))


def digest(docs: DataFrame) -> DataFrame:
    return packed(docs, with_ids=False).drop("ids")
