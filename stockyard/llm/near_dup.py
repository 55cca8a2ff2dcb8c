"""Near-duplicate documents by fast similarity sketching.

A document's set is that of its distinct word shingles. Its sketch of T
coordinates is filled in rounds: in round i every shingle is thrown into one
hashed bin with the value (i, hash), and a bin keeps its least value; after T
rounds the bin is forced, so every coordinate fills within 2 T rounds even for a
set of one element, and a large set is done after one or two. Coordinates agree
with probability equal to the sets' resemblance, with the concentration of
independent min-hashes. ``ROWS`` coordinates make a band; documents that agree on
a band are candidates. A pair at a limit of 0.85 is missed with probability
(1 - 0.85**6)**42 = 2e-9, one at 0.8 with 3e-6.

Equal sets are one node from the start. Within a bucket each node is tied to
the bucket's least node (in each task first, then overall), never to all
others, so candidate edges grow with the documents. The connected clusters of
candidates are then verified on full sets: in each cluster every pair that is
not connected yet is compared exactly. A cluster beyond ``CHUNK`` shingles is cut
into chunks, and every pair of chunks is compared by itself. Verified links are
connected again, and every document gets the least id it reaches.

Defined results: a null or blank text has an empty set, links with nothing and
is kept; fewer words than a shingle form one shingle; nodes are sets, so rows
that share an id but not a text are told apart, and repeated rows share a
component; a null id counts as the largest, a component of null ids alone has a
null id and its rows are kept; other columns are ignored by ``classes`` and
passed through by ``deduplicated``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.arrays import SPACE_LOWER_TABLE, Words, mix, text_bytes
from stockyard.llm.common import NO_ID, keyed, longs, parts_for, slices, stored
from stockyard.llm.graph import components

ROWS, BANDS = 6, 42
COORDINATES = ROWS * BANDS
CHUNK = 1_000_000           # shingles compared in one group
FLUSH_ROWS = 1_000_000
LINK = np.dtype([("bucket", "<u8"), ("node", "<i8")])


def shingles(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words = Words(*text_bytes(batch.column("text")), SPACE_LOWER_TABLE, zero_is_word=True)
    hashes = words.hashes()
    joined = hashes.copy()
    for n in range(1, size):
        joined[:len(hashes) - n] = mix(joined[:len(hashes) - n] * np.uint64(0x9E3779B97F4A7C15)
                                       + hashes[n:], n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a:b - size + 1]))
        elif b > a:             # the whole sequence as one shingle
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = mix(np.array([whole ^ h]), size + 1)[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketches(sets: list[np.ndarray], size: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of each (non-empty) set, one row of ``size`` values each."""
    sketch = np.full(len(sets) * size, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not sets:
        return sketch.reshape(0, size)
    elements = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    low = np.uint64((1 << 40) - 1)
    for i in range(2 * size):
        value = mix(elements, i + 1)
        bins = (value >> np.uint64(40)).astype(np.int64) % size if i < size else i - size
        np.minimum.at(sketch, row * size + bins, (value & low) | np.uint64(i << 40))
        open_rows = (sketch.reshape(-1, size) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_rows.any():
            break
        stay = open_rows[row]
        if not stay.all():
            elements, row = elements[stay], row[stay]
    return sketch.reshape(-1, size)


def band_values(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of each sketch; the band's number is part of it."""
    bands = sketch.shape[1] // rows
    value = np.tile(np.arange(bands, dtype=np.uint64), (len(sketch), 1))
    for n in range(rows):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + sketch[:, n:bands * rows:rows], 7)
    return value


def described(docs: DataFrame, size: int) -> DataFrame:
    """(doc, text_hash, n, h1, h2, bands): size, 128-bit hash and bands of each set."""
    def describe(batches):
        for batch in slices(batches):
            sets = shingles(batch, size)
            full = [s for s in sets if len(s)]
            bands = iter(band_values(sketches(full)).astype("<u8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("text_hash"),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(np.array([mix(s, 1).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                 pa.array(np.array([mix(s, 2).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                 pa.array([next(bands).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc", "text_hash", "n", "h1", "h2", "bands"])

    return docs.select("doc", "text_hash", "text").mapInArrow(
        describe, "doc long, text_hash long, n long, h1 long, h2 long, bands binary")


def stars(links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by bucket; -> the least node of each bucket (as links) and the edges to it."""
    links = links[np.lexsort((links["node"], links["bucket"]))]
    new = np.ones(len(links), dtype=bool)
    new[1:] = links["bucket"][1:] != links["bucket"][:-1]
    hub = links["node"][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(links) else links["node"]
    edge = np.unique(np.stack([links["node"], hub], axis=1)[links["node"] != hub], axis=0)
    return links[new], edge[:, 0], edge[:, 1]


def candidate_edges(nodes: DataFrame, parts: int) -> DataFrame:
    """(a, b): each node of a bucket with the bucket's least node. Each task ties its
    own nodes first and deals out only its least node of each bucket."""
    packed = "part int, body binary, a array<long>, b array<long>"

    def deal(links):
        links, a, b = stars(links)
        part = (mix(links["bucket"], 9) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at = np.searchsorted(part[order], np.arange(parts + 1))
        have = np.flatnonzero(np.diff(at))
        edges = pa.array([a] + [None] * (len(have) - 1), pa.list_(pa.int64())), pa.array(
            [b] + [None] * (len(have) - 1), pa.list_(pa.int64()))
        bodies = pa.array([links[order[at[p]:at[p + 1]]].tobytes() for p in have], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), bodies, *edges],
                                          names=["part", "body", "a", "b"])

    def emit(batches):
        held, size = [], 0
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), dtype="<u8")
            out = np.empty(len(bands), dtype=LINK)
            out["bucket"] = bands
            out["node"] = np.repeat(longs(batch.column("node")), BANDS)
            held.append(out)
            size += len(out)
            if size >= FLUSH_ROWS:
                yield deal(np.concatenate(held))
                held, size = [], 0
        if size:
            yield deal(np.concatenate(held))

    def tie(batches):
        held, a, b = [], [], []
        for batch in batches:
            held += [np.frombuffer(x, dtype=LINK) for x in batch.column("body").to_pylist()]
            a += [x for x in batch.column("a").to_pylist() if x]
            b += [x for x in batch.column("b").to_pylist() if x]
        _, more_a, more_b = stars(np.concatenate(held) if held else np.zeros(0, dtype=LINK))
        flat = lambda known, more: np.concatenate([np.array(x, dtype=np.int64) for x in known] + [more])
        yield pa.RecordBatch.from_arrays([pa.array(flat(a, more_a)), pa.array(flat(b, more_b))], names=["a", "b"])

    return nodes.select("node", "bands").mapInArrow(emit, packed).repartition(parts, "part").mapInArrow(
        tie, "a long, b long").distinct()


def linked(node: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Exact links among the sets: each node that gets one, with the least node it reaches."""
    n = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(n)
    starts = ends - n
    flag = np.zeros(int(codes.max()) + 1 if len(codes) else 1, dtype=np.int32)
    root = np.arange(len(sets))
    for x in range(len(sets)):
        other = (root != root[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        other[:x] = False
        rest = np.flatnonzero(other)
        if not len(rest):
            continue
        own = codes[starts[x]:ends[x]]
        flag[own] = 1
        if 2 * len(rest) > len(sets):
            shared = np.add.reduceat(flag[codes], starts)[rest]
        else:
            size = n[rest]
            put = np.cumsum(size) - size
            shared = np.add.reduceat(flag[codes[np.arange(int(size.sum())) + np.repeat(starts[rest] - put, size)]], put)
        flag[own] = 0
        for y in rest[100 * shared >= percent * (n[rest] + n[x] - shared)]:
            if root[y] != root[x]:
                a, b = sorted((root[x], root[y]), key=lambda r: node[r])
                root[root == b] = a
    return [(int(node[i]), int(node[r])) for i, r in enumerate(root) if r != i]


def verified(clusters: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int,
             parts: int) -> DataFrame:
    """(a, b): exact links inside the clusters, as ties to the least node reached."""
    weight = clusters.join(nodes.select("node", "n"), "node").groupBy("component").agg(F.sum("n").alias("total"))
    member = (clusters.join(nodes.select("node", F.col("doc"), "text_hash"), "node")
              .join(weight, "component"))

    def shingled(batches):
        for batch in slices(batches):
            sets = shingles(batch, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("component"), batch.column("total"), batch.column("node"),
                 pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["component", "total", "node", "body"])

    texts = docs.select("doc", "text_hash", "text").join(member, ["doc", "text_hash"]).dropDuplicates(
        ["doc", "text_hash"]).select("component", "total", "node", "text")
    rows = texts.mapInArrow(shingled, "component long, total long, node long, body binary")
    count = F.greatest(F.lit(1), F.ceil(F.col("total") * 2 / F.lit(CHUNK))).cast("int")
    rows = rows.withColumn("count", F.when(F.col("total") <= CHUNK, F.lit(1)).otherwise(count))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("count")).cast("int"))
    # a chunk meets every chunk: the pair (i, j) with i <= j is one group
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    rows = rows.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with"))

    def compare(batches):
        key, node, sets = None, [], []

        def done():
            return linked(np.array(node), sets, percent) if len(node) > 1 else []

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "node", "body")]
            for c, i, j, v, body in zip(*columns, strict=True):
                if (c, i, j) != key:
                    out += done()
                    key, node, sets = (c, i, j), [], []
                node.append(v)
                sets.append(np.frombuffer(body, dtype=np.uint64))
            yield edge_batch(out)
        yield edge_batch(done())

    return (rows.select("component", "i", "j", "node", "body")
            .repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
            .mapInArrow(compare, "a long, b long"))


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])


def resolved(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc, text_hash, n, leader, leader_hash): for each row of ``keyed`` docs its
    component's least document; null for an empty set."""
    spark = docs.sparkSession
    each = stored(described(docs, size), "described")
    full = each.filter("n > 0")
    nodes = stored(
        full.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc", "text_hash")).alias("least"),
                                          F.first("bands").alias("bands"))
        .select("h1", "h2", "n", F.col("least.doc").alias("doc"), F.col("least.text_hash").alias("text_hash"),
                "bands", F.monotonically_increasing_id().alias("node")), "nodes")
    parts = parts_for(nodes.count() * BANDS, 2_000_000, spark)
    clusters = stored(components(candidate_edges(nodes, parts), "candidates"), "clusters")
    clustered = clusters.join(nodes.select("node", "n"), "node").agg(F.sum("n")).first()[0] or 0
    links = stored(verified(clusters, nodes, docs, size, percent, parts_for(int(clustered), CHUNK, spark)), "links", large=True)
    found = components(links, "components")
    owner = nodes.select("node", "doc", "text_hash", "h1", "h2", "n").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = owner.groupBy("component").agg(F.min(F.struct("doc", "text_hash")).alias("least"))
    of_set = stored(owner.join(least, "component").select(
        "h1", "h2", "n", F.col("least.doc").alias("leader"), F.col("least.text_hash").alias("leader_hash")), "sets")
    out = each.select("doc", "text_hash", "n", "h1", "h2").join(of_set, ["h1", "h2", "n"], "left")
    return out.select("doc", "text_hash", "n",
                      F.when(F.col("n") > 0, F.col("leader")).alias("leader"),
                      F.when(F.col("n") > 0, F.col("leader_hash")).alias("leader_hash"))


def classes(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    own = F.when(F.col("doc") != NO_ID, F.col("doc"))
    leader = F.coalesce("leader", "doc")
    component = F.when(leader != NO_ID, leader)
    return resolved(keyed(docs), size, percent).select(
        own.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        own.eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: its least id (one row of it);
    documents without words all stay."""
    columns = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                              "__hash": F.xxhash64(text)})
    out = resolved(keyed(docs), size, percent)
    stay = out.filter("leader is null or (doc = leader and text_hash = leader_hash)").select(
        F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    return named.join(stay, ["__doc", "__hash"]).dropDuplicates(["__doc", "__hash"]).select(*columns)


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
shingle AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s
  FROM d),
size AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN size a ON a.r = x JOIN size b ON b.r = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS r, x AS t FROM edge UNION SELECT reach.r, edge.y FROM reach JOIN edge ON edge.x = reach.t)
,
component AS (SELECT r, min(doc_id) AS c FROM (SELECT r, t FROM reach UNION SELECT r, r FROM d) p
              JOIN (SELECT r AS t, doc_id FROM d) USING (t) GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, doc_id IS NOT DISTINCT FROM c AS kept
FROM d LEFT JOIN size USING (r) JOIN component USING (r)
"""
