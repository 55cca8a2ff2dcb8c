"""Repeated windows of a corpus, found through content-chosen triggers.

A sequence (bytes or words) is cut at *triggers*: in every window of ``length``
units the k-gram with the smallest rolling hash is its trigger, so equal
windows have the same trigger at the same place wherever they stand. The
windows of one document that share one trigger position form a *phrase*, which
overlaps its neighbours by ``length - 1`` units: every window lies within
exactly one phrase, and two phrases can share a window only if they share the
trigger's k-gram. That gives three steps:

1. **Phrases.** Each task emits (trigger hash, phrase hash, document, start)
   for its documents, keeping of equal phrases only the earliest; the rest are
   repeats already. Rows are dealt by trigger hash.
2. **Dictionary.** Of equal phrases in the corpus the earliest occurrence
   stays, all others are repeats. An earliest occurrence whose trigger occurs in
   no other phrase has no window in common with anything and is done.
3. **Matching.** The other phrases - they touch the rim of a repeat - are dealt
   with their units to blocks by trigger, and the caller's ``match`` compares
   what is in a block (by suffixes, or by factors).

Hot triggers (a passage met with countless contexts) are recognised in the
task that meets several of their phrases; their windows are dealt one by one, by
(trigger, window), so a task gets at most a few rows per trigger from each other task.
Every step passes on one row for each repeat or open phrase, however the work is dealt, so
rows grow with the text alone. Phrases, and windows of hot triggers, are equal by two 64-bit hashes
(of the trigger and of the whole).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.arrays import RollingHash, mix, sliding_min
from stockyard.llm.common import keyed, longs, parts_for, slices, stored, text_bytes_total

FLUSH_ROWS = 250_000        # phrases (or windows) gathered before they are dealt out
HOT_PHRASES, HOT_SHARE = 8, 1e-3      # phrases of one trigger in one flush that make it hot: both as many and this share
SEGMENT = 1 << 20           # units of one document handled at a time
POSITION_BITS = np.uint64(24)
DEALT = "part int, body binary"
FOUND = "doc long, text_hash long, start long, stop long, ref_doc long, ref_start long, trigger long, hot boolean"
BLOCKS = "part int, doc long, text_hash long, start long, body binary, hot boolean"

# A record is one phrase or window; `hot` says how it is dealt (see above).
RECORD = np.dtype([("trigger", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("text", "<i8"),
                   ("start", "<i8"), ("count", "<i4"), ("hot", "i1")])
# Repeated units [start, stop) of a document, and where they stood before. Dealt as a record, its
# length is a negative count and the reference is in the two hashes' place.
RUN = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<i8"), ("stop", "<i8"), ("ref_doc", "<i8"), ("ref_start", "<i8")])
MARK = -1                   # hash column unused: the row only says that its trigger is hot


PLACES = ("start", "count")       # columns packed as differences, byte plane by byte plane


def pack(records: np.ndarray) -> bytes:
    """Column by column. Records come in order of their place, so documents repeat and
    places grow; the shuffle's compression then leaves little but the hashes."""
    out = []
    for name in records.dtype.names:
        column = np.ascontiguousarray(records[name])
        if name in PLACES:
            column = np.diff(column, prepend=column.dtype.type(0)).view(np.uint8).reshape(len(column), -1).T
        out.append(column.tobytes())
    return b"".join(out)


def unpack(body: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(body) // dtype.itemsize
    out, at = np.empty(n, dtype=dtype), 0
    for name in dtype.names:
        kind = dtype[name]
        column = np.frombuffer(body, dtype=np.uint8, count=n * kind.itemsize, offset=at)
        if name in PLACES:
            out[name] = np.cumsum(np.ascontiguousarray(column.reshape(kind.itemsize, n).T).view(kind)[:, 0])
        else:
            out[name] = column.view(kind)
        at += n * kind.itemsize
    return out


def phrases(values: np.ndarray, bounds: np.ndarray, length: int, k: int):
    """Phrases of all pieces ``values[bounds[i]:bounds[i + 1]]``:
    (first window, number of windows, piece, trigger hash, phrase hash)."""
    none = np.zeros(0, dtype=np.int64)
    if len(values) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolled = RollingHash(values)
    grams = mix(rolled.every(k))
    low = np.uint64((1 << int(POSITION_BITS)) - 1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    trigger = (least & low).astype(np.int64)
    pieces = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(trigger)]
    whole = np.arange(len(trigger)) + length <= bounds[1:][pieces]
    new = whole.copy()
    new[1:] &= (trigger[1:] != trigger[:-1]) | ~whole[:-1] | (pieces[1:] != pieces[:-1])
    start = np.flatnonzero(new)
    count = np.bincount((np.cumsum(new) - 1)[whole], minlength=len(start))
    body = mix(rolled.at(start, start + count - 1 + length) + count.astype(np.uint64))
    return start, count, pieces[start], grams[trigger[start]], body


def segments(bounds: np.ndarray, length: int, segment: int):
    """Cut pieces longer than ``segment``; neighbours overlap by length - 1, so that
    each window lies in exactly one. -> (start, stop, piece) of each segment."""
    start, stop, piece = [], [], []
    for i in np.flatnonzero(np.diff(bounds) > segment):
        for a in range(int(bounds[i]), int(bounds[i + 1]), segment):
            start.append(a)
            stop.append(min(a + segment + length - 1, int(bounds[i + 1])))
            piece.append(int(i))
    return start, stop, piece


def earliest(rows: np.ndarray, by_document: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by (trigger, hash, doc, start); mark rows with an earlier equal one, and give each
    row's earliest equal one."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["hash"], rows["trigger"]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows["trigger"][1:] != rows["trigger"][:-1]) | (rows["hash"][1:] != rows["hash"][:-1])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(rows) else np.zeros(0, dtype=np.int64)
    later = rows["doc"] > rows["doc"][lead]
    if not by_document:
        later |= (rows["doc"] == rows["doc"][lead]) & (rows["start"] > rows["start"][lead])
    return rows, later, lead


def runs_of(rows: np.ndarray, later: np.ndarray, lead: np.ndarray, length: int) -> np.ndarray:
    """The later rows as runs."""
    out = np.empty(int(later.sum()), dtype=RUN)
    own, first = rows[later], rows[lead[later]]
    for name in ("doc", "text", "start"):
        out[name] = own[name]
    out["stop"] = own["start"] + own["count"] - 1 + length
    out["ref_doc"], out["ref_start"] = first["doc"], first["start"]
    return out


def joined(runs: np.ndarray) -> np.ndarray:
    """Merge runs of a document that adjoin or overlap and repeat the same stretch."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs["start"], runs["start"] - runs["ref_start"], runs["ref_doc"], runs["text"], runs["doc"]))]
    new = np.ones(len(runs), dtype=bool)
    same = runs["start"] - runs["ref_start"]
    new[1:] = ((runs["doc"][1:] != runs["doc"][:-1]) | (runs["text"][1:] != runs["text"][:-1])
               | (runs["ref_doc"][1:] != runs["ref_doc"][:-1]) | (same[1:] != same[:-1])
               | (runs["start"][1:] > runs["stop"][:-1]))
    out = runs[new].copy()
    out["stop"] = np.maximum.reduceat(runs["stop"], np.flatnonzero(new))
    return out


def crowded(rows: np.ndarray) -> np.ndarray:
    """Of rows sorted by (trigger, hash): the number of different hashes of each row's trigger."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    new_trigger = np.ones(len(rows), dtype=bool)
    new_trigger[1:] = rows["trigger"][1:] != rows["trigger"][:-1]
    new = new_trigger.copy()
    new[1:] |= rows["hash"][1:] != rows["hash"][:-1]
    group = np.cumsum(new_trigger) - 1
    return np.bincount(group[new], minlength=group[-1] + 1)[group]


def found_batches(runs: np.ndarray, left: np.ndarray, length: int, step: int = 100_000) -> Iterator[pa.RecordBatch]:
    """A row of FOUND for each run, and for each phrase left open."""
    names = [c.split(" ")[0] for c in FOUND.split(", ")]
    for a in range(0, len(runs), step):
        own = runs[a:a + step]
        none = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(own[c])) for c in RUN.names), none,
                                          pa.nulls(len(own), pa.bool_())], names=names)
    for a in range(0, len(left), step):
        own = left[a:a + step]
        none = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(np.ascontiguousarray(own[c])) for c in ("doc", "text", "start")),
             pa.array(own["start"] + own["count"] - 1 + length), none, none,
             pa.array(np.ascontiguousarray(own["trigger"]).view(np.int64)), pa.array(own["hot"] == 1)], names=names)


def dealt(rows: np.ndarray, runs: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """(part, packed rows) for each part. Hot rows go by (trigger, hash), others by
    trigger; known runs go by document and are only carried along (count < 0)."""
    known = np.zeros(len(runs), dtype=RECORD)
    for name in ("doc", "text", "start"):
        known[name] = runs[name]
    known["count"] = runs["start"] - runs["stop"]
    known["trigger"], known["hash"] = runs["ref_doc"].view(np.uint64), runs["ref_start"].view(np.uint64)
    key = np.where(rows["hot"] == 1, mix(rows["trigger"] ^ rows["hash"], 1), mix(rows["trigger"], 2))
    key = np.concatenate([key, mix(known["doc"].astype(np.uint64) ^ known["text"].astype(np.uint64), 3)])
    part = (key % np.uint64(parts)).astype(np.int64)
    every = np.concatenate([rows, known])
    order = np.lexsort((every["start"], every["text"], every["doc"], part))
    at = np.searchsorted(part[order], np.arange(parts + 1))
    have = np.flatnonzero(np.diff(at))
    return have.tolist(), [pack(every[order[at[p]:at[p + 1]]]) for p in have]


def flushed(rows: np.ndarray, by_document: bool, parts: int, many: int, length: int) -> pa.RecordBatch:
    """Pre-aggregate the phrases of a flush and deal them out."""
    rows, later, lead = earliest(rows, by_document)
    keep = rows[~later]
    hot = crowded(keep) >= max(many, int(len(rows) * HOT_SHARE))
    keep["hot"] = hot
    marks = keep[hot]
    marks = marks[np.unique(marks["trigger"], return_index=True)[1]].copy()
    marks["hot"] = MARK
    part, body = dealt(np.concatenate([keep, marks]), joined(runs_of(rows, later, lead, length)), parts)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(body, pa.binary())], names=["part", "body"])


def gathered(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(records, known runs) of packed bodies."""
    found = [unpack(b, RECORD) for b in bodies]
    rows = np.concatenate(found) if found else np.zeros(0, dtype=RECORD)
    carried = rows[rows["count"] < 0]
    runs = np.empty(len(carried), dtype=RUN)
    for name in ("doc", "text", "start"):
        runs[name] = carried[name]
    runs["stop"] = carried["start"] - carried["count"]
    runs["ref_doc"], runs["ref_start"] = carried["trigger"].view(np.int64), carried["hash"].view(np.int64)
    return rows[rows["count"] > 0], runs


def window_classes(keys: np.ndarray, width: int, at: np.ndarray, length: int) -> np.ndarray:
    """Rank, in suffix order, of the ``length`` units from each place in ``at``; equal windows have
    equal ranks. ``keys`` order the first ``width`` units at each place; ranks of twice the width
    come from pairs of ranks (prefix doubling), up to ``length``."""
    rank = np.unique(keys, return_inverse=True)[1].astype(np.uint64)
    while 2 * width <= length:
        rank = np.unique(rank[:-width] << np.uint64(32) | rank[width:], return_inverse=True)[1].astype(np.uint64)
        width *= 2
    rest = length - width
    return np.unique(rank[at] << np.uint64(32) | rank[at + rest], return_inverse=True)[1]


def window_places(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, phrase) of every window of phrases ``bounds[i]:bounds[i + 1]``."""
    count = np.diff(bounds) - length + 1
    phrase = np.repeat(np.arange(len(count)), count)
    return bounds[:-1][phrase] + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count), phrase


def repeated_ranges(docs: DataFrame, units: Callable, match: Callable, dtype: np.dtype, length: int, k: int,
                    by_document: bool, units_per_byte: float, block: int, many: int = HOT_PHRASES,
                    segment: int = SEGMENT) -> DataFrame:
    """(doc, text_hash, start, stop, ref_doc, ref_start): for every document of ``keyed`` docs, runs of units
    covered by windows that start earlier, and where.

    ``units(batch) -> (values, bounds)`` gives the sequence of each row, values of ``dtype``.
    ``match(values, bounds, doc, text, start, length) -> RUN rows`` compares the phrases of a block
    (about ``block`` units). ``by_document``: only a smaller doc counts as earlier, not the same one.
    ``many`` phrases of a trigger in one flush make it hot.
    """
    spark = docs.sparkSession
    amount = int(text_bytes_total(docs) * units_per_byte)
    parts = parts_for(2 * amount // (length - k + 2), 700_000, spark)

    def emit(batches):
        held, size = [], 0
        for batch in slices(batches):
            values, bounds = units(batch)
            doc, text = longs(batch.column("doc")), longs(batch.column("text_hash"))
            pieces = [(values, bounds, np.arange(len(doc)), np.zeros(len(doc), dtype=np.int64))]
            seg = segments(bounds, length, segment)
            if seg[0]:
                cut = np.diff(bounds) > segment
                pieces = [(values[a:b], np.array([0, b - a]), np.array([p]), np.array([a - bounds[p]]))
                          for a, b, p in zip(*seg, strict=True)]
                pieces += [(values[bounds[i]:bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]),
                            np.array([i]), np.array([0])) for i in np.flatnonzero(~cut)]
            for part, limits, row, shift in pieces:
                start, count, piece, trigger, body = phrases(part, limits, length, k)
                out = np.zeros(len(start), dtype=RECORD)
                out["trigger"], out["hash"], out["count"] = trigger, body, count
                out["doc"], out["text"] = doc[row[piece]], text[row[piece]]
                out["start"] = start - limits[piece] + shift[piece]
                held.append(out)
                size += len(out)
            if size >= FLUSH_ROWS:
                yield flushed(np.concatenate(held), by_document, parts, many, length)
                held, size = [], 0
        if size:
            yield flushed(np.concatenate(held), by_document, parts, many, length)

    def decide(batches):
        rows, known = gathered([b for batch in batches for b in batch.column("body").to_pylist()])
        marked = np.unique(rows["trigger"][rows["hot"] == MARK])
        rows, later, lead = earliest(rows[rows["hot"] != MARK], by_document)
        runs, keep = np.concatenate([runs_of(rows, later, lead, length), known]), rows[~later]
        hot = (keep["hot"] == 1) | np.isin(keep["trigger"], marked)
        left = keep[hot | (crowded(keep) > 1)]
        left["hot"] = hot[hot | (crowded(keep) > 1)]
        del rows, keep
        yield from found_batches(runs, left, length)

    first = stored(docs.select("doc", "text_hash", "text").mapInArrow(emit, DEALT)
                   .repartitionById(parts, "part").mapInArrow(decide, FOUND), "phrases", large=True)

    spare = first.filter("trigger is not null")
    parts2 = parts_for(spare.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0, block, spark)

    def emit_blocks(batches):
        """Open phrases with their units, by trigger; windows of hot triggers, by window."""
        held, size = [], 0
        for batch in slices(batches):
            values, bounds = units(batch)
            out: list[tuple] = []
            for i, (doc, text, lists) in enumerate(zip(
                    batch.column("doc").to_pylist(), batch.column("text_hash").to_pylist(),
                    batch.column("open"), strict=True)):
                start, stop, trigger, hot = (lists.values.field(c).to_numpy(zero_copy_only=False)
                                             for c in ("start", "stop", "trigger", "hot"))
                at = np.unique(start, return_index=True)[1]    # repeated rows give each phrase twice
                start, stop, trigger, hot = start[at], stop[at], trigger[at], hot[at]
                part = (mix(trigger.view(np.uint64), 2) % np.uint64(parts2)).astype(np.int64)
                out += [(int(part[j]), doc, text, int(start[j]), values[bounds[i] + start[j]:bounds[i] + stop[j]].tobytes(), False)
                        for j in np.flatnonzero(~hot)]
                start, stop, trigger = start[hot], stop[hot], trigger[hot]
                a = 0
                while a < len(start):                         # a stretch of a very long text at a time
                    base = int(start[a])
                    upto = max(a + 1, int(np.searchsorted(start, base + segment)))
                    rolled = RollingHash(values[bounds[i] + base:bounds[i] + int(stop[a:upto].max())])
                    place, phrase = window_places(np.concatenate([[0], np.cumsum(stop[a:upto] - start[a:upto])]), length)
                    count = stop[a:upto] - start[a:upto]
                    begin = start[a:upto][phrase] + place - (np.cumsum(count) - count)[phrase]
                    rows = np.zeros(len(begin), dtype=RECORD)
                    rows["hash"] = mix(rolled.at(begin - base, begin - base + length), 4)
                    rows["trigger"] = trigger[a:upto].view(np.uint64)[phrase]
                    rows["doc"], rows["text"], rows["start"], rows["count"], rows["hot"] = doc, text, begin, 1, 1
                    held.append(rows)
                    size += len(rows)
                    a = upto
            if out:
                yield block_batch(out)
            if size >= FLUSH_ROWS:
                yield hot_batch(held)
                held, size = [], 0
        if size:
            yield hot_batch(held)

    def block_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)],
                                          names=["part", "doc", "text_hash", "start", "body", "hot"])

    def hot_batch(held: list[np.ndarray]) -> pa.RecordBatch:
        rows, later, lead = earliest(np.concatenate(held), by_document)
        return block_batch([(p, None, None, None, b, True) for p, b in zip(*dealt(
            rows[~later], joined(runs_of(rows, later, lead, length)), parts2), strict=True)])

    def decide_blocks(batches):
        doc, text, start, body, bodies = [], [], [], [], []
        for batch in batches:
            hot = batch.column("hot").to_numpy(zero_copy_only=False)
            bodies += batch.column("body").filter(pa.array(hot)).to_pylist()
            cold = batch.filter(pa.array(~hot))
            for into, c in zip((doc, text, start, body), ("doc", "text_hash", "start", "body"), strict=True):
                into += cold.column(c).to_pylist()
        rows, known = gathered(bodies)
        del bodies
        rows, later, lead = earliest(rows, by_document)
        runs = [runs_of(rows, later, lead, length), known]
        del rows
        if body:
            values = np.frombuffer(b"".join(body), dtype=dtype)
            bounds = np.concatenate([[0], np.cumsum([len(b) for b in body])]) // dtype.itemsize
            runs.append(match(values, bounds, *(np.array(c, dtype=np.int64) for c in (doc, text, start)), length))
        yield from found_batches(np.concatenate(runs), np.zeros(0, dtype=RECORD), length)

    still = spare.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "stop", "trigger", "hot")).alias("open"))
    second = stored(
        docs.select("doc", "text_hash", "text").join(still, ["doc", "text_hash"])
        .dropDuplicates(["doc", "text_hash"])
        .mapInArrow(emit_blocks, BLOCKS).repartitionById(parts2, "part")
        .mapInArrow(decide_blocks, FOUND), "matches", large=True)
    return first.filter("trigger is null").unionByName(second).drop("trigger", "hot")


def removed(n: int, ranges: pa.StructArray | None) -> np.ndarray:
    """Mask of the units that the ranges cover."""
    mask = np.zeros(n + 1, dtype=np.int32)
    if ranges is not None:
        for name, step in (("start", 1), ("stop", -1)):
            np.add.at(mask, np.minimum(ranges.field(name).to_numpy(zero_copy_only=False), n), step)
    return np.cumsum(mask[:-1]) > 0


def with_ranges(docs: DataFrame, **how) -> DataFrame:
    """``keyed`` docs, each with its ranges (null: nothing repeats)."""
    ranges = repeated_ranges(docs, **how).groupBy("doc", "text_hash").agg(
        F.collect_list(F.struct("start", "stop", "ref_doc", "ref_start")).alias("ranges"))
    return docs.join(ranges, ["doc", "text_hash"], "left")


__all__ = ["RUN", "keyed", "removed", "repeated_ranges", "window_classes", "window_places", "with_ranges"]
