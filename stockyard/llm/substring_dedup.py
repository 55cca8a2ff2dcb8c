"""Repeated word passages by relative Lempel-Ziv factors.

Every document is parsed against all documents with a smaller id as reference. The
reference is spread over blocks: a block holds, for its share of the triggers (see ``spans``), each
different phrase once, at its first document. A phrase that occurs earlier as a
whole is a factor already. The others meet the reference phrases of their block and are parsed
greedily: from the first word that begins a window of ``length`` words of an earlier document, the
factor (reference document, place, length) is carried on for as long as the text goes on
like its reference; where it ends, the windows that cross the factor's border are looked up, and the next one that an
earlier document has begins the next factor. Factors that go on across phrases along the same
reference are joined, so a factor is as long as the passage.

Factors are at least ``length`` words long by construction, and every repeated window lies in one, since each window is
either inside a factor or looked up at a border. The words they cover are the copies. Words are
compared by 64-bit hash. A passage that a document only repeats from itself is kept.

Defined results: a null text has no words; texts under ``length`` words are
kept whole; a null id is ordered last; repeated rows (same id and text) are one
document; of several references the smallest id is named; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.arrays import SPACE_TABLE, Words, text_bytes
from stockyard.llm.common import NO_ID, keyed, slices
from stockyard.llm.spans import RUN, joined, removed, repeated_ranges, window_classes, window_places, with_ranges

LENGTH = 50          # words
TRIGGER = 10         # words of a trigger
BLOCK = 250_000      # words of phrases that one task parses at a time


def words_of(batch: pa.RecordBatch) -> Words:
    return Words(*text_bytes(batch.column("text")), SPACE_TABLE, zero_is_word=True)


def word_units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(batch)
    return words.hashes(), words.first


def greedy_factors(values: np.ndarray, bounds: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray,
                   length: int) -> np.ndarray:
    """Factors of the phrases of a block against those of smaller documents."""
    at, phrase = window_places(bounds, length)
    own = doc[phrase]
    same = window_classes(values, 1, at, length)
    order = np.lexsort((at, own, same))                 # reference of a window: its first document's
    new = np.diff(same[order], prepend=-1) != 0
    source = np.empty(len(order), dtype=np.int64)
    source[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    copied = own > own[source]
    # a factor goes on while text and reference go on alike; else the next window is looked up anew
    head = copied.copy()
    head[1:] &= ~copied[:-1] | (phrase[1:] != phrase[:-1]) | (source[1:] != source[:-1] + 1)
    a = np.flatnonzero(head)
    out = np.empty(len(a), dtype=RUN)
    out["doc"], out["text"] = own[a], text[phrase[a]]
    out["start"] = start[phrase[a]] + at[a] - bounds[:-1][phrase[a]]
    out["stop"] = out["start"] + np.bincount((np.cumsum(head) - 1)[copied], minlength=len(a)) - 1 + length
    out["ref_doc"] = own[source[a]]
    ref = phrase[source[a]]
    out["ref_start"] = start[ref] + at[source[a]] - bounds[:-1][ref]
    return out


def _how(length: int, trigger: int) -> dict:
    return dict(units=word_units, match=greedy_factors, dtype=np.dtype("<u8"), length=length, k=min(trigger, length),
                by_document=True, units_per_byte=0.2, block=BLOCK)


def factors(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, **limits: int) -> DataFrame:
    """(doc_id, text_hash, start, length, ref_id, ref_start): every factor of every document, in words; those
    that go on along one reference are joined. A null id stands for the document without one."""
    found = repeated_ranges(keyed(docs), **_how(length, trigger), **limits)

    def join(key, rows):
        runs = np.empty(rows.num_rows, dtype=RUN)
        runs["doc"], runs["text"] = key[0].as_py(), key[1].as_py()
        for name in ("start", "stop", "ref_doc", "ref_start"):
            runs[name] = rows[name].to_numpy()
        runs = joined(runs)
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in (
            runs["doc"], runs["text"], runs["start"], runs["stop"] - runs["start"], runs["ref_doc"], runs["ref_start"])],
            names=["doc_id", "text_hash", "start", "length", "ref_id", "ref_start"])

    out = found.groupBy("doc", "text_hash").applyInArrow(
        join, "doc_id long, text_hash long, start long, length long, ref_id long, ref_start long")
    return out.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("doc_id", "ref_id")})


def without_copies(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER,
                   **limits: int) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): ``spans`` are the maximal
    removed runs of words [start, stop), ``kept`` the other words joined by a space."""
    ranged = with_ranges(keyed(docs), **_how(length, trigger), **limits)

    def cut(batches):
        for batch in slices(batches):
            words = words_of(batch)
            n_words = np.diff(words.first)
            n_removed, spans, kept = [], [], []
            for i, ranges in enumerate(batch.column("ranges")):
                own = slice(words.first[i], words.first[i + 1])
                gone = removed(int(n_words[i]), ranges.values)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                n_removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)])
                kept.append(words.joined(own, ~gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return ranged.select("doc_id", "text", "ranges").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, "
             "spans array<struct<start: long, stop: long>>, kept string")


def digest(docs: DataFrame, **limits: int) -> DataFrame:
    return without_copies(docs, **limits).select("doc_id", "n_words", "n_removed",
                                       F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
win AS (SELECT r, o, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
        FROM (SELECT r, o, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first_doc AS (SELECT h, min(o) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM win JOIN first_doc USING (h) WHERE o > m),
gone_list AS (SELECT r, list(j) AS js, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, k: js IS NULL OR NOT list_contains(js, k)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone_list USING (r)
"""
