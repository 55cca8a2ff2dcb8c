"""Byte-exact repeats by prefix-free parsing.

Rolling-hash triggers cut every text into phrases (``spans``): each phrase ends
in the trigger's reach that begins the next, overlapping by ``length - 1``
bytes, so every window of ``length`` bytes lies inside a phrase of the **dictionary** of
different phrases. The **parse** gives each dictionary phrase its first place in
corpus order. Equal phrases inherit "repeated" from the parse.

Phrases that share a trigger may share windows. They meet in a block, where the suffixes of the
block's phrases are sorted: eight bytes at a time first, then by prefix doubling up to ``length`` bytes, deeper
order being of no use. Neighbours in that suffix array with a common prefix of
``length`` bytes are one window met several times; the parse's places decide which came first
in the corpus, and all others are repeats. Blocks are dealt by trigger, so equal windows
never lie in two blocks and no order has to span tasks. The work follows the *different* text, not
all positions of a repetitive corpus. Windows of hot triggers are dealt one by one and compared by hash
(see ``spans``).

Defined results: a null text is empty; texts under ``length`` bytes are kept
whole; a null id is ordered last; repeated rows (same id and text) are one
document and get equal results; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.arrays import text_bytes
from stockyard.llm.common import keyed, slices
from stockyard.llm.spans import RUN, removed, window_classes, window_places, with_ranges

LENGTH = 100         # bytes
TRIGGER = 32         # bytes of a trigger
BLOCK = 1_000_000    # bytes of phrases whose suffixes one task sorts at a time
WORD = 8             # bytes compared at once


def byte_units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(batch.column("text"))


def suffix_ranks(values: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each place, in suffix order."""
    width = 1 << min(WORD.bit_length() - 1, length.bit_length() - 1)
    padded = np.concatenate([values, np.zeros(WORD, dtype=np.uint8)])
    heads = np.ndarray(len(values), dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)
    return window_classes(heads >> np.uint64(8 * (WORD - width)), width, at, length)


def sorted_suffixes(values: np.ndarray, bounds: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray,
                    length: int) -> np.ndarray:
    """Runs of repeated windows among the phrases of a block."""
    at, phrase = window_places(bounds, length)
    rank = suffix_ranks(values, at, length)
    begin = start[phrase] + at - bounds[:-1][phrase]
    order = np.lexsort((begin, doc[phrase], rank))               # the suffix array, ties in corpus order
    new = np.diff(rank[order], prepend=-1) != 0                  # a common prefix under ``length``
    lead = np.empty(len(order), dtype=np.int64)
    lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    own, first = doc[phrase], doc[phrase[lead]]
    later = (own > first) | ((own == first) & (begin > begin[lead]))
    head = later.copy()                                          # runs of later windows within a phrase
    head[1:] &= ~later[:-1] | (phrase[1:] != phrase[:-1])
    a = np.flatnonzero(head)
    out = np.empty(len(a), dtype=RUN)
    out["doc"], out["text"], out["start"] = own[a], text[phrase[a]], begin[a]
    out["stop"] = begin[a] + np.bincount((np.cumsum(head) - 1)[later], minlength=len(a)) - 1 + length
    out["ref_doc"], out["ref_start"] = first[a], begin[lead[a]]
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER,
                    **limits: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): ``spans`` are the maximal
    removed runs [start, stop) in bytes, ``kept`` the remaining bytes."""
    ranged = with_ranges(keyed(docs), units=byte_units, match=sorted_suffixes, dtype=np.dtype(np.uint8), length=length,
                         k=min(trigger, length), by_document=False, units_per_byte=1.0, block=BLOCK, **limits)

    def cut(batches):
        for batch in slices(batches):
            data, bounds = text_bytes(batch.column("text"))
            n_removed, spans, kept = [], [], []
            for i, ranges in enumerate(batch.column("ranges")):
                own = data[bounds[i]:bounds[i + 1]]
                gone = removed(len(own), ranges.values)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                n_removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)])
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()),
                 pa.array(n_removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return ranged.select("doc_id", "text", "ranges").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, "
             "spans array<struct<start: long, stop: long>>, kept binary")


def digest(docs: DataFrame, **limits: int) -> DataFrame:
    out = without_repeats(docs, **limits)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
