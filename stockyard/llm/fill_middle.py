"""Fill-in-the-middle transformation over an indexable skip list.

A text is a list of *units* (code points, or what a pattern matches). The skip
list over them has a base lane, one node a unit, and express lanes whose nodes each
span ``FAN`` nodes of the lane below. Every node carries two widths: the units and the
code points that it spans. The text of rank r is found by descending from the
top lane and adding up the widths of the nodes passed, so both cut ranks are reached
exactly in O(FAN * lanes) steps and give code-point offsets without a scan.

The two cut ranks, the share of texts left plain and the share of suffix-first
(spm) outputs come from a hash of the document id, so a retried task or another
partitioning gives the same output. The work is one map over the texts: no shuffle.

Defined results: a null or empty text is plain and its output empty; a text that
contains a mark is plain; a null id hashes as no digits; repeated rows get equal
results; with a pattern, code points between matches belong to the unit before them (those
before the first match to the first unit); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import slices

MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90              # of a hundred: hashes from here on leave the text plain
SPM_UNDER = 20               # of a hundred: hashes under this put the suffix first
SEED = 1
FAN = 32
RESULT = ("doc_id long, n long, form string, prefix_units long, middle_units long, "
          "prefix_chars long, middle_chars long, output string")


class SkipList:
    """Lanes of (unit widths, code-point widths), the base lane first."""

    def __init__(self, points: np.ndarray, fan: int = FAN):
        self.fan = fan
        self.lanes = [(np.ones(len(points), dtype=np.int64), points.astype(np.int64, copy=False))]
        while len(self.lanes[-1][0]) > fan:
            units, widths = self.lanes[-1]
            at = np.arange(0, len(units), fan)
            self.lanes.append((np.add.reduceat(units, at), np.add.reduceat(widths, at)))
        self.units = int(self.lanes[-1][0].sum())

    def find(self, rank: int) -> int:
        """Code points before the unit of this rank (``units`` itself: all of them)."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        node = passed = offset = 0
        for lane in reversed(range(len(self.lanes))):
            units, points = self.lanes[lane]
            stop = min(node + self.fan, len(units))
            ahead = passed + np.cumsum(units[node:stop])
            steps = int(np.searchsorted(ahead, rank, side="right"))
            if steps:
                passed = int(ahead[steps - 1])
                offset += int(points[node:node + steps].sum())
            node = (node + steps) * self.fan
            if passed == rank:
                break
        return offset


def unit_points(text: str, pattern: re.Pattern | None) -> np.ndarray:
    """Code points of each unit; they add up to the text."""
    if pattern is None:
        return np.ones(len(text), dtype=np.int64)
    starts = [m.start() for m in pattern.finditer(text) if m.end() > m.start()]
    if not starts:
        return np.full(1 if text else 0, len(text), dtype=np.int64)
    return np.diff([0, *starts[1:], len(text)])


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers from the id."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i:i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: str, lane: SkipList, low: int, high: int, form: str) -> tuple[str, int, int]:
    """(output, code points of the prefix, of the middle) for cut ranks low <= high."""
    a, b = lane.find(low), lane.find(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    return (f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}",
            a, b - a)


def restored(output: str, form: str) -> str:
    """The text that an output was made of. No mark occurs in a part, and a mark's
    first sign occurs once in it, so the first place of each mark is its own."""
    if form == "plain":
        return output
    first, second = (MARKS[0], MARKS[1]) if form == "psm" else (MARKS[1], MARKS[0])
    cut = output.index(second)
    last = output.index(MARKS[2], cut)
    lead, follow, middle = output[len(first):cut], output[cut + len(second):last], output[last + len(MARKS[2]):]
    return lead + middle + follow if form == "psm" else follow + middle + lead


def transform_one(doc_id: int | None, text: str, pattern: re.Pattern | None, seed: int) -> tuple:
    """A row of RESULT."""
    lane = SkipList(unit_points(text, pattern))
    n = lane.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= PLAIN_FROM or any(mark in text for mark in MARKS):
        return doc_id, n, "plain", None, None, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < SPM_UNDER else "psm"
    output, before, within = arranged(text, lane, low, high, form)
    return doc_id, n, form, low, high - low, before, within, output


def _mapped(docs: DataFrame, row: Callable, schema: str, types: list[pa.DataType]) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for batch in slices(batches):
            rows = [row(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                                              strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def transformed(docs: DataFrame, units: str | None = None, seed: int = SEED) -> DataFrame:
    """RESULT for every row: ``units`` is the pattern of a unit (None: each code point)."""
    pattern = re.compile(units) if units else None
    return _mapped(docs, lambda i, t: transform_one(i, t, pattern, seed), RESULT,
                   [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()])


def digest(docs: DataFrame) -> DataFrame:
    """Cuts and hashes of each output, and of the text rebuilt from output and form alone."""
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def row(doc_id, text):
        _, n, form, _, _, before, within, output = transform_one(doc_id, text, None, SEED)
        return doc_id, n, form, before, within, sha(output), sha(restored(output, form))

    return _mapped(docs, row, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                              "output_sha256 string, restored_sha256 string",
                   [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
