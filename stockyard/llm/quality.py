"""Quality classifier: a sparse ensemble of rules compiled into column expressions.

1. Statistics of every whole text (counts by byte class, words, lines) in one pass.
2. A few boosted trees of small depth are grown on labelled rows; each path from
   a root to a node becomes a rule, a conjunction of comparisons.
3. Lasso logistic regression (accelerated proximal gradient) weighs the rules;
   most get weight zero.
4. The rules that are left become Spark column expressions, so scoring is a
   projection over the statistics.

The fit takes at most ``FIT_ROWS`` labelled rows, those with the smallest hash of
their id, and none whose crc32(id) mod 5 is 0 (held out); statistics and scores cover all
rows. Labels, language, source and id are no inputs of a score.

Defined results: a null text is empty, and empty texts get the score of their
(all zero) statistics; rows with a null label or without a document are not fitted;
an id that is labelled twice counts twice; rows are scored each for itself, so
repeated rows and null ids give their own rows (a null id is not held out); other
columns are ignored; without labels of both kinds every score is their share, or
0.5 without any; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.arrays import SPACE_BYTES, Words, byte_table, text_bytes
from stockyard.llm.common import slices, stored

FIT_ROWS = 20_000
TREES, DEPTH, LEAST_LEAF, RATE = 24, 3, 20, 0.3
BINS = 32
PENALTY, STEPS = 2e-4, 400
THRESHOLD = 0.3

STATISTICS = ["log_chars", "log_words", "word_length", "word_length_spread", "letter_share", "upper_share",
              "digit_share", "space_share", "stop_share", "bang_share", "mark_share", "pipe_share", "wide_share",
              "distinct_share", "top_share", "repeat_share", "shout_share", "marked_share", "log_lines",
              "line_length", "distinct_line_share", "bare_line_share", "pair_share"]

_CLASSES = np.zeros((9, 256), dtype=bool)                # letter upper digit space stop bang mark pipe wide
_CLASSES[0, 0x41:0x5B] = _CLASSES[0, 0x61:0x7B] = _CLASSES[0, 0x80:] = True
_CLASSES[1, 0x41:0x5B] = True
_CLASSES[2, 0x30:0x3A] = True
_CLASSES[3, [*SPACE_BYTES]] = True
_CLASSES[4, [ord(c) for c in ".,;:?"]] = True
_CLASSES[5, ord("!")] = True
_CLASSES[6, [ord(c) for c in "#$%&*@^~=+<>{}[]\\_"]] = True
_CLASSES[7, ord("|")] = True
_CLASSES[8, 0x80:] = True
_LINES = byte_table((0x0A,), lower=False)
_SPACES = byte_table((0, *SPACE_BYTES), lower=True)


def group_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def statistics(batch: pa.RecordBatch) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, bounds = text_bytes(batch.column("text"))
    size = np.maximum(np.diff(bounds), 1).astype(float)
    share = [group_sums(c[data], bounds) / size for c in _CLASSES]
    words = Words(data, bounds, _SPACES, zero_is_word=True)
    hashes, row = words.hashes(), words.rows()
    n = np.diff(words.first).astype(float)
    per = np.maximum(n, 1)
    length = (words.stop - words.start).astype(float)
    mean = group_sums(length, words.first) / per
    spread = np.sqrt(np.maximum(group_sums(length ** 2, words.first) / per - mean ** 2, 0))
    distinct, top = distinct_and_top(hashes, row, len(n))
    pairs = hashes * np.uint64(3) + np.concatenate([hashes[1:], hashes[:1]]) if len(hashes) else hashes
    pair_distinct, _ = distinct_and_top(pairs, row, len(n))
    repeat = np.zeros(len(hashes))
    repeat[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    upper = np.concatenate([[0], np.cumsum(_CLASSES[1][data])])
    plain = np.concatenate([[0], np.cumsum((data >= 0x61) & (data < 0x7B))])
    ups, lows = upper[words.stop] - upper[words.start], plain[words.stop] - plain[words.start]
    shout = (ups >= 2) & (lows == 0)
    marked = (_CLASSES[6] | _CLASSES[5] | _CLASSES[7])[data[words.stop - 1]] if len(words.stop) else np.zeros(0)
    lines = Words(data, bounds, _LINES, zero_is_word=True)
    m = np.maximum(np.diff(lines.first), 1).astype(float)
    line_distinct, _ = distinct_and_top(lines.hashes(), lines.rows(), len(n))
    ends = _CLASSES[4][data[lines.stop - 1]] if len(lines.stop) else np.zeros(0)
    return np.stack([
        np.log1p(np.diff(bounds)), np.log1p(n), mean, spread, *share, distinct / per, top / per,
        group_sums(repeat, words.first) / per, group_sums(shout, words.first) / per,
        group_sums(marked, words.first) / per, np.log1p(np.diff(lines.first)), size / m, line_distinct / m,
        1 - group_sums(ends, lines.first) / m, pair_distinct / per], axis=1)


def distinct_and_top(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values of each row, and how often its commonest one stands."""
    # the row's number in the upper bits keeps rows apart in one sort
    key = np.sort((hashes >> np.uint64(24)) | (row.astype(np.uint64) << np.uint64(40)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(new, len(key)))
    owner = (key[new] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(rows)
    np.maximum.at(top, owner, count)
    return np.bincount(owner, minlength=rows).astype(float), top


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS) of every text."""
    def describe(batches):
        for batch in slices(batches):
            columns = statistics(batch).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in columns)],
                                             names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(
        describe, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]        # (statistic, above, limit): all must hold


def grown_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted regression trees (log loss, histogram splits)."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    rules: dict[Rule, None] = {}

    def grow(rows: np.ndarray, path: Rule, depth: int, gradient: np.ndarray, weight: np.ndarray) -> None:
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            g_all, w_all = gradient[rows].sum(), weight[rows].sum()
            for j, limits in enumerate(edges):
                if not len(limits):
                    continue
                b = binned[rows, j]
                g = np.cumsum(np.bincount(b, gradient[rows], len(limits) + 1))[:-1]
                w = np.cumsum(np.bincount(b, weight[rows], len(limits) + 1))[:-1]
                n = np.cumsum(np.bincount(b, minlength=len(limits) + 1))[:-1]
                gain = g ** 2 / (w + 1) + (g_all - g) ** 2 / (w_all - w + 1) - g_all ** 2 / (w_all + 1)
                gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k))
        if best[1] is None:
            margin[rows] += RATE * gradient[rows].sum() / (weight[rows].sum() + 1)
            return
        j, k = best[1]
        low = binned[rows, j] <= k
        for own, above in ((rows[low], False), (rows[~low], True)):
            longer = (*path, (j, above, float(edges[j][k])))
            rules.setdefault(simplified(longer))
            grow(own, longer, depth + 1, gradient, weight)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), (), 0, y - p, p * (1 - p))
    return list(rules)


def simplified(path: Rule) -> Rule:
    """One comparison for each statistic and side, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for j, above, limit in path:
        old = tight.get((j, above), limit)
        tight[j, above] = max(old, limit) if above else min(old, limit)
    return tuple(sorted((j, above, limit) for (j, above), limit in tight.items()))


def fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([x[:, j] > v if above else x[:, j] <= v for j, above, v in rule])


def lasso(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of a logistic model, by accelerated proximal gradient."""
    n, k = z.shape
    design = np.concatenate([np.ones((n, 1)), z], axis=1)
    probe = np.ones(k + 1)
    for _ in range(20):                                  # largest eigenvalue bounds the step
        probe = design.T @ (design @ probe)
        probe /= np.linalg.norm(probe)
    step = 4 * n / max(np.linalg.norm(design.T @ (design @ probe)), 1e-9)
    w = at = np.zeros(k + 1)
    momentum = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(design @ at)))
        moved = at - step * (design.T @ (p - y)) / n
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * PENALTY, 0)
        faster = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        at = moved + (momentum - 1) / faster * (moved - w)
        w, momentum = moved, faster
    return float(w[0]), w[1:]


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, rules with weights); labels of one kind only give a constant."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return float(np.log(share / (1 - share))), []
    rules = grown_rules(x, y)
    intercept, weights = lasso(np.stack([fires(r, x) for r in rules], axis=1).astype(float), y)
    return intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score as a column over the STATISTICS."""
    total = F.lit(intercept)
    for rule, weight in rules:
        holds = reduce(lambda a, b: a & b, [F.col(STATISTICS[j]) > v if above else F.col(STATISTICS[j]) <= v
                                            for j, above, v in rule])
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ensemble(stats: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[float, list[tuple[Rule, float]]]:
    """Fit on at most FIT_ROWS labelled rows that are not held out."""
    rows = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
            .join(stats, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
            .select("y", *STATISTICS).toArrow())
    x = np.stack([rows[s].to_numpy() for s in STATISTICS], axis=1) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    return fitted(x, rows["y"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score) of every document."""
    stats = stored(described(docs), "statistics")
    intercept, rules = ensemble(stats, labels, label)
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compiled(intercept, rules).alias("score"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
