"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

Two different words of equal length, or of lengths one apart, differ by exactly one inserted, deleted
or replaced code point if and only if their common prefix and common suffix together reach the longer
length less one. That test runs densely: words are rows of code-point matrices, padded once at the
right (for prefixes) and once at the left (for suffixes), and a *tile* compares two
blocks of rows with a few array operations.

Which blocks meet is decided by context, so that no pair is missed and none is met in vain: the
longer word's places are cut into pieces of ``PIECE``; the edit lies in one of them, and outside of
it both words agree. Each word is dealt, for its own length and for the next (as the shorter
of a pair), to one group for each piece, keyed by everything outside that piece. Members
of a group share all but ``PIECE`` places, so a group has at most A**2 + A words for
an alphabet of A = 90 signs (8,190), however large the corpus: no group is hot. A pair can meet in several
groups; the one whose piece holds the end of the common prefix reports it.

Counting is JVM-side: runs are cut by a regular expression, counted in the map tasks before the
shuffle, so a word that fills a third of the corpus reaches it as one row a task. Forms
point to words at least twice as frequent, so chains are short (each step doubles n); roots are
found by pointer doubling over stored tables.

Defined results: a null or empty text has no runs; a null id hashes as no digits; repeated rows count each
time; ties of n go to the smaller word in code-point order; a word without near words is its own
root; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import parts_for, stored

RUN = r"([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIVISOR = 97                 # runs whose hash it divides lose one code point
LEAST_LENGTH, LEAST_COUNT = 5, 3
RATIO = 2                    # how much more frequent a form must be
PIECE = 2                    # places of the longer word left out of a group's key
BLOCK = 64                   # rows of one side of a tile
STACK = 1 << 14              # pairs that one stack of tiles holds
NEAR = "word string, n_near long, form_n long, form string"


def noisy(run: Column, doc_id: Column) -> Column:
    """The run, less one code point where its hash says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    return F.when(h % DIVISOR == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN))).alias("run"))
    words = runs.select(noisy(F.translate("run", UPPER, LOWER), F.col("doc_id")).alias("word"))
    return (words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least_count))


def contexts(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """(context, words): groups of at least two words that agree outside one piece."""
    long = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("long")
    each = words.select("word", "n", long)
    cut = F.explode(F.sequence(F.lit(0), F.col("long") - 1, F.lit(piece))).alias("at")
    each = each.select("word", "n", "long", cut)
    kept = F.greatest(F.lit(0), F.col("long") - F.col("at") - piece)         # places after the piece
    key = F.struct("long", "at", F.col("word").substr(F.lit(1), F.col("at")).alias("before"),
                   F.col("word").substr(F.length("word") - kept + 1, kept).alias("after"))
    return (each.groupBy(key.alias("context")).agg(F.collect_list(F.struct("word", "n")).alias("words"))
            .filter(F.size("words") > 1))


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points padded at the right, padded at the left, lengths)."""
    size = np.array([len(w) for w in words])
    width = int(size.max()) + 1
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left, right = np.zeros((2, len(words), width), dtype=np.uint32)
    left[row, place] = flat
    right[row, place + (width - size)[row]] = flat
    return left, right[:, ::-1], size


def near_tile(a: tuple, b: tuple, at: np.ndarray, piece: int) -> np.ndarray:
    """For stacks of blocks [g, i] and [g, j]: whether word i and word j of stack g differ by
    one edit whose place this group (its piece begins at ``at[g]``) reports."""
    prefix = np.cumprod(a[0][:, :, None] == b[0][:, None, :], axis=3, dtype=np.int16).sum(axis=3, dtype=np.int16)
    suffix = np.cumprod(a[1][:, :, None] == b[1][:, None, :], axis=3, dtype=np.int16).sum(axis=3, dtype=np.int16)
    low = np.minimum(a[2][:, :, None], b[2][:, None, :])
    long = np.maximum(a[2][:, :, None], b[2][:, None, :])
    first = np.minimum(prefix, low)              # padding agrees with padding
    near = (low >= long - 1) & (first + np.minimum(suffix, low) >= long - 1) & (first < long)
    own = (first >= at[:, None, None]) & (first < at[:, None, None] + piece)
    return near & own & (low > 0)


def tiles(size: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, int]]:
    """(groups, left block's start, right block's start, block length): groups of like size are
    stacked, larger ones than BLOCK are cut into block pairs."""
    for width in 2 ** np.arange(1, BLOCK.bit_length()):
        groups = np.flatnonzero((size > width // 2) & (size <= width))
        step = max(1, STACK // int(width * width))
        for g in range(0, len(groups), step):
            yield groups[g:g + step], 0, 0, int(width)
    for g in np.flatnonzero(size > BLOCK):
        for i in range(0, int(size[g]), BLOCK):
            for j in range(i, int(size[g]), BLOCK):
                yield np.array([g]), i, j, BLOCK


def near_words(words: list[str], n: np.ndarray, bounds: np.ndarray, at: np.ndarray, long: np.ndarray,
               piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of near words, each pair both ways; group g owns rows bounds[g]:bounds[g+1]
    and reports pairs whose longer word has ``long[g]`` places."""
    left, right, length = matrices(words)
    size = np.diff(bounds)
    one, two = [], []
    for groups, i, j, width in tiles(size):
        def block(start: int):
            rows = bounds[groups][:, None] + start + np.arange(width)        # noqa: B023
            have = rows < bounds[groups + 1][:, None]                        # noqa: B023
            rows = np.where(have, rows, 0)
            return (left[rows], right[rows], np.where(have, length[rows], 0)), rows
        (a, rows_a), (b, rows_b) = block(i), block(j)
        near = near_tile(a, b, at[groups], piece)
        near &= np.maximum(a[2][:, :, None], b[2][:, None, :]) == long[groups][:, None, None]
        g, x, y = np.nonzero(near)
        one.append(rows_a[g, x]), two.append(rows_b[g, y])
        if i != j:
            one.append(rows_b[g, y]), two.append(rows_a[g, x])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *two])


def nearest(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """NEAR for every word that has a near word in a group: their number, and the most frequent."""
    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                lists, context = batch.column("words"), batch.column("context").flatten()
                flat = lists.flatten()
                spelled, n = flat.field("word").to_pylist(), flat.field("n").to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                long, at = (context[k].to_numpy(zero_copy_only=False) for k in (0, 1))
                i, j = near_words(spelled, n, bounds, at, long, piece)
                if not len(i):
                    continue
                name = np.array(spelled, dtype=object)
                order = np.lexsort((name[j], -n[j], i))        # best near word first
                i, j = i[order], j[order]
                first = np.flatnonzero(np.diff(i, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[i[first]], pa.string()), pa.array(np.diff(np.append(first, len(i)))),
                     pa.array(n[j[first]]), pa.array(name[j[first]], pa.string())],
                    names=["word", "n_near", "form_n", "form"])

    found = contexts(words, piece).mapInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word of the chain of forms, by pointer
    doubling. Chains are short, since n at least doubles on each step."""
    now = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = stored(now.join(ahead, "root").select("word", F.col("next").alias("root"),
                                                     (F.col("next") != F.col("root")).alias("moved")), "roots")
        now = then.select("word", "root")
        if then.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             piece: int = PIECE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word."""
    words = stored(vocabulary(docs, least_length, least_count), "vocabulary")
    parts = parts_for(words.count(), 20_000, docs.sparkSession)
    near = nearest(words.repartition(parts, "word"), piece)
    enough = F.col("form_n") >= ratio * F.col("n")
    known = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "forms")
    return known.join(rooted(known), "word").select("word", "form", "root", "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(docs)


ORACLE = r"""
WITH RECURSIVE poly AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS pre,
         unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
low AS (
  SELECT pre, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m
  FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, CAST(length(hex(encode(pre || run))) // 2 AS BIGINT) + 1),
                          lambda i: CAST('0x' || substr(hex(encode(pre || run)), 2 * i - 1, 2) AS BIGINT))),
           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h
  FROM low, poly),
spelled AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, m
  FROM hashed),
v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
less AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, v.word, v.n FROM less l JOIN v ON v.word = l.rest
  UNION SELECT v.word, l.word, l.n FROM less l JOIN v ON v.word = l.rest),
best AS (SELECT a, count(*) AS n_near, arg_min(struct_pack(b := b, n := n), struct_pack(x := -n, y := encode(b))) AS f FROM pairs GROUP BY a),
forms AS (
  SELECT word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN f.n >= 2 * v.n THEN f.b END AS form,
         CASE WHEN f.n >= 2 * v.n THEN f.n END AS form_n FROM v LEFT JOIN best ON a = word),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, c.next, g.form FROM chain c JOIN forms g ON g.word = c.next)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""
