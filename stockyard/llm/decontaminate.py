"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items go into one suffix automaton (one per
block of items, so that its size is bounded whatever the benchmark's). Training
texts stream through it: each token moves to the state of the longest suffix
read so far that occurs in some item. Where that length reaches ``window`` words,
the last ``window`` words are a window of an item; an item of fewer words is a
window as a whole. All words inside an occurrence are hit. Spans of hit words
are removed; a document whose hit share exceeds ``coverage`` goes altogether.

The automaton's first two levels are evaluated for whole batches at once: a
word that no item has, or a pair of words that no item has in a row, resets the
matching length to below 2. Only stretches long enough to reach a window are
walked token by token.

Defined results: a null text has no words and is clean; items with a null id
or without words take no part; item ids that are repeated count once; rows are
judged each for itself, so repeated rows and null ids simply give their rows;
other columns are passed through by ``decontaminated``; an empty benchmark
leaves everything clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.arrays import Words, byte_table, mix, text_bytes
from stockyard.llm.common import slices, stored

WINDOW = 10                   # words
COVERAGE = 0.8                # a document with a larger hit share is dropped
BLOCK_BYTES = 1 << 19         # item text in one automaton
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_TABLE = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


def words_of(batch: pa.RecordBatch, column: str = "text") -> Words:
    return Words(*text_bytes(batch.column(column)), WORD_TABLE, zero_is_word=False)


class SuffixAutomaton:
    """All factors of several sequences; transitions as one dict for each state."""

    def __init__(self, sequences: list[list[int]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)

    def _state(self, length: int, link: int, follow: dict) -> int:
        self.length.append(length), self.link.append(link), self.next.append(follow)
        return len(self.length) - 1

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        new = -1 if known is not None else self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at < 0:
            return new
        target = self.next[at][symbol]
        if self.length[target] != self.length[at] + 1:
            copy = self._state(self.length[at] + 1, self.link[target], dict(self.next[target]))
            while at >= 0 and self.next[at].get(symbol) == target:
                self.next[at][symbol] = copy
                at = self.link[at]
            self.link[target] = copy
            target = copy
        if new < 0:
            return target
        self.link[new] = target
        return new

    def step(self, state: int, length: int, symbol: int) -> tuple[int, int]:
        """State and length of the longest match after reading ``symbol``."""
        while symbol not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.length[state]
        return self.next[state][symbol], length + 1


class Items:
    """Automaton of a block of items with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        named = [(i, WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))) for i, t in items]
        named = [(i, w) for i, w in named if w]
        vocabulary = sorted({w for _, words in named for w in words})
        column = pa.array([*vocabulary, ""], pa.string())
        hashes = Words(*text_bytes(column), WORD_TABLE, zero_is_word=False).hashes()
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        code = {vocabulary[j]: n for n, j in enumerate(order)}
        self.sequences = [[code[w] for w in words] for _, words in named]
        self.window = window
        self.shortest = min((min(window, len(s)) for s in self.sequences), default=0)
        self.near = np.zeros(1 << 16, dtype=bool)
        self.near[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        self.pairs = np.zeros(1 << 22, dtype=bool)
        for s in self.sequences:
            a = np.array(s, dtype=np.uint64)
            self.pairs[self.pair_key(a[:-1], a[1:])] = True
        self.automaton = auto = SuffixAutomaton(self.sequences)
        #: state -> items that have the window of ``window`` words that ends there
        self.ends: dict[int, set[str]] = {}
        #: state -> (words, item) of shorter items that end there
        self.short: dict[int, set[tuple[int, str]]] = {}
        for (item, _), s in zip(named, self.sequences, strict=True):
            state, length = 0, 0
            for n, symbol in enumerate(s):
                state, length = auto.step(state, length, symbol)
                if n + 1 >= window:
                    self.ends.setdefault(self.holder(state), set()).add(item)
            if len(s) < window:
                self.short.setdefault(state, set()).add((len(s), item))

    @staticmethod
    def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(a * np.uint64(0x100000001B3) ^ b) >> np.uint64(42)).astype(np.int64)

    def holder(self, state: int) -> int:
        """The state, on the way to the root, that holds the last ``window`` words."""
        auto = self.automaton
        while auto.length[auto.link[state]] >= self.window:
            state = auto.link[state]
        return state

    def walk(self, codes: list[int], at: int) -> Iterator[tuple[int, int, set[str]]]:
        """Occurrences (first word, end, items) in a stretch that begins at word ``at``."""
        auto, state, length = self.automaton, 0, 0
        for n, symbol in enumerate(codes):
            state, length = auto.step(state, length, symbol)
            stop = at + n + 1
            if length >= self.window:
                items = self.ends.get(self.holder(state))
                if items:
                    yield stop - self.window, stop, items
            if self.short:
                up, most = state, length
                while up > 0:
                    for words, item in self.short.get(up, ()):
                        if words <= most:
                            yield stop - words, stop, {item}
                    up = auto.link[up]
                    most = auto.length[up]

    def stretches(self, words: Words) -> Iterator[tuple[int, int, np.ndarray]]:
        """Stretches (first, end, codes) of words in which a window can occur."""
        if not self.shortest:
            return
        hashes = words.hashes()
        known = self.near[(hashes >> np.uint64(48)).astype(np.int64)]
        place = np.flatnonzero(known)
        code = np.searchsorted(self.hashes, hashes[place])
        same = self.hashes[np.minimum(code, len(self.hashes) - 1)] == hashes[place]
        place, code = place[same], code[same]
        # joined: this known word follows the known word before it, in the same row
        joined = np.zeros(len(place), dtype=bool)
        joined[1:] = place[1:] == place[:-1] + 1
        starts = words.first[:-1]
        heads = np.searchsorted(place, starts)
        heads = heads[heads < len(place)]
        joined[heads[np.isin(place[heads], starts)]] = False
        if self.shortest > 1:
            c = code.astype(np.uint64)
            joined[1:] &= self.pairs[self.pair_key(c[:-1], c[1:])]
        begin = np.flatnonzero(~joined)
        end = np.append(begin[1:], len(place))
        long_enough = end - begin >= self.shortest
        for a, b in zip(begin[long_enough], end[long_enough], strict=True):
            yield int(place[a]), int(place[a]) + int(b - a), code[a:b]


_built: dict[int, Items] = {}


def built(items: list[tuple[str, str]], window: int) -> Items:
    """The automaton of a block; kept in the Python worker for its next tasks."""
    key = hash((window, tuple(items)))
    if key not in _built:
        _built.clear()
        _built[key] = Items(items, window)
    return _built[key]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about BLOCK_BYTES of text, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    items = items.filter("i is not null and t is not null").distinct()      # repeated rows would fill a block
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for n in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n) if blocks > 1 else items
        yield sorted((r["i"], r["t"]) for r in some.collect())


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with packed hit ranges (__hits), item ids (__items), word count (__words)."""
    columns = docs.columns
    out = docs.selectExpr("*", "cast(null as binary) __hits", "cast(array() as array<string>) __items",
                          "cast(0 as long) __words")
    blocks = item_blocks(benchmark)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        out = one_block(out, columns, block, window)
        if following is not None:
            out = stored(out, "scanned")
        block = following
    return out


def one_block(docs: DataFrame, columns: list[str], block: list[tuple[str, str]], window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)     # at most about BLOCK_BYTES

    def scan(batches):
        items = built(sent.value, window)
        for batch in slices(batches):
            words = words_of(batch)
            rows = batch.num_rows
            ranges: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
            found: list[set[str]] = [set(x or ()) for x in batch.column("__items").to_pylist()]
            for a, _, codes in items.stretches(words):
                row = int(np.searchsorted(words.first, a, side="right")) - 1
                for start, stop, ids in items.walk(codes.tolist(), a):
                    ranges[row].append((start - int(words.first[row]), stop - int(words.first[row])))
                    found[row] |= ids
            old = batch.column("__hits").to_pylist()
            hits = [union(r, o) for r, o in zip(ranges, old, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(hits, pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                   pa.array(np.diff(words.first), pa.int64())],
                names=[*columns, "__hits", "__items", "__words"])

    return docs.mapInArrow(scan, docs.schema)


def union(ranges: list[tuple[int, int]], body: bytes | None) -> bytes | None:
    """Packed union of word ranges and of what was packed before."""
    old = np.frombuffer(body, dtype=np.int64).reshape(-1, 2).tolist() if body else []
    out: list[list[int]] = []
    for a, b in sorted([*old, *ranges]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, dtype=np.int64).tobytes() if out else None


def n_hit(body: bytes | None) -> int:
    return int(np.diff(np.frombuffer(body, dtype=np.int64).reshape(-1, 2)).sum()) if body else 0


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the hit spans, and without documents hit beyond ``coverage``.

    A span goes from its first hit word to the word after it, so what stands
    between two removed words goes too; ``n_chars`` follows the text if there.
    """
    columns = docs.columns
    keep = [c for c in columns if c != "text"]

    def cut(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            hits = batch.column("__hits").to_pylist()
            if any(hits):
                words = words_of(batch)
                data = words.data
                bounds = text_bytes(batch.column("text"))[1]
                for i, body in enumerate(hits):
                    if body:
                        at, last, parts = int(words.first[i]), int(bounds[i]), []
                        for a, b in np.frombuffer(body, dtype=np.int64).reshape(-1, 2):
                            parts.append(data[last:words.start[at + a]].tobytes())
                            end = at + int(b)
                            last = int(words.start[end]) if end < words.first[i + 1] else int(words.stop[end - 1])
                        parts.append(data[last:bounds[i + 1]].tobytes())
                        texts[i] = b"".join(parts).decode("utf-8")
            gone = [n_hit(b) > coverage * w for b, w in zip(hits, batch.column("__words").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])
            yield out.filter(pa.array([not g for g in gone]))

    found = scanned(docs, benchmark, window)
    schema = docs.select(*keep, "text").schema
    out = found.mapInArrow(cut, schema).select(*columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scanned(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)

    def report(batches):
        for batch in batches:
            hit = [n_hit(b) for b in batch.column("__hits").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__words"), pa.array(hit, pa.int64()), batch.column("__items")],
                names=["doc_id", "n_words", "n_hit", "items"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(report, f"doc_id {doc_type}, n_words long, n_hit long, items array<string>").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, len(p) AS n, array_to_string(p, ' ') AS p FROM (
    SELECT item, unnest(CASE WHEN len(w) < 10 THEN [w]
                             ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS p
    FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n),
found AS (
  SELECT r, i, places.n AS n, item FROM places
  JOIN windows ON windows.n = places.n AND windows.p = array_to_string(w[i:i + places.n - 1], ' ')),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
