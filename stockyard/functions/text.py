"""Text helpers: keyword tagging (V4), word-window and sentence chunking (V3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Question-type keywords, matched as case-insensitive substrings
# (so 'pe' also hits inside longer words), in the order of the source lists.
# ---------------------------------------------------------------------------
QUESTION_KEYWORDS = {
    "fundamental": ["pe", "pb", "roe", "roa", "eps", "doanh thu", "lợi nhuận",
                    "tài chính", "báo cáo", "định giá"],
    "technical": ["rsi", "macd", "sma", "ema", "xu hướng", "tăng", "giảm",
                  "kỹ thuật", "biểu đồ"],
    "news": ["tin tức", "vĩ mô", "chính sách", "kinh tế", "thị trường", "ảnh hưởng"],
    "comparison": ["so sánh", "tốt nhất", "xếp hạng", "top", "nên chọn"],
    "investment_decision": ["nên", "mua", "bán", "đầu tư", "khuyến nghị"],
}
# ---------------------------------------------------------------------------

# Whitespace class used for word splitting; spelled out so every engine
# splits on exactly the same characters.
WORD_SEPARATOR = "[ \t\n\r\f]+"

# A word that ends a sentence: a stop, then any closing quotes and brackets.
SENTENCE_END = """[.!?]["')\\]]*$"""


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """True when lower(text) contains any keyword (NULL text -> NULL)."""
    low = F.lower(text)
    cond = F.lit(False)
    for kw in keywords:
        cond = cond | low.contains(F.lit(kw.lower()))
    return cond


def keyword_flags(text: Column | str,
                  labels: dict[str, list[str]] | None = None) -> list[Column]:
    """One boolean column per label."""
    t = F.col(text) if isinstance(text, str) else text
    labels = QUESTION_KEYWORDS if labels is None else labels
    return [any_keyword(t, kws).alias(name) for name, kws in labels.items()]


def words(text: Column | str) -> Column:
    """Whitespace-separated words of a text, empty tokens removed."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, WORD_SEPARATOR), lambda w: w != F.lit(""))


def chunk_starts(n_words: Column, size: int, overlap: int) -> Column:
    """0-based start offsets of overlapping windows covering all ``n_words`` words."""
    stride = size - overlap
    last = F.greatest(n_words - F.lit(overlap), F.lit(1)) - F.lit(1)
    return F.sequence(F.lit(0), last, F.lit(stride))


def sentence_ends(w: Column) -> Column:
    """Word counts up to the end of each sentence of a word array; the last word ends one."""
    n = F.size(w)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.element_at(w, i).rlike(SENTENCE_END))
    return F.when(n > 0, ends)


def sentence_pieces(ends: Column, size: int) -> Column:
    """Array of (from, upto) word offsets of the sentences with these ends; a sentence of more
    than ``size`` words comes as several pieces. ``ends`` is to be a stored column, not an
    expression: it is used several times."""
    before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    return F.flatten(F.zip_with(before, ends, lambda a, e: F.transform(
        F.sequence(a, e - 1, F.lit(size)),
        lambda b: F.struct(b.alias("from"), F.least(b + size, e).alias("upto")))))


def sentence_spans(pieces: Column, size: int, overlap: int) -> Column:
    """Array of (from, upto) word offsets of chunks: a fold over ``sentence_pieces``. A chunk takes
    pieces while they fit into ``size`` words. The next one starts with as many of its last pieces
    as have ``overlap`` words together and leave room for the piece that did not fit."""
    span = "struct<from:int,upto:int>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("recent"),
                     F.array().cast(f"array<{span}>").alias("done"))

    def chunk(a: Column, b: Column) -> Column:
        return F.array(F.struct(a.alias("from"), b.alias("upto")))

    def step(acc: Column, p: Column) -> Column:
        fits = p["upto"] - acc["at"] <= size
        again = F.filter(acc["recent"], lambda b: (b > acc["at"]) & (p["from"] - b <= overlap) & (p["upto"] - b <= size))
        start = F.concat(again, F.array(p["from"]))
        return F.struct(
            F.when(fits, acc["at"]).otherwise(F.element_at(start, 1)).alias("at"),
            F.when(fits, F.concat(acc["recent"], F.array(p["from"]))).otherwise(start).alias("recent"),
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], chunk(acc["at"], p["from"]))).alias("done"))

    last = F.element_at(pieces, -1)["upto"]
    return F.aggregate(pieces, empty, step, lambda acc: F.concat(acc["done"], chunk(acc["at"], last)))
