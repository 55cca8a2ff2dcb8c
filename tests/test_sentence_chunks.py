"""Chunks of whole sentences (V3): budget, overlap, edge cases."""

import random
import re

import pytest

from stockyard.operators.retrieval import sentence_chunks


def expected(text, size, overlap):
    """Chunks as lists of words, sentence by sentence."""
    sentences, rest = [], []
    for word in re.split("[ \\t\\n\\r\\f]+", text or ""):
        if word:
            rest.append(word)
            if re.search(r"""[.!?]["')\]]*$""", word) or len(rest) == size:
                sentences.append(rest)
                rest = []
    sentences += [rest] if rest else []
    chunks, now = [], []
    for s in sentences:
        if sum(map(len, now)) + len(s) > size:
            chunks.append(now)
            keep = []
            for back in reversed(now[1:]):
                if sum(map(len, keep)) + len(back) > min(overlap, size - len(s)):
                    break
                keep.insert(0, back)
            now = keep
        now = [*now, s]
    return [[w for s in c for w in s] for c in (*chunks, now) if c]


TEXTS = ["One two. Three four five! Six? Seven eight nine ten. Eleven.", "no stop at all " * 9, "A b c d e f g h. I.",
         'He said "stop." Then (he went.) On.', "a. " * 40, "x", ". ! ?", "", "  \n ", None,
         "tab\tand\nline. end", "one two three four five six. seven"]


@pytest.mark.parametrize("size,overlap", [(8, 3), (5, 0), (6, 5)])
def test_chunks_of_whole_sentences(spark, size, overlap):
    rng = random.Random(size)
    texts = TEXTS + [" ".join(rng.choice("ab") * rng.randint(1, 3) + rng.choice(["", "", "", ".", "!\""])
                              for _ in range(rng.randint(1, 80))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "a null id. here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk_id", "2 as n_words", "3 as _w")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.chunk_id, r.n_words, r.text)
                 for r in sentence_chunks(docs, size, overlap).collect())
    want = sorted((i is None, i or 0, c, len(words), " ".join(words))
                  for i, t in rows for c, words in enumerate(expected(t, size, overlap)))
    assert got == want and all(r[3] <= size for r in got)
    assert sentence_chunks(docs.filter("doc_id < 0")).collect() == []
