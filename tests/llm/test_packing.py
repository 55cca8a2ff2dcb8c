"""Tokens against the reference tokenizer, pieces as an exact round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stockyard.llm import packing

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return EXACT.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("capacity", [16, 1024])
def test_round_trip(docs_of, capacity):
    rng = random.Random(capacity)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta!", "g", "délta", "12"]) for _ in range(int(rng.paretovariate(0.6)) % 3000)))
            for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no id")]
    pieces = packing.packed(docs_of(rows).selectExpr("*", "1 as bucket"), capacity).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        own = np.frombuffer(bytes(p.ids), dtype="<u4")
        assert len(own) == p.length > 0 and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        by_doc.setdefault(p.doc_id, []).append((p.start, own.tolist(), p.doc_tokens))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        at, out = 0, []
        for start, own, total in sorted(by_doc[i]):
            assert start == at and total == len(ids(t))
            at += len(own)
            out += own
        assert out == ids(t)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    short = sum(capacity - sum(n for _, n in own) for own in by_sequence.values())
    assert short < capacity                               # one bucket: less than one sequence of padding


def test_digest_has_the_same_pieces(docs_of):
    rows = [(i, "word " * (i * 37)) for i in range(60)]
    full = {tuple(r)[:7] for r in packing.packed(docs_of(rows)).collect()}
    assert {tuple(r) for r in packing.digest(docs_of(rows)).collect()} == full
    assert packing.digest(docs_of([])).collect() == []
    twice = packing.digest(docs_of([(1, "a b"), (1, "a b")])).collect()
    assert [r.start for r in twice] == [0, 0]


def test_descending_to_the_cheapest_sequence():
    plan = packing.assign([6, 5, 4, 3, 2], 10)
    assert plan == [[(0, 6, 0, 0)], [(0, 5, 1, 0)], [(0, 4, 1, 5)], [(0, 3, 0, 6)], [(0, 1, 1, 9), (1, 1, 0, 9)]]


def test_repeated_rows_spread_over_buckets(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_DOCS", 200)
    rows = [(7, "the same text")] * 2000 + [(i, f"text {i}") for i in range(2000)]
    pieces = packing.digest(docs_of(rows)).collect()
    by_bucket = {}
    for p in pieces:
        by_bucket[p.sequence_id >> 32] = by_bucket.get(p.sequence_id >> 32, 0) + 1
    assert len(pieces) >= 4000 and max(by_bucket.values()) < 400
