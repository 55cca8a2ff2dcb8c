"""Wavelet matrix against numpy, token files as an exact round trip."""

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockyard.llm import token_files
from stockyard.llm.encoding import LATIN, TextEncoder, text_encoder
from stockyard.llm.wavelet import WaveletMatrix

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return EXACT.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n,top,width", [(0, 1, 4), (1, 2, 1), (63, 5, 3), (512, 2, 1), (513, 50_000, 16), (5000, 7, 3),
                                         (20_000, 50_000, 16), (3000, 1, 2)])
def test_matrix_against_numpy(n, top, width):
    rng = np.random.default_rng(n)
    values = np.minimum(rng.integers(0, top, n), rng.integers(0, top, n)).astype("<u2")
    first = WaveletMatrix.of(values, width)
    m = WaveletMatrix.unpacked(n, *first.packed())
    assert m.values().tolist() == values.tolist()
    assert m.access(np.arange(n)).tolist() == values.tolist()
    for token in {0, 1, top - 1, *values[:5].tolist()}:
        if token >> width:
            continue
        at = np.flatnonzero(values == token)
        assert m.count(token) == len(at) and m.occurrences(token).tolist() == at.tolist()
        places = np.unique(rng.integers(0, n + 1, 50))
        assert m.rank(token, places).tolist() == [int((values[:p] == token).sum()) for p in places]
    assert m.count(1 << width) == 0


def test_fast_path_gives_the_library_s_ids():
    """Every code point of the fast path beside letters, blanks, apostrophes and itself; hard texts; long runs."""
    encoder = TextEncoder()
    rng = random.Random(5)
    alphabet = [chr(c) for c in range(LATIN + 1)] + list("  \n\t''sdmtlvre1290") * 12
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [f"a{chr(a)}{chr(b)}b {chr(a)}" for a in range(LATIN + 1) for b in (0x20, 0x27, 0x61, 0x31, 0x21, 0xA0, 0x85, a)]
    texts += ["", " ", "  x", "\n\n a", "don't I'LL we've ''s", "<|endoftext|> x", "日本 語 '", "🙂 emoji's", "a\x00b", "é\u0301",
              "\u0378 unassigned", "\U0001fae9 newer", "   x", " \x1c x", "\x1f\x1f \x1d"]
    runs = [" ", "\n", "\t", "7", "'", "'s", "a", "é", "e\u0301", "\xa0", "\x85", " \n", "' ", "a'", "\u3000", "\x1c"]
    texts += [r * n for r in runs for n in (1, 2, 3, 100, 3000)] + [f"x{r * 50}y{r * 50} z" for r in runs]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), dtype="<u2").tolist() == ids(t), repr(t[:80])


def test_fast_path_on_all_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    encoder = text_encoder()
    for t in texts:
        assert np.frombuffer(encoder.encode(t), dtype="<u2").tolist() == ids(t)


def check(spark, target, rows):
    """Documents of the files in order, against the library."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    got = sorted(token_files.read(spark, target).collect(), key=lambda r: r.start)
    at = 0
    for (i, t), r in zip(order, got, strict=True):
        own = ids(t) + [token_files.END]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(own))
        assert np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == own
        at += len(own)


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_files_round_trip(spark, docs_of, tmpdir_path, shard_ids):
    rng = random.Random(shard_ids)
    rows = [(i * 3 % 1009, " ".join(rng.choice(["alpha", "Beta!", "g", "délta", "12"]) for _ in range(int(rng.paretovariate(0.6)) % 900)))
            for i in range(300)]
    rows += [(2000, None), (2001, ""), (None, "no id"), (-4, "first"), (2002, "long text " * 20_000)]
    target = token_files.write(docs_of(rows).selectExpr("*", "1 as row", "2 as n", "'x' as body"), f"{tmpdir_path}/files",
                               shard_ids=shard_ids)
    check(spark, target, rows)
    files, n_shards = glob.glob(f"{target}/part-*"), token_files.shards(spark, target).count()
    assert (n_shards if shard_ids == 50 else 0) / token_files.FILE_SHARDS <= len(files) and n_shards > (20 if shard_ids == 50 else 0)
    text = {i: ids(t) + [token_files.END] for i, t in rows}
    wanted = [(i, j) for i, own in text.items() if i is not None for j in (0, len(own) // 2, len(own) - 1, len(own), -1)]
    wanted += [(5_000_000, 0)]
    asked = spark.createDataFrame(wanted, "doc_id long, position long")
    got = {(r.doc_id, r.position): r.token for r in token_files.token_at(spark, target, asked).collect()}
    assert got == {(i, j): (text[i][j] if i in text and 0 <= j < len(text[i]) else None) for i, j in wanted}
    flat = [x for own in text.values() for x in own]
    tokens = [token_files.END, text[2002][0], text[2002][3], 49_999, 1 << 20]
    counts = {r.token: r.n for r in token_files.token_counts(spark, target, tokens).collect()}
    assert counts == {t: flat.count(t) for t in tokens}
    for t in tokens[:4]:
        got = sorted(tuple(r) for r in token_files.token_places(spark, target, t).filter("doc_id is not null").collect())
        assert got == sorted((i, j) for i, own in text.items() if i is not None for j, x in enumerate(own) if x == t)


def test_digest(spark, docs_of):
    rows = [(5, "a b"), (5, "a b"), (3, None), (9, "c")]
    got = sorted(tuple(r) for r in token_files.digest(docs_of(rows)).collect())
    crc = lambda t: zlib.crc32(np.array(ids(t) + [2], dtype="<u4").tobytes())
    assert got == [(3, 0, 1, crc("")), (5, 1, 3, crc("a b")), (5, 4, 3, crc("a b")), (9, 7, 2, crc("c"))]
    assert token_files.digest(docs_of([])).collect() == []


def test_repeated_id_is_spread_over_ranges(spark, docs_of, tmpdir_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 5000)
    rows = [(7, "same words here")] * 3000 + [(i, f"word {i}") for i in range(8, 100)]
    target = token_files.write(docs_of(rows), f"{tmpdir_path}/hot", shard_ids=500)
    check(spark, target, rows)
    each = token_files.shards(spark, target).groupBy("part").agg(F.sum("n")).collect()
    assert max(r[1] for r in each) < 5000


def test_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    at = 0
    for (i, t), r in zip(sorted(rows, key=lambda r: r[0]), sorted(token_files.digest(docs).collect()), strict=True):
        own = np.array(ids(t) + [2], dtype="<u4")
        assert tuple(r) == (i, at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
