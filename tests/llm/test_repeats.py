"""Byte and word repeats against brute force."""

import hashlib
import random
import re

import pytest

from stockyard.llm import substring_dedup, suffix_dedup


def corpus(seed, unit, n=40):
    """Documents that share passages around the length limit, whole copies and edits."""
    rng = random.Random(seed)
    words = [unit(rng) for _ in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [text(rng.randint(10, 140)) for _ in range(8)]
    rows = []
    for i in range(n):
        body = text(rng.randint(0, 160))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            piece = list(rng.choice(shared))
            cut = rng.randint(0, len(piece))
            body[at:at] = piece[cut:] if rng.random() < 0.5 else piece
        if rows and rng.random() < 0.3:
            body = rng.choice(rows)[1].split(" ")
            if body and rng.random() < 0.7:
                body = body[:]
                body[rng.randrange(len(body))] = "edit"
        rows.append((rng.randint(0, 10_000) if i % 7 else i, " ".join(body)))
    return list(dict(rows).items())


def brute_bytes(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            if s in seen:
                gone[p:p + length] = [True] * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[p:p + length]) for p in range(len(w) - length + 1)]
        gone = [False] * len(w)
        for p, s in enumerate(windows):
            if s in seen:
                gone[p:p + length] = [True] * length
        seen.update(windows)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot,segment", [(8, 1 << 20), (2, 300)])
def test_byte_repeats(docs_of, hot, segment):
    rows = corpus(hot, lambda r: "".join(r.choice("abcdé ñ") for _ in range(r.randint(1, 7))))
    rows += [(20_001, None), (20_002, ""), (20_003, "z" * 350), (20_004, "xy" * 199)]
    got = {r.doc_id: tuple(r[1:]) for r in suffix_dedup.digest(docs_of(rows), many=hot, segment=segment).collect()}
    assert got == brute_bytes(rows, 100)


@pytest.mark.parametrize("hot,segment", [(8, 1 << 20), (2, 60)])
def test_word_repeats(docs_of, hot, segment):
    rows = corpus(hot + 5, lambda r: "".join(r.choice("aAbé \x00") for _ in range(r.randint(1, 4))))
    rows += [(20_001, None), (20_002, " \n"), (20_003, "same " * 350), (20_004, "\t".join("pq" * 120))]
    got = {r.doc_id: tuple(r[1:]) for r in substring_dedup.digest(docs_of(rows), many=hot, segment=segment).collect()}
    assert got == brute_words(rows, 50)


def test_spans_and_kept_text_agree(docs_of):
    rows = [(1, "head " + " ".join(f"w{i}" for i in range(60)) + " tail"),
            (2, " ".join(f"w{i}" for i in range(60)) + " other end")]
    by = {r.doc_id: r for r in substring_dedup.without_copies(docs_of(rows)).collect()}
    assert by[1].spans == [] and by[1].kept == rows[0][1]
    assert [tuple(s) for s in by[2].spans] == [(0, 60)] and by[2].kept == "other end"
    raw = {r.doc_id: r for r in suffix_dedup.without_repeats(docs_of(rows)).collect()}
    body = rows[1][1].encode()
    assert bytes(raw[2].kept) == b"".join(
        body[a:b] for a, b in zip([0] + [s.stop for s in raw[2].spans],
                                  [s.start for s in raw[2].spans] + [len(body)]))


def test_repeated_rows_null_ids_and_empty_table(docs_of, spark):
    t = " ".join(f"u{i}" for i in range(80))
    rows = [(5, t), (5, t), (None, t), (7, t)]
    got = sorted((r.doc_id is None, r.doc_id, r.n_removed)
                 for r in substring_dedup.digest(docs_of(rows)).collect())
    assert got == [(False, 5, 0), (False, 5, 0), (False, 7, 80), (True, None, 80)]
    extra = docs_of(rows).selectExpr("doc_id", "text", "1 as doc", "2 as ranges", "'x' as part", "0 as text_hash")
    assert sorted(r.n_removed for r in suffix_dedup.digest(extra).collect()) == [0, 0, len(t), len(t)]
    empty = docs_of([])
    assert suffix_dedup.digest(empty).collect() == substring_dedup.digest(empty).collect() == []


def test_long_words_are_told_apart(docs_of):
    from tests.llm.conftest import certain_collision
    one, two = certain_collision()
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:30] + [one] + words[31:])), (2, " ".join(words[:30] + [two] + words[31:])),
            (3, " ".join(words[:30] + [one] + words[31:]))]
    got = {r.doc_id: tuple(r[1:]) for r in substring_dedup.digest(docs_of(rows)).collect()}
    assert got == brute_words(rows, 50) and [got[i][1] for i in (1, 2, 3)] == [0, 0, 60]


@pytest.mark.parametrize("hot", [8, 2])
def test_factors_are_copies(docs_of, hot):
    """Each factor stands in its reference word for word; together they cover what goes."""
    rows = corpus(hot + 20, lambda r: "".join(r.choice("abc") for _ in range(r.randint(1, 4))))
    words = {i: t.split() for i, t in rows}
    passage = [f"p{i}" for i in range(400)]
    words |= {30_000: passage, 30_001: ["x", "y", *passage, "z"], 30_002: passage[100:300] + words[rows[0][0]]}
    rows = [(i, " ".join(w)) for i, w in words.items()]
    found = substring_dedup.factors(docs_of(rows), many=hot).collect()
    covered = {i: set() for i in words}
    for f in found:
        assert f.length >= 50 and f.ref_id < f.doc_id
        assert words[f.doc_id][f.start:f.start + f.length] == words[f.ref_id][f.ref_start:f.ref_start + f.length]
        covered[f.doc_id].update(range(f.start, f.start + f.length))
    assert {i: len(c) for i, c in covered.items()} == {i: r[1] for i, r in brute_words(rows, 50).items()}
    long = [(f.doc_id, f.start, f.length, f.ref_id, f.ref_start) for f in found if f.doc_id >= 30_000]
    assert (30_001, 2, 400, 30_000, 0) in long and (30_002, 0, 200, 30_000, 100) in long


def test_suffix_ranks_against_sorting():
    import numpy as np
    rng = np.random.default_rng(2)
    values = rng.integers(0, 3, 900).astype(np.uint8)
    values[300:500] = values[:200]
    for length in (1, 3, 7, 8, 9, 31, 100):
        at = np.arange(len(values) - length + 1)
        windows = [bytes(values[i:i + length]) for i in at]
        place = {w: n for n, w in enumerate(sorted(set(windows)))}
        assert suffix_dedup.suffix_ranks(values, at, length).tolist() == [place[w] for w in windows]


def test_steps_pass_on_rows_by_the_text_alone(docs_of, spark):
    """However the work is dealt, phrases and runs give the same number of rows, about."""
    from stockyard.llm import spans
    rows = corpus(3, lambda r: "".join(r.choice("abcde") for _ in range(r.randint(1, 7))), 120)
    before, counts = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            counts.append(spans.repeated_ranges(spans.keyed(docs_of(rows)), suffix_dedup.byte_units, suffix_dedup.sorted_suffixes,
                                                __import__("numpy").dtype("u1"), 100, 32, False, 1.0, 1000).count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert counts[1] < 1.5 * counts[0]
