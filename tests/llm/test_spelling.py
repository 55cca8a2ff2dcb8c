"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stockyard.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def edited(rng, w, alphabet):
    i = rng.randint(0, len(w))
    kind = rng.randint(0, 2)
    return w[:i] + (rng.choice(alphabet) if kind else "") + w[i + (kind != 1):]


def corpus(seed, alphabet, bases, size):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 11))) for _ in range(bases)]
    for _ in range(4):
        words += [edited(rng, rng.choice(words), alphabet) for _ in range(bases)]
    weights = [1 / (1 + rng.randrange(len(words))) for _ in words]
    signs = [" ", ", ", "-", "1", "\n", "日"]
    rows = [(i, "".join(rng.choices(words, weights)[0] + rng.choice(signs) for _ in range(size))) for i in range(60)]
    return rows


def found(docs, **how):
    return {tuple(r) for r in spelling.variants(docs, **how).collect()}


@pytest.mark.parametrize("alphabet,bases", [("ab", 30), ("abcdefghij", 120), ("aAbBéÉÿ×à", 60)])
def test_against_brute_force(docs_of, alphabet, bases):
    rows = corpus(bases, alphabet, bases, 150)
    got, want = found(docs_of(rows)), brute(rows)
    assert got == want
    assert sum(r[4] for r in want) > 50 and any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)


@pytest.mark.parametrize("piece", [1, 2, 3, 5])
def test_pieces_do_not_change_the_result(docs_of, piece):
    rows = corpus(7, "abc", 40, 100)
    assert found(docs_of(rows), piece=piece) == brute(rows)


def test_large_group_is_tiled(docs_of):
    """A group of hundreds of words (several block pairs) that differ in one place or two."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xE0, 0xF7), *range(0xF8, 0x100)]]
    words = [a + b + "stem" for a in letters[:20] for b in letters]
    rows = [(i, " ".join(words)) for i in range(4)]
    got = found(docs_of(rows))
    assert got == brute(rows)
    assert max(r[4] for r in got) > 60


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (None, "apples apples apples applex"), (3, "Apples APPLES applex applex apple apple apple")]
    rows += [(3, rows[3][1])] * 3 + [(4, "x" * 5000 + " " + "x" * 4999), (4, "x" * 5000), (5, "x" * 5000 + " " + "x" * 4999 + "  " + "x" * 4999)]
    extra = docs_of(rows).selectExpr("*", "1 as word", "2 as n", "'q' as form", "3 as run")
    assert found(extra) == brute(rows)
    assert found(docs_of([])) == set()
    assert found(docs_of([(1, None)])) == set()


def test_chain_of_forms(docs_of):
    counts = {"abcdefgh": 200, "abcdefg": 90, "abcdef": 40, "abcde": 15, "abcdx": 4}
    rows = [(1000 + i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    assert not any(zlib.crc32(f"{i}:{w}".encode()) % 97 == 0 for i, t in rows for w in set(t.split()))
    root = {r[0]: r[2] for r in found(docs_of(rows))}
    assert set(root.values()) == {"abcdefgh"} and len(root) == 5


def test_tile_on_all_pairs():
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 7))) for _ in range(200)})
    left, right, size = spelling.matrices(words)
    side = (left[None], right[None], size[None])
    near = spelling.near_tile(side, side, np.array([0]), 100)[0]
    assert [[bool(x) for x in r] for r in near] == [[one_edit(a, b) for b in words] for a in words]
