"""Sketches, exact links and components against brute force."""

import random
import re

import numpy as np
import pytest

from stockyard.llm import near_dup as nd
from stockyard.llm.graph import components


def shingle_set(text, size):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], least[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 6, 20])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own).title() if rng.random() < 0.3 else "\n".join(own))
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed,chunk", [(1, 1_000_000), (2, 3_000)])
def test_components(docs_of, monkeypatch, seed, chunk):
    monkeypatch.setattr(nd, "CHUNK", chunk)
    rows = corpus(seed) + [(20_001, ""), (20_002, " "), (20_003, "one"), (20_004, "One"), (20_005, "one two")]
    got = sorted(tuple(r) for r in nd.digest(docs_of(rows)).collect())
    assert got == brute(rows, 3, 85)


def test_pipeline_stage_keeps_one_of_each_group(docs_of):
    rows = corpus(3)
    rows += rows[:3] + [(30_000, None), (30_001, None)]
    expected = sorted(d for d, _, c, k in brute(sorted(set(rows), key=str), 5, 80) if k)
    docs = docs_of(rows).selectExpr("*", "7 as node", "8 as doc")
    out = nd.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == expected


def test_nulls_repeats_and_empty(docs_of):
    t = " ".join(f"w{i}" for i in range(30))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.digest(docs_of(
        [(None, t), (4, t), (4, t), (None, "other words stand here"), (9, None)])).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (None, None, True), (9, 9, True)], key=str)
    assert nd.digest(docs_of([])).collect() == []


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [base[:1], base[:3000], base[500:3500]]
    sketch = nd.sketches(sets, 1000)
    assert (sketch != np.iinfo(np.uint64).max).all()
    assert abs((sketch[1] == sketch[2]).mean() - 2500 / 3500) < 0.05


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    edges += [(500, 501 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "cc").collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}


def test_long_words_are_told_apart(docs_of):
    from tests.llm.conftest import certain_collision
    one, two = certain_collision()
    text = "a b c d {} e f g h".format
    rows = [(1, text(one)), (2, text(two)), (3, text(one))]
    assert sorted(tuple(r) for r in nd.digest(docs_of(rows)).collect()) == brute(rows, 3, 85)
