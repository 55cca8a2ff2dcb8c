"""Balance and links of the sharding, exact search against brute force."""

import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stockyard.llm import kd_search, shards


@pytest.mark.parametrize("n,copies", [(0, 0), (7, 2), (240, 90), (500, 170)])
def test_rows_are_level_and_copies_together(docs_of, n, copies):
    rng = random.Random(n)
    rows = [(i, "hot text") for i in range(copies)]
    rows += [(i, f"text {rng.randint(0, n)}" if i % 2 else f"own {i}") for i in range(copies, n)]
    rows += [(10_000, None), (None, None), (10_001, ""), (10_001, "")] if n else []
    got = shards.digest(docs_of(rows).selectExpr("*", "1 as hub", "2 as row", "3 as shard")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = dict(rows)
    for r in got:
        t = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t)) and r.law == "rows" and r.grown_shard is None
    groups = {}
    for r in got:
        if r.group_row is not None:
            groups.setdefault(r.group_row, []).append(r.shard)
    quota = math.ceil(len(rows) / 24)
    small = [g for g in groups.values() if len(g) <= quota // 3]
    assert sum(len(set(g)) == 1 for g in small) >= 0.9 * len(small)


@pytest.mark.parametrize("sizes,unlinked,scattered", [
    ([800, 99, 95, 90, 80, 70, 60, 50, 40, 34], 982, 0),       # a third of all rows, and groups above quota/3
    ([600, 450, 120] + [45] * 10 + [2] * 300, 180, 1),         # several groups above a quota
    ([60] * 40, 0, 16)])                                       # 24 shards hold one group each, and no row can give way
def test_groups_are_cut_only_where_no_shard_has_room(spark, sizes, unlinked, scattered):
    n = sum(sizes) + unlinked
    hubs = [g for g, size in enumerate(sizes) for _ in range(size)] + [None] * unlinked
    links = spark.createDataFrame(list(enumerate(hubs)), "row long, hub long")
    got = shards.placed(links).collect()
    assert sorted(r.row for r in got) == list(range(n)) and all(hubs[r.row] == r.hub for r in got)
    counts = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    quota, used = n // 24, {}
    for r in got:
        used.setdefault(r.hub, set()).add(r.shard)
    for g, size in enumerate(sizes):
        assert size <= quota or len(used[g]) <= size // quota + 2
    assert sum(len(used[g]) > 1 for g, size in enumerate(sizes) if size <= quota) <= scattered


def pairs_cut(hubs, shard):
    """Pairs of rows that share a hub and stand in different shards, counted for each hub."""
    return sum(shard[a] != shard[b] for rows in hubs.values() for a, b in itertools.combinations(sorted(rows), 2))


def optimum(hubs, n, k):
    """Least number of cut pairs over all level placements of n rows."""
    counts = [n // k + (s < n % k) for s in range(k)]
    return min(pairs_cut(hubs, at) for at in itertools.product(range(k), repeat=n)
               if sorted(at.count(s) for s in range(k)) == sorted(counts))


GRAPHS = {
    "two groups and a bridge": ({1: [0, 2, 4, 6, 8], 2: [1, 3, 5, 7, 9], 3: [0, 1]}, 10, 2),
    "two hubs a row": ({1: [0, 1, 2, 3], 2: [0, 1, 2, 3], 3: [4, 5, 6, 7], 4: [4, 5, 6, 7], 5: [3, 4]}, 8, 2),
    "three groups in a ring": ({1: [0, 3, 6], 2: [1, 4, 7], 3: [2, 5, 8], 4: [0, 1], 5: [4, 2], 6: [5, 6]}, 9, 3),
    "blocks that fit": ({1: [0, 1], 2: [1, 2], 3: [3, 4], 4: [4, 5]}, 6, 2),
    "links through one row": ({h: [0, h] for h in range(1, 8)}, 8, 2),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_rows_of_several_hubs_reach_the_least_cut(spark, name):
    hubs, n, k = GRAPHS[name]
    links = [(row, hub) for hub, rows in hubs.items() for row in rows]
    frame = spark.createDataFrame(links + links[:3], "row long, hub long")       # a link given twice counts once
    got = shards.placed(frame, k)
    shard = {r.row: r.shard for r in got.collect()}
    assert sorted(shard) == list(range(n)) == sorted(r.row for r in got.collect())
    counts = [list(shard.values()).count(s) for s in range(k)]
    assert max(counts) - min(counts) <= 1
    cut = shards.cut_links(got, frame).first()
    assert cut.pairs == pairs_cut(hubs, shard) and cut.n_links == len(links)
    assert cut.pairs == optimum(hubs, n, k)


def test_propagation_lowers_the_cut_of_a_large_block(spark):
    """One block of 1,200 rows that no shard holds: groups of 12 and a bridge from each to the next."""
    links = [(row, row // 12) for row in range(1200)] + [(12 * g, 1000 + g) for g in range(100)] + [
        (12 * g + 1, 1000 + (g + 1) % 100) for g in range(100)]
    frame = spark.createDataFrame(links, "row long, hub long")
    got = shards.placed(frame, 6)
    counts = sorted(r["count"] for r in got.groupBy("shard").count().collect())
    assert counts == [200] * 6
    at_random = got.select("row", "hub", (F.xxhash64("row") % 6).alias("shard"))
    before, after = shards.cut_links(at_random, frame).first(), shards.cut_links(got, frame).first()
    assert before.pairs > 5000 and after.pairs < 0.25 * before.pairs


def brute(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = []
    for q in usable:
        if q % 20 == 0:
            own = usable[q][0]
            scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, vs in usable.items() if i != q
                            for v in vs if len(v) == len(own))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("leaf,shard_rows", [(256, 16_384), (8, 100)])
def test_search(spark, monkeypatch, leaf, shard_rows):
    rng = random.Random(leaf)
    vector = lambda n=6: [rng.uniform(-1, 1) for _ in range(n)]
    hot = vector()
    rows = [(i, hot if i % 3 == 0 else vector()) for i in range(400)]
    rows += [(400, None), (420, []), (440, [0.1, None] * 3), (460, [float("nan")] * 6), (480, [float("inf")] * 6),
             (None, vector()), (500, vector(4)), (501, vector(4)), (502, vector(4)), (520, [0.0] * 6)]
    monkeypatch.setattr(kd_search, "SHARD_ROWS", shard_rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as shard", "2 as v")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in kd_search.digest(frame).collect())
    assert got == brute(rows, 20)
    assert kd_search.digest(frame.filter("vec_id < 0")).collect() == []


def clamped(rows, k):
    """As ``brute``, with components and scores held to the range of a long."""
    low, high = -2**63, 2**63 - 1
    hold = lambda x: min(max(x, low), high)
    v = {i: [hold(math.floor(64 * x)) for x in vec] for i, vec in rows}
    out = []
    for q in v:
        if q % 20 == 0:
            scores = sorted((-hold(sum(a * b for a, b in zip(v[q], w))), i) for i, w in v.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("top", [2.0**20, 2.0**22, 2.0**30, 1e18, 1e300])
def test_large_components_are_exact(spark, monkeypatch, top):
    rng = random.Random(int(math.log2(top)))
    rows = [(i, [rng.uniform(-top, top) for _ in range(8)]) for i in range(60)]
    rows += [(100, [top] * 8), (101, [top] * 8), (120, [-top] * 8), (2**62 + 4, [top] * 8), (2**62 + 5, [top] * 8)]
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 40)
    monkeypatch.setattr(kd_search, "LEAF", 8)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in kd_search.digest(frame).collect())
    assert got == clamped(rows, 20)


def test_tree_prunes():
    import numpy as np
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(size=(20_000, 2)) * 64)
    tree = kd_search.KdTree(np.arange(20_000), points)
    for n, rows in enumerate(tree.rows):
        if rows is not None:
            assert (points[tree.ids[rows]] >= tree.low[n]).all() and (points[tree.ids[rows]] <= tree.high[n]).all()
    assert sorted(np.concatenate([r for r in tree.rows if r is not None])) == list(range(20_000))
    queries = points[::500]
    for q, bounds in zip(queries, tree.bounds(queries)):
        want = sorted(zip((-(points @ q)).astype(int).tolist(), range(20_000)))[:20]
        assert tree.best(q, bounds, -1, 20, None) == [(-s, i) for s, i in want]
    assert tree.visited < 0.1 * len(queries) * len(points)
