"""Skip list against plain slicing, outputs against the rule, exact rebuilding."""

import hashlib
import random
import re

import numpy as np
import pytest

from stockyard.llm import fill_middle


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_every_rank_is_reached_exactly(fan):
    rng = np.random.default_rng(fan)
    for n in (0, 1, 2, fan, fan + 1, fan * fan, 777):
        points = rng.integers(0, 5, n)
        lane = fill_middle.SkipList(points, fan)
        assert lane.units == n
        ends = np.concatenate([[0], np.cumsum(points)])
        assert [lane.find(r) for r in range(n + 1)] == ends.tolist()
        for rank in (-1, n + 1):
            with pytest.raises(IndexError):
                lane.find(rank)


def expected(i, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * j:8 * j + 8], 16) for j in range(4)]
    n = len(t)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, sha(t), sha(t)
    if h[3] % 100 < 20:
        return i, n, "spm", a, b - a, sha("<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]), sha(t)
    return i, n, "psm", a, b - a, sha("<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]), sha(t)


def test_digest_by_the_rule(docs_of):
    rng = random.Random(3)
    signs = list("ab <>PSM\n\t\x00é日🙂") + ["é", "👩‍🚀", "\r\n"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 90)))) for i in range(400)]
    rows += [(401, None), (402, ""), (403, "with <M> inside"), (404, "x" * 300_000 + "🙂" * 7), (None, "no id"),
             (-5, "negative"), (7, rows[7][1])]
    extra = docs_of(rows).selectExpr("*", "1 as n", "'x' as form", "2 as output")
    got = [tuple(r) for r in fill_middle.digest(extra).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digest(docs_of([])).collect() == []


@pytest.mark.parametrize("units", [None, r"\w+", r"[^\n]*\n"])
def test_outputs_give_the_text_back(docs_of, units):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab <S>PM\né") for _ in range(rng.randint(0, 120)))) for i in range(300)]
    text = dict(rows)
    cuts = 0
    for r in fill_middle.transformed(docs_of(rows), units).collect():
        assert fill_middle.restored(r.output, r.form) == text[r.doc_id]
        if r.form != "plain":
            widths = fill_middle.unit_points(text[r.doc_id], re.compile(units) if units else None)
            assert len(widths) == r.n and widths.sum() == len(text[r.doc_id])
            assert widths[:r.prefix_units].sum() == r.prefix_chars
            assert widths[r.prefix_units:r.prefix_units + r.middle_units].sum() == r.middle_chars
            cuts += 1
    assert cuts > 100


def test_shares_of_the_forms(docs_of):
    rows = [(i, "some words") for i in range(4000)]
    forms = [r.form for r in fill_middle.digest(docs_of(rows)).select("form").collect()]
    assert abs(forms.count("plain") / 4000 - 0.1) < 0.02
    assert abs(forms.count("spm") / (4000 - forms.count("plain")) - 0.2) < 0.03
