"""Suffix automaton against brute force; the query's SQL is checked on a small table."""

import hashlib
import random
import re

import pytest

from stockyard.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        n = min(10, len(w))
        for p in range(len(w) - n + 1):
            windows.setdefault(tuple(w[p:p + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                ids = windows.get(tuple(w[p:p + n]))
                if ids:
                    hit.update(range(p, p + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,shortest", [(1, 10), (2, 3), (3, 1)])
def test_hits(spark, docs_of, seed, shortest):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdé7" for b in ("", "x", "ño")][:9]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(shortest, 30)))) for i in range(12)]
    items += [(12, items[0][1]), (13, " ".join(items[1][1].split()[:9]) or "a"), (None, "a b"), (14, None), (15, " .,")]
    rows = []
    for i in range(60):
        body = text(rng.randint(0, 60))
        if rng.random() < 0.6:
            piece = rng.choice(items[:12])[1].split()
            a = rng.randint(0, len(piece))
            at = rng.randint(0, len(body))
            body[at:at] = piece[a:a + rng.randint(5, 20)]
        rows.append((i, rng.choice([" ", ". ", "\n"]).join(body).title()))
    rows += [(70, None), (71, ""), (71, ""), (None, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([tuple(r) for r in dc.digest(docs_of(rows), benchmark).collect()], key=str)
    assert got == brute(rows, items)


def test_several_blocks_give_the_same(spark, docs_of, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(15))) for i in range(20)]
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(30)) + " " + rng.choice(items)[1]) for i in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK_BYTES", 100)
    got = sorted([tuple(r) for r in dc.digest(docs_of(rows), benchmark).collect()], key=str)
    assert got == brute(rows, items)


def test_spans_go_and_clean_text_stays(spark, docs_of):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, f"One two. {item.upper()}, then more words follow here and there."), (2, "Quite Clean.  Text"),
            (3, item), (4, None)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of(rows).selectExpr("*", "1 as part", "2 as n_hit")
    out = {r.doc_id: r for r in dc.decontaminated(docs, benchmark).collect()}
    assert set(out) == {1, 2, 4} and out[2].text == "Quite Clean.  Text" and out[4].text is None
    assert out[1].text == "One two. then more words follow here and there." and out[1].n_chars == len(out[1].text)
    assert out[1].part == 1 and out[1].lang == "en"
    empty = benchmark.filter("false")
    assert dc.decontaminated(docs, empty).count() == 4
    assert dc.digest(docs_of([]), benchmark).collect() == []


def test_repeated_items_take_no_room_in_blocks(spark, monkeypatch):
    from stockyard.llm import decontaminate
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    rows = [("hot", "a" * 40)] * 50 + [(f"i{n}", f"{n}" * 40) for n in range(4)]
    blocks = list(decontaminate.item_blocks(spark.createDataFrame(rows, "item_id string, text string")))
    assert len(blocks) == 2 and sorted(x for b in blocks for x in b) == sorted(set(rows))


def test_long_words_are_told_apart(spark, docs_of):
    from stockyard.llm.arrays import SPACE_TABLE, Words, text_bytes
    from tests.llm.conftest import certain_collision
    import pyarrow as pa
    for n in (64, 65, 1024, 4096):
        one, two = certain_collision(n)
        a, b, c = Words(*text_bytes(pa.array([one, two, f" {one}"])), SPACE_TABLE, zero_is_word=True).hashes()
        assert a == c != b
    one, two = certain_collision()
    rows = [(1, f"a {one} b"), (2, f"a {two} b"), (3, f"x a {one} b y")]
    items = [(1, f"a {one} b")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([tuple(r) for r in dc.digest(docs_of(rows), benchmark).collect()], key=str)
    assert got == brute(rows, items) and [r[2] for r in got] == [3, 0, 3]
