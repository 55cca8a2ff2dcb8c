"""Held-out accuracy of the two classifiers, and their defined results."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockyard.llm import language, quality

DATA = "/root/testdata/sf0.01"


def test_language_without_declaration(spark):
    """Declarations hidden for a fifth of the documents, the hosts made uninformative."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    hidden = F.col("doc_id") % 5 == 0
    masked = docs.select("doc_id", "text", F.when(~hidden, F.col("lang")).alias("lang"), "source", F.col("lang").alias("n"))
    found = language.identified(masked.withColumnRenamed("n", "truth")).filter(hidden).collect()
    assert len(found) == 200
    assert np.mean([r.language == r.truth for r in found]) > 0.97
    assert all(r.kept for r in found)


def test_wrong_declarations_are_outvoted(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars > 300")
    wrong = F.col("doc_id") % 10 == 0
    lied = docs.select("doc_id", "text", F.col("lang").alias("truth"),
                       F.when(wrong, F.when(F.col("lang") == "fr", "en-GB").otherwise("fr")).otherwise(F.col("lang")).alias("lang"),
                       F.concat(F.lit("https://www."), "lang", F.lit(".example."), "lang", F.lit("/x")).alias("source"))
    found = language.identified(lied).filter(wrong).collect()
    assert np.mean([r.language == r.truth for r in found]) > 0.97


def test_language_defined_results(spark, docs_of):
    english, french = "the cat and the dog of the house " * 4, "le chat et la maison de la rue est été " * 4
    schema = "doc_id long, text string, lang string, source string"
    rows = [(i, english, "en", "a.example.com") for i in range(15)] + [(20 + i, french, "fr", "b.example.fr") for i in range(15)]
    odd = [(100, None, "en", None), (101, "", None, "x"), (102, "123 !!", "fr", "b.example.fr"), (103, french, "??", ""),
           (104, french.upper(), None, None), (None, english, None, None), (0, english, "en", "a.example.com")]
    got = {}
    out = language.digest(spark.createDataFrame(rows + odd, schema).selectExpr("*", "1 as host", "2 as n"))
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.language, r.kept))
    assert got[100] == got[101] == got[102] == [("und", False)]
    assert got[103] == got[104] == [("fr", True)] and got[None] == [("en", True)] and got[0] == [("en", True)] * 2
    assert language.digest(docs_of([])).collect() == []
    none = language.digest(spark.createDataFrame([(1, "some text here", None, None), (2, "", None, None)], schema))
    assert sorted((r.doc_id, r.language, r.kept) for r in none.collect()) == [(1, "und", True), (2, "und", False)]
    kept = language.kept(spark.createDataFrame(rows + odd, schema).selectExpr("*", "1 as n", "2 as declared"))
    assert kept.count() == len(rows) + len(odd) - 3 and kept.columns[-2:] == ["n", "declared"]


def test_pages_use_tag_and_address(spark):
    body = "the cat and the dog of the house " * 4
    rows = [(i, f"https://h{i}.example.com/x", f'<html lang="en"><script>le la les</script><p>{body}</p></html>') for i in range(12)]
    out = language.pages(spark.createDataFrame(rows + [(50, None, None)], "page_id long, url string, html string"))
    got = {r.page_id: (r.language, r.kept) for r in out.collect()}
    assert got[0] == ("en", True) and got[50] == ("und", False)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.digest(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in own if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in own]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_compiled_rules_equal_the_ensemble(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    intercept, rules = quality.fitted(x, y)
    assert 0 < len(rules) < 200
    margin = intercept + sum(w * quality.fires(r, x) for r, w in rules)
    frame = spark.createDataFrame([[float(v) for v in row] for row in x[:80]], quality.STATISTICS)
    got = [r[0] for r in frame.select(quality.compiled(intercept, rules)).collect()]
    assert got == pytest.approx(1 / (1 + np.exp(-margin[:80])))
    assert np.mean((margin > 0) == (y > 0)) > 0.97


def test_quality_defined_results(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "Some words."), (3, "Some words."), (3, "Some words.")]
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.digest(docs_of(rows).selectExpr("*", "1 as score", "2 as log_chars"), labels).collect()
    assert len(out) == 5 and len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert {r.held_out for r in out if r.doc_id is None} == {False}
    none = quality.digest(docs_of(rows), labels.filter("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.digest(docs_of([]), labels).collect() == []


def test_a_language_of_few_documents_keeps_its_label(spark):
    rng = np.random.default_rng(11)
    words = {"en": "the house stands near water and many people walk there when evening comes over hills".split(),
             "fi": "talo seisoo lähellä vettä ja monet ihmiset kävelevät siellä kun ilta saapuu yli kukkuloiden".split()}
    langs = ["en"] * 60 + ["fi"] * 4
    rows = [(i, " ".join(rng.choice(words[lang], 60)), lang, "web") for i, lang in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for some in (docs, docs.filter("doc_id >= 55")):        # under ten of each language, too
        got = {r.doc_id: r.language for r in language.identified(some).collect()}
        assert got and all(got[i] == langs[i] for i in got)
