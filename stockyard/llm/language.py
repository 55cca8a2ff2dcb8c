"""Language identification by Bayesian evidence fusion.

Three kinds of evidence about a document's language are multiplied:

* **Text**: likelihood of its letter trigrams under each language's trigram
  frequencies, counted over the whole corpus by declared language. Overlapping
  trigrams are not independent, so the log likelihood is tempered.
* **Declared markup language**: probability of the declaration given the language,
  from the counts of (language of the text alone, declaration).
* **Address**: prior of the host, smoothed towards its registered domain, that one
  towards the address suffix, and that one towards the corpus, each with a pseudo
  count; all counted by grouped aggregation of the text-only decisions.

Languages are all two-letter codes that documents declare, rare ones too (smoothing keeps
a code of few trigrams from drawing other documents), so the model has at most 676 rows of ``BUCKETS`` values; it is the only thing that is
broadcast. Host tables grow with the corpus and are joined.

Defined results: a text without letters (null and empty ones too) has no
evidence, is "und" and rejected, whatever is declared; a missing or unknown
declaration or address contributes nothing; ties go to the alphabetically first
language; rows are judged each for itself, so repeated rows and null ids give
their own rows; without any usable declaration in the corpus every row is "und"
with confidence 0 but kept if it has letters; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.arrays import text_bytes
from stockyard.llm.common import NO_ID, slices, stored

BUCKETS = 1 << 13
LEAST_TRIGRAMS = 20          # trigrams of a text whose own decision counts for priors
TEMPER = 1 / 3               # weight of a trigram's log likelihood
PSEUDO = 10.0                # documents' worth of the wider level in each prior
CONFIDENT = 0.5              # a document below this is rejected

_CLASS = np.full(256, 0x20, dtype=np.uint8)          # what is no letter counts as a space
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def trigrams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every byte trigram that holds a letter, within rows."""
    data, bounds = text_bytes(batch.column("text"))
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    letters = _CLASS[data]
    after = np.zeros(len(data), dtype=bool)           # Latin capitals of two bytes, lower-cased
    after[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    letters = (letters + (after * np.uint8(0x20))).astype(np.uint32)
    code = (letters[:-2] << np.uint32(16)) | (letters[1:-1] << np.uint32(8)) | letters[2:]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = (row[:-2] == row[2:]) & (code != 0x202020)
    hashed = (code[inside] * np.uint32(2654435761)) >> np.uint32(32 - 13)
    return hashed.astype(np.int64), row[:-2][inside]


def declared_code(column: Column) -> Column:
    """Primary subtag of a declaration such as ``en-GB``, if it has two letters."""
    code = F.regexp_extract(F.lower(F.trim(column.cast("string"))), "^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(code != "", code)


def address_levels(column: Column) -> list[Column]:
    """(host, domain, suffix) of a URL or host name; without a dot there is only a host."""
    host = F.lower(F.regexp_extract(F.trim(column.cast("string")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return [host.alias("host"), F.when(domain != "", domain).otherwise(host).alias("domain"),
            F.when(suffix != "", suffix).alias("suffix")]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all declared documents; bucket -1 counts documents."""
    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            declared = np.array(batch.column("declared").to_pylist())
            bucket, row = trigrams(batch)
            for lang in set(declared.tolist()):
                own = declared == lang
                sums = total.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                sums[:BUCKETS] += np.bincount(bucket[own[row]], minlength=BUCKETS)
                sums[BUCKETS] += int(own.sum())
        for lang, sums in sorted(total.items()):
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at), pa.int32()),
                 pa.array(sums[at])], names=["lang", "bucket", "n"])

    return docs.filter("declared is not null").select("declared", "text").mapInArrow(
        count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities): at most 676 languages of BUCKETS values."""
    rows = stored(trigram_counts(docs), "trigrams")
    langs = sorted(r["lang"] for r in rows.filter("bucket = -1").collect())
    counts = np.zeros((len(langs), BUCKETS))
    place = {lang: i for i, lang in enumerate(langs)}
    for r in rows.filter("bucket >= 0").filter(F.col("lang").isin(langs)).collect():
        counts[place[r["lang"]], r["bucket"]] = r["n"]
    return langs, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)


def scored(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``docs`` without their texts, with trigram count and tempered log likelihoods."""
    keep = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(model)        # at most 676 x BUCKETS floats

    def score(batches):
        for batch in slices(batches):
            bucket, row = trigrams(batch)
            n = np.bincount(row, minlength=batch.num_rows)
            sums = [np.bincount(row, weights=line[bucket], minlength=batch.num_rows) * TEMPER for line in sent.value]
            values = np.stack(sums, axis=1) if sums else np.zeros((batch.num_rows, 0))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(n, pa.int64()),
                 pa.array(values.tolist(), pa.list_(pa.float64()))], names=[*keep, "n", "loglik"])

    out_schema = docs.select(*keep, F.lit(0).cast("long").alias("n"),
                             F.array(F.lit(0.0)).alias("loglik")).schema
    return docs.mapInArrow(score, out_schema)


def smoothed(counts: DataFrame, level: str, corpus: Column, wider: DataFrame | None = None,
             wider_level: str | None = None) -> DataFrame:
    """(level, prior): a level's counts with PSEUDO documents of the wider level's prior
    (of the corpus where there is none)."""
    n = sum(c[0] == "c" and c[1:].isdigit() for c in counts.columns)
    keys = [level, wider_level] if wider_level else [level]
    own = counts.filter(F.col(level).isNotNull()).groupBy(*keys).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n)])
    above = corpus
    if wider is not None:
        own = own.join(wider.withColumnRenamed("prior", "above"), wider_level, "left")
        above = F.coalesce("above", corpus)
    total = sum((F.col(f"c{i}") for i in range(n)), F.lit(0.0))
    return own.select(level, F.array(*[(F.col(f"c{i}") + PSEUDO * above[i]) / (total + PSEUDO)
                                       for i in range(n)]).alias("prior"))


def identified(docs: DataFrame, text: str = "text", declared: str | None = "lang",
               address: str | None = "source") -> DataFrame:
    """``docs`` without the text column, with n (trigrams), language, confidence and kept."""
    other = [c for c in docs.columns if c != text]
    passed = {f"__{i}": c for i, c in enumerate(other)}
    none = F.lit(None).cast("string")
    levels = address_levels(F.col(address)) if address else [none.alias(x) for x in ("host", "domain", "suffix")]
    base = docs.select(*[F.col(c).alias(k) for k, c in passed.items()],
                       (declared_code(F.col(declared)) if declared else none).alias("declared"), *levels,
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    langs, model = text_model(base)
    names = [F.col(k).alias(c) for k, c in passed.items()]
    table = stored(scored(base, langs, model), "scored")
    if not langs:
        return table.select(*names, "n", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"),
                            (F.col("n") > 0).alias("kept"))
    best = F.array_position("loglik", F.array_max("loglik")).cast("int") - 1
    guessed = table.filter(F.col("n") >= LEAST_TRIGRAMS).select(
        "host", "domain", "suffix", "declared", best.alias("guess"))
    counts = stored(guessed.groupBy("host", "domain", "suffix", "declared").agg(
        *[F.sum((F.col("guess") == i).cast("double")).alias(f"c{i}") for i in range(len(langs))]), "counts")
    every = counts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(len(langs))]).first()
    total = sum(every) + len(langs)
    corpus = [(every[i] + 1) / total for i in range(len(langs))]

    # the declaration given the language: at most 676 rows, one for each code
    given = counts.filter("declared is not null").groupBy("declared").agg(
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(langs))])
    given = given.select("declared", F.array(*[
        F.log((F.col(f"c{i}") + 0.5) / F.lit(every[i] + 0.5 * (len(langs) + 1))) for i in range(len(langs))]).alias("said"))
    table = table.join(F.broadcast(given), "declared", "left")

    whole = F.array(*[F.lit(x) for x in corpus])
    by_suffix = smoothed(counts, "suffix", whole)
    by_domain = smoothed(counts, "domain", whole, by_suffix, "suffix")
    by_host = stored(smoothed(counts, "host", whole, by_domain, "domain"), "hosts")

    fused = table.join(by_host, "host", "left")
    flat = F.array(*[F.lit(float(np.log(x))) for x in corpus])
    weight = F.transform(
        F.arrays_zip("loglik", F.coalesce(F.transform("prior", lambda p: F.log(p)), flat).alias("prior"),
                     F.coalesce("said", F.array_repeat(F.lit(0.0), len(langs))).alias("said")),
        lambda e: e["loglik"] + e["prior"] + e["said"])
    fused = fused.withColumn("weight", weight).withColumn("most", F.array_max("weight"))
    confidence = 1 / F.aggregate("weight", F.lit(0.0), lambda s, w: s + F.exp(w - F.col("most")))
    code = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("weight", F.col("most")).cast("int"))
    has = F.col("n") > 0
    return fused.select(
        *names, "n", F.when(has, code).otherwise("und").alias("language"),
        F.when(has, confidence).otherwise(0.0).alias("confidence"), (has & (confidence >= CONFIDENT)).alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language cannot be told."""
    columns = docs.columns
    keys = {"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
            "__hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    named = docs.withColumns(keys)
    judged = identified(named.select("__doc", "__hash", "text", "lang", "source"))
    # rejected rows alone are matched; the planner broadcasts them only where their stored size allows
    rejected = stored(judged.filter("not kept").select("__doc", "__hash").distinct(), "rejected")
    return named.join(rejected, ["__doc", "__hash"], "left_anti").select(*columns)


def digest(docs: DataFrame) -> DataFrame:
    return identified(docs.select("doc_id", "text", "lang", "source")).select(
        "doc_id", F.col("lang").alias("declared"), F.col("source").alias("host"), F.col("n").alias("n_trigrams"),
        "language", "confidence", "kept")


def pages(table: DataFrame) -> DataFrame:
    """Language of raw web pages: declaration from the html tag, host from the address."""
    html = F.coalesce(F.col("html"), F.lit(""))
    declared = F.regexp_extract(html, r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1)
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return identified(table.select("page_id", "url", declared.alias("lang"), visible.alias("text")), address="url").select(
        "page_id", "url", F.col("lang").alias("declared"), F.col("n").alias("n_trigrams"), "language", "confidence", "kept")
