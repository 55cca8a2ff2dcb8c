"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Base candidates are the leftmost, non-overlapping matches of three fixed
patterns. Each candidate value is hashed, and two grouped counts over the whole
corpus tell in how many distinct repositories and under how many distinct owners it
stands. A value that many owners have is a widely copied example. A value of one owner that stands
in most of that owner's repositories is the owner's own boilerplate; one that does not, and looks random, is a
live-looking credential of that owner. What the
frequency adds are further spans: where a live-looking value stands bare, without
a keyword before it and outside the base spans, that place is marked as well.

Positions come from the lengths of the pieces between matches, added up over
the matches of a row. Counts are grouped by (value, owner, repository) first, so a
value that a third of all rows hold is pre-aggregated before each shuffle.

Defined results: a null text is empty and has no spans; a null owner or
repository counts as one value of its own; each row is scanned by itself, so
repeated rows and null ids give their own rows; a tie in start is ordered by
kind; other columns are ignored by ``scanned`` and passed through by ``redacted``;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.llm.common import NO_ID, stored

# The kinds, their patterns, and the least length of what counts.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
          r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# Both patterns take whole runs, so demanding the length in the pattern finds
# just the base matches that are long enough.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# A bare value: a run of value characters that holds a digit and a letter.
BARE = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{12,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "bare": BARE}
LEAST_VALUE = 6

MANY_OWNERS = 3          # owners from which a value is a copied example
COMMON_SHARE = 0.5       # share of its one owner's repositories above which a value is boilerplate
COMMON_LEAST = 3         # repositories that it takes at least
LIVE_LENGTH = 12         # characters of a live-looking value
LIVE_DISTINCT = 8        # different characters of it
MASK = "[REDACTED]"


def located(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, candidates): every row with its number, and every candidate with its place.

    rows: row, doc, text_hash, doc_id. candidates: row, owner, repository, kind,
    start, stop, value (the secret's own text), read from a scratch table that holds
    matches and lengths but no texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.array(*[
        F.struct(F.lit(n).alias("order"), F.lit(k).alias("kind"),
                 F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("matches"),
                 F.transform(F.split(text, p, -1), lambda x: F.length(x)).alias("between"))
        for n, (k, p) in enumerate(KINDS.items())])
    table = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"),
        F.col("owner").cast("string").alias("owner"), F.col("repository").cast("string").alias("repository"),
        F.filter(found, lambda k: F.size(k["matches"]) > 0).alias("found")), "matches")
    each = table.select("row", "owner", "repository", F.explode("found").alias("k")).select(
        "row", "owner", "repository", "k.order", "k.kind",
        F.posexplode(F.arrays_zip("k.matches", F.col("k.between").alias("between"))).alias("n", "m"))
    before = Window.partitionBy("row", "order").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("match")
    placed = each.select("row", "owner", "repository", "order", "kind", "n", F.col("m.matches").alias("match"),
                         F.col("m.between").alias("between")).withColumn(
        "start", (F.sum(F.col("between") + size).over(before) - size).cast("long"))
    value = F.when(F.col("kind") == "assign", F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    candidates = placed.filter("match is not null").select(
        "row", "owner", "repository", "order", "kind", "start", (F.col("start") + size).alias("stop"),
        value.alias("value")).filter((F.col("kind") != "assign") | (F.length("value") >= LEAST_VALUE))
    return table.select("row", "doc", "text_hash", "doc_id", "owner", "repository"), stored(candidates, "candidates")


def ownership(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners, status) of every base candidate value; ``rows`` tell how many
    repositories an owner has."""
    value = candidates.filter("kind <> 'bare'").select(
        F.sha2("value", 256).alias("hash"), "owner", "repository", _looks_live(F.col("value")).alias("random"))
    each = value.groupBy("hash", "owner", "repository").agg(F.max("random").alias("random"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max("random").alias("random"))
    total = by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"),
                                         F.max("random").alias("random"), F.min("owner").alias("owner"))
    owners = rows.select("owner", "repository").distinct().groupBy("owner").agg(F.count("*").alias("owned"))
    total = total.join(owners, total["owner"].eqNullSafe(owners["owner"]), "left").drop("owner")
    one = F.col("n_owners") == 1
    common = one & (F.col("n_repositories") >= COMMON_LEAST) & (F.col("n_repositories") > COMMON_SHARE * F.col("owned"))
    status = (F.when(F.col("n_owners") >= MANY_OWNERS, "copied").when(common, "common")
              .when(one & F.col("random"), "live").otherwise("unclear"))
    return total.select("hash", "n_repositories", "n_owners", status.alias("status"))


def _looks_live(value: Column) -> Column:
    return ((F.length(value) >= LIVE_LENGTH) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT))


def scanned(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: row, doc, text_hash, doc_id and ``spans``, an array of
    (start, order, kind, stop, hash, status, n_repositories, n_owners) in order."""
    rows, candidates = located(docs.select("doc_id", "text", F.col(owner).alias("owner"),
                                           F.col(repository).alias("repository")))
    status = stored(ownership(candidates, rows), "ownership")
    judged = candidates.withColumn("hash", F.sha2("value", 256)).drop("value", "owner", "repository")
    base = judged.filter("kind <> 'bare'").join(status, "hash")
    bare = judged.filter("kind = 'bare'").join(status.filter("status = 'live'"), "hash")
    covered = bare.alias("a").join(
        base.select("row", F.col("start").alias("s"), F.col("stop").alias("e")).alias("b"),
        (F.col("a.row") == F.col("b.row")) & (F.col("a.start") < F.col("b.e")) & (F.col("b.s") < F.col("a.stop")),
        "left_anti")
    span = F.struct("start", "order", "kind", "stop", "hash", "status", "n_repositories", "n_owners")
    spans = base.select("row", span.alias("span")).unionByName(covered.select("row", span.alias("span")))
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    none = F.expr("array()").cast(listed.schema["spans"].dataType)
    return rows.drop("owner", "repository").join(listed, "row", "left").withColumn("spans", F.coalesce("spans", none))


def redacted(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``docs`` with every credential replaced by MASK, but for widely copied examples: those that
    stand under many owners. How often one owner repeats a value does not save it."""
    columns = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hidden = scanned(docs, owner, repository).select(
        F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"),
        F.filter("spans", lambda s: s["status"] != "copied").alias("__spans")).filter(F.size("__spans") > 0)
    hidden = stored(hidden.dropDuplicates(["__doc", "__hash"]), "hidden")
    named = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                              "__hash": F.xxhash64(text)})
    joined = named.join(hidden, ["__doc", "__hash"], "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(done: Column, span: Column) -> Column:
        # what stands between the last span and this one, then the mask (once for overlapping spans)
        fresh = span["start"] >= done["at"]
        kept = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(span["start"] - done["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(done["at"], span["stop"]).alias("at"),
                        F.when(fresh, F.concat(done["out"], kept, F.lit(MASK))).otherwise(done["out"]).alias("out"))

    clean = F.aggregate("__spans", start, add,
                        lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.length(text))))
    out = joined.withColumn("text", F.when(F.col("__spans").isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)


def digest(docs: DataFrame) -> DataFrame:
    found = scanned(docs)
    base = F.filter("spans", lambda s: s["kind"] != "bare")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    with_status = lambda status: F.size(F.filter("spans", lambda s: s["status"] == status)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(shown(base), 256).alias("base_sha256"),
                        shown(F.col("spans")).alias("spans"), with_status("live").alias("n_live"),
                        with_status("copied").alias("n_copied"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
kinds(k, kind, pattern, least) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 20), (2, 'hex', '[0-9a-f]+', 24), (3, 'bare', '[A-Za-z0-9+/_.=-]+', 12)),
listed AS (
  SELECT r, source, doc_id, k, kind, least, regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
         regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
         string_split_regex(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS p
  FROM d, kinds WHERE k = 0
  UNION ALL SELECT r, source, doc_id, k, kind, least, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d, kinds WHERE k = 1
  UNION ALL SELECT r, source, doc_id, k, kind, least, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d, kinds WHERE k = 2
  UNION ALL SELECT r, source, doc_id, k, kind, least, regexp_extract_all(t, '[A-Za-z0-9+/_.=-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_.=-]+'), string_split_regex(t, '[A-Za-z0-9+/_.=-]+') FROM d, kinds WHERE k = 3),
each AS (SELECT r, source, doc_id, k, kind, least, unnest(m) AS m, unnest(v) AS v, unnest(p[1:len(m)]) AS p, unnest(range(len(m))) AS n
         FROM listed WHERE len(m) > 0),
span AS (SELECT *, CAST(sum(len(p) + len(m)) OVER (PARTITION BY r, k ORDER BY n) - len(m) AS BIGINT) AS a FROM each),
candidate AS (SELECT *, a + len(m) AS b FROM span WHERE len(v) >= least
              AND (k < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))),
owned AS (
  SELECT v, count(DISTINCT coalesce(source, '<none>')) AS owners, count(DISTINCT (source, doc_id)) AS repositories,
         min(coalesce(source, '<none>')) AS owner,
         bool_or(len(v) >= 12 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
                 AND len(list_distinct(string_split(v, ''))) >= 8) AS random
  FROM candidate WHERE k < 3 GROUP BY v),
held AS (SELECT coalesce(source, '<none>') AS owner, count(DISTINCT (source, doc_id)) AS all_of_it FROM d GROUP BY 1),
judged AS (SELECT c.*, CASE WHEN owners >= 3 THEN 'copied' WHEN owners = 1 AND repositories >= 3 AND 2 * repositories > all_of_it THEN 'common'
                            WHEN owners = 1 AND random THEN 'live' ELSE 'unclear' END AS status
           FROM candidate c JOIN owned USING (v) JOIN held USING (owner)),
chosen AS (
  SELECT * FROM judged WHERE k < 3
  UNION ALL SELECT * FROM judged x WHERE k = 3 AND status = 'live' AND NOT EXISTS (
    SELECT 1 FROM judged y WHERE y.r = x.r AND y.k < 3 AND x.a < y.b AND y.a < x.b)),
report AS (
  SELECT r, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex,
         string_agg(CASE WHEN k < 3 THEN kind || ':' || a || ':' || b END, ',' ORDER BY a, k) AS base,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans,
         count_if(status = 'live') AS n_live, count_if(status = 'copied') AS n_copied
  FROM chosen GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied
FROM d LEFT JOIN report USING (r)
"""
