"""Sharding by balanced label propagation (DataFrame functions only).

Documents are linked through hubs: a hub joins all documents that have the same
value (here: equal texts), so a group of n documents has n links, not n * n. A document
may have several hubs. Every document starts in a hashed shard.

Start: documents that reach each other through hubs form a block. In each round a block
without a place calls, among the shards with room for all of it, for the one that most of
its documents are in (empty shards included; ties by a hash of block and shard, so that
equal calls spread). A shard admits blocks as a whole, large ones first, as far as its quota
reaches; refused blocks call again, for shards that still have room. A block larger than any
room is dealt over the roomiest shards in turn. Every round places a block at least.

Propagation: blocks that were dealt out are cut, and only they are gone over. Each round counts
every hub's documents by their present shards, and each unit calls for the shard with the most
neighbours (the sum over its hubs). A unit is the documents of one hub alone that share a shard,
for they are interchangeable, or a single document with several hubs. In every second round only
half of the units, by a hash of unit and round, may move, so that neighbours do not change places
for ever. Calls are granted greatest gain first, as far as room and the places that others leave
reach, swaps and longer cycles of shards included. Rounds go on while the number of cut pairs
falls; a round that does not lower it is undone, and ``PATIENCE`` such rounds end the propagation.

A last step makes the counts exact: shards above their quota give up unlinked rows, whose
move cuts nothing, to the shards below, and linked ones only where these do not suffice.

Law: ``rows``. With n rows and k shards, n mod k shards hold one row more than
the others. Ranks within a shard are taken in buckets with prefix offsets, so no
task sees a whole shard; a group that holds a third of all rows is counted
by (hub, shard) before it is shuffled, and joins split off the keys with the most rows
(``by_key``), of which there are at most ``HOT_KEYS`` by construction.

Defined results: a null text has no bytes (size 8, crc 0) and is linked with
nothing; empty texts are equal texts; each row is placed, so repeated rows and
null ids get places of their own; a link given twice counts once; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.llm.common import stored
from stockyard.llm.graph import components

SHARDS = 24
PATIENCE = 4                 # rounds in a row that do not lower the cut
HOT_LEAST, HOT_KEYS = 1_000, 10_000
BUCKET_ROWS = 100_000        # rows that one window partition ranks, about


def ranked(df: DataFrame, by: str, first: str, key: str, buckets: int, name: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``name``: 0-based rank within ``by`` (or the sum of ``weight`` before the
    row), rows with the smaller ``first`` before the others, then in order of hash buckets of ``key``."""
    each = F.col(weight) if weight else F.lit(1).cast("long")
    spread = df.withColumn("__b", F.col(first).cast("long") * buckets + F.pmod(F.xxhash64(key), F.lit(buckets)))
    counts = spread.groupBy(by, "__b").agg(F.sum(each).alias("__n"))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    within = Window.partitionBy(by, "__b").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (spread.withColumn("__r", F.sum(each).over(within) - each).join(offsets, [by, "__b"])
            .withColumn(name, F.col("__r") + F.col("__at")).drop("__b", "__r", "__at"))


def by_key(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row for each ``key``, of ``weight`` rows among ``total``).
    Keys above the bound are fewer than ``HOT_KEYS``: they are broadcast, so that their rows stay
    where they are; the others are shuffled."""
    bound = max(HOT_LEAST, total // HOT_KEYS)
    hot = F.broadcast(table.filter(F.col(weight) > bound))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.filter(F.col(weight) <= bound), key, how)
    return rows.join(hot, key).unionByName(rest)


def hashed_start(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(shards)).cast("int"))


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def split(big: list, rooms: list[int]) -> list[tuple]:
    """(hub, shard, from, upto) for hubs that fit no room: each calls the roomiest shards
    in turn, until all its documents have a place. ``rooms`` is brought up to date."""
    takes = []
    for hub, size in big:
        at = 0
        while at < size:
            shard = max(range(len(rooms)), key=lambda s: (rooms[s], -s))
            take = min(size - at, rooms[shard])
            takes.append((hub, shard, at, at + take))
            rooms[shard] -= take
            at += take
    return takes


def called(hubs: DataFrame, rooms: list[int], buckets: int) -> DataFrame:
    """One round on (hub, size, votes): with ``goal``, the fitting shard that most of the
    hub's documents are in, and ``admitted``, whether the hub is let in as a whole."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(len(rooms) - 1)),
                    lambda s: F.element_at(F.lit(rooms), s + 1) >= F.col("size"))
    best = F.array_max(F.transform(fits, lambda s: F.struct(
        F.coalesce(F.try_element_at("votes", s), F.lit(0)).alias("n"), F.xxhash64("hub", s).alias("h"), s.alias("shard"))))
    goals = hubs.withColumn("goal", best["shard"]).withColumn("small", -F.floor(F.log2("size")))   # large hubs first
    order = ranked(goals, "goal", "small", "hub", buckets, "ahead", "size")
    return order.withColumn("admitted", F.col("ahead") + F.col("size") <= F.element_at(F.lit(rooms), F.col("goal") + 1)).select(
        "hub", "size", "votes", "goal", "admitted")


def started(rows: DataFrame, shards: int, n: int, buckets: int) -> tuple[DataFrame, list[int]]:
    """(row, hub, shard) after rounds on (row, hub, shard), as many as it takes to give each
    linked row a place, and the blocks that no shard took whole (no more of them than shards);
    ``hub`` is the row's block, null for an unlinked row. Unlinked rows can leave later without a
    cut, so linked ones alone use up the quotas."""
    spark, linked = rows.sparkSession, rows.filter("hub is not null")
    hubs = stored(linked.groupBy("hub", "shard").agg(F.count("*").alias("n")).groupBy("hub").agg(
        F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("votes")), "hubs")
    rooms, whole, takes = quotas(n, shards), [], []
    while largest := hubs.agg(F.max("size")).first()[0]:
        if largest > max(rooms):
            # all of them together have room, so these are fewer than the shards
            big = hubs.filter(F.col("size") > max(rooms))
            limit = max(rooms)
            takes += split(big.orderBy(F.desc("size"), "hub").select("hub", "size").collect(), rooms)
            hubs = hubs.filter(F.col("size") <= limit)
            continue
        turn = stored(called(hubs, rooms, buckets), "calls")
        for shard, size in turn.filter("admitted").groupBy("goal").agg(F.sum("size")).collect():
            rooms[shard] -= size
        whole.append(turn.filter("admitted").select("hub", "size", "goal"))
        hubs = turn.filter("not admitted").select("hub", "size", "votes")
    out = rows.filter("hub is null").select("row", "hub", "shard")
    if whole:
        goals = reduce(DataFrame.unionByName, whole)
        out = out.unionByName(by_key(linked.drop("shard"), goals, "hub", "size", n).select(
            "row", "hub", F.col("goal").alias("shard")))
    if takes:
        # each of these hubs used up a room, so there are no more of them than shards
        parts = F.broadcast(spark.createDataFrame(takes, T.StructType([
            rows.schema["hub"], T.StructField("shard", T.IntegerType()), T.StructField("from", T.LongType()),
            T.StructField("upto", T.LongType())])))
        apart = linked.drop("shard").join(parts.select("hub").distinct(), "hub", "left_semi").withColumn("late", F.lit(0))
        placed_at = ranked(apart, "hub", "late", "row", buckets * shards, "at").join(parts, "hub").filter(
            "at >= from and at < upto")
        out = out.unionByName(placed_at.select("row", "hub", "shard"))
    return out, sorted({t[0] for t in takes})


def blocks(links: DataFrame) -> DataFrame:
    """(row, hubs, hub): each linked row with its sorted hubs and, as ``hub``, the least hub that
    it reaches through rows of several hubs."""
    rows = stored(links.groupBy("row").agg(F.sort_array(F.collect_set("hub")).alias("hubs")), "hubs")
    several = rows.filter(F.size("hubs") > 1)
    if several.isEmpty():
        return rows.withColumn("hub", F.col("hubs")[0])
    ties = several.select(F.col("hubs")[0].alias("a"), F.explode(F.slice("hubs", 2, F.size("hubs"))).alias("b"))
    reached = components(ties, "blocks").groupBy("node").agg(F.min("component").alias("block"))
    sizes = rows.groupBy(F.col("hubs")[0].alias("node")).agg(F.count("*").alias("weight"))
    named = by_key(rows.withColumn("node", F.col("hubs")[0]), sizes.join(reached, "node", "left"), "node", "weight",
                   rows.count())
    return named.select("row", "hubs", F.coalesce("block", "node").alias("hub"))


def votes_of(units: DataFrame, links: DataFrame) -> DataFrame:
    """(hub, kinds, votes, pairs): for each hub the rows by shard, the units' kinds and the pairs
    of rows that are in different shards."""
    counts = units.join(links, "kind").groupBy("hub", "shard").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    n = F.col("n").cast("double")
    return counts.groupBy("hub").agg(
        F.sum("kinds").alias("kinds"), F.collect_list(F.struct("shard", "n")).alias("votes"),
        ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).alias("pairs"))


def calls(units: DataFrame, links: DataFrame, votes: DataFrame, total: int, turn: int) -> DataFrame:
    """(kind, first, shard, n, goal, gain) of the units that take part in this round and have more
    neighbours in another shard than in their own."""
    part = F.lit(turn % 2 == 1) | (F.pmod(F.xxhash64("kind", "first", F.lit(turn)), F.lit(2)) == 0)
    near = by_key(links, votes.select("hub", "kinds", "votes"), "hub", "kinds", total)
    scores = near.select("kind", F.explode("votes").alias("v")).groupBy("kind", F.col("v.shard").alias("goal")).agg(
        F.sum("v.n").alias("score"), F.count("*").alias("hubs"))
    asked = units.filter(part).join(scores, "kind")
    own = F.max(F.when(F.col("goal") == F.col("shard"), F.col("score") - F.col("hubs") * F.col("n")))
    best = F.max(F.when(F.col("goal") != F.col("shard"),
                        F.struct("score", F.xxhash64("kind", "goal").alias("h"), F.col("goal").alias("to"))))
    gains = asked.groupBy("kind", "first", "shard", "n").agg(own.alias("own"), best.alias("best"))
    return gains.select("kind", "first", "shard", "n", F.col("best.to").alias("goal"),
                        (F.col("best.score") - F.col("own")).alias("gain")).filter("gain > 0")


def overfull(flows: dict[tuple[int, int], int], rooms: list[int]) -> dict[int, int]:
    """Shards that would get more rows than they lose and have room for, with the excess."""
    over = {}
    for b in {b for _, b in flows}:
        excess = sum(n for (_, y), n in flows.items() if y == b) - sum(
            n for (x, _), n in flows.items() if x == b) - max(0, rooms[b])
        if excess > 0:
            over[b] = excess
    return over


def grants(wanted: dict[tuple[int, int], int], rooms: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may go from one shard to another so that none gets too many: calls into an overfull
    shard are cut back, small ones first; if that does not settle, calls both ways are matched."""
    given = dict(wanted)
    for _ in range(len(rooms) ** 2):
        over = overfull(given, rooms)
        if not over:
            return {k: v for k, v in given.items() if v}
        b = min(over)
        for v, way in sorted((v, k) for k, v in given.items() if k[1] == b):
            less = min(v, over[b])
            given[way] -= less
            over[b] -= less
    return {(a, b): min(v, given.get((b, a), 0)) for (a, b), v in given.items() if min(v, given.get((b, a), 0))}


def propagated(rows: DataFrame, shards: int, rooms: list[int], buckets: int) -> DataFrame:
    """(row, hub, shard) of the rows (row, hubs, hub, shard) after propagation; ``rooms``: what the
    linked rows leave free of each quota. Only units, not rows, are gone over in the rounds."""
    spark = rows.sparkSession
    kind = F.when(F.size("hubs") == 1, F.concat(F.lit("h"), F.col("hubs")[0])).otherwise(F.concat(F.lit("r"), F.col("row")))
    rows = rows.withColumn("kind", kind)
    links = stored(rows.groupBy("kind").agg(F.first("hubs").alias("hubs")).select(
        "kind", F.explode("hubs").alias("hub")), "links")
    units = stored(rows.groupBy("kind", F.col("shard").alias("first")).agg(F.count("*").alias("n")).withColumn(
        "shard", F.col("first")), "units")
    total = links.count()
    votes = stored(votes_of(units, links), "votes")
    cut, turn, idle = votes.agg(F.sum("pairs")).first()[0], 0, 0
    while cut and idle < PATIENCE:
        turn += 1
        idle += 1
        asked = calls(units, links, votes, total, turn)
        order = stored(ranked(
            asked.withColumns({"way": F.col("shard") * shards + F.col("goal"), "late": -F.floor(F.log2("gain")),
                               "unit": F.concat("kind", F.lit("/"), "first")}),
            "way", "late", "unit", buckets, "ahead", "n"), "calls")

        def flows(frame):                   # at most shards * shards rows
            return {(r[0], r[1]): r[2] for r in frame.groupBy("shard", "goal").agg(F.sum("n")).collect()}

        # units go as a whole, so fewer rows may go than were granted: grant again until what goes fits
        moves, going = order, flows(order)
        while overfull(going, rooms):
            limits = spark.createDataFrame([(*k, v) for k, v in grants(going, rooms).items()],
                                           "shard int, goal int, given long")
            moves = order.join(F.broadcast(limits), ["shard", "goal"]).filter("ahead + n <= given")
            going = flows(moves)
        if not going:
            continue
        tried = stored(units.join(moves.select("kind", "first", "goal"), ["kind", "first"], "left").select(
            "kind", "first", "n", F.coalesce("goal", "shard").alias("shard")), "units")
        after = stored(votes_of(tried, links), "votes")
        now = after.agg(F.sum("pairs")).first()[0]
        if now < cut:
            units, votes, cut, idle = tried, after, now, 0
            for (a, b), moved in going.items():
                rooms[a] += moved
                rooms[b] -= moved
    changed = units.filter("first <> shard").select(
        F.concat("kind", F.lit("/"), "first").alias("unit"), F.col("shard").alias("to"), "n")
    out = by_key(rows.withColumn("unit", F.concat("kind", F.lit("/"), "shard")), changed, "unit", "n", total, "left")
    return out.select("row", "hub", F.coalesce("to", "shard").alias("shard"))


def levelled(rows: DataFrame, shards: int, n: int, buckets: int) -> DataFrame:
    """Move the fewest rows, unlinked ones first, so that counts are at most one apart."""
    spark = rows.sparkSession
    quota = F.lit(n // shards) + (F.col("shard") < n % shards).cast("int")
    sizes = rows.groupBy("shard").agg(F.count("*").alias("size"))
    # one row for each shard: windows and broadcasts below are bounded by `shards`
    every = (spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(sizes), "shard", "left")
             .select("shard", (F.coalesce("size", F.lit(0)) - quota).alias("over")))
    excess = every.select("shard", F.greatest("over", F.lit(0)).alias("excess"))
    spare = rows.withColumn("linked", F.col("hub").isNotNull())
    order = ranked(spare, "shard", "linked", "row", buckets, "rank")
    moved = order.join(F.broadcast(excess), "shard").filter("rank < excess")
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    from_at = excess.select("shard", F.coalesce(F.sum("excess").over(upto), F.lit(0)).alias("from_at"))
    gaps = every.filter("over < 0").select(F.col("shard").alias("to"), (-F.col("over")).alias("gap"))
    ahead = Window.orderBy("to").rowsBetween(Window.unboundedPreceding, -1)
    gaps = gaps.select("to", F.coalesce(F.sum("gap").over(ahead), F.lit(0)).alias("gap_at"), "gap")
    place = moved.join(F.broadcast(from_at), "shard").select("row", (F.col("from_at") + F.col("rank")).alias("place"))
    moves = place.join(F.broadcast(gaps), (F.col("place") >= F.col("gap_at"))
                       & (F.col("place") < F.col("gap_at") + F.col("gap"))).select("row", "to")
    return rows.join(moves, "row", "left").select("row", "hub", F.coalesce("to", "shard").alias("shard"))


def placed(links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(row, hub, shard, slot), once for each row, of (row, hub) links: ``row`` a long, ``hub`` a long
    that links rows (null: none). A row with several hubs comes several times, and its ``hub`` in
    the result is the least that its block reaches."""
    every = stored(links.select("row", "hub"), "links")
    known = stored(blocks(every.filter("hub is not null")), "blocks")
    table = stored(hashed_start(every.select("row").distinct().join(known.select("row", "hub"), "row", "left"), shards)
                   .select("row", "hub", "shard"), "shards")
    n = table.count()
    if not n:
        return table.withColumn("slot", F.lit(0).cast("long"))
    buckets = max(4, -(-n // shards // BUCKET_ROWS))
    table, cut = started(table, shards, n, buckets)
    table = stored(table, "shards")
    if cut:
        held = {r[0]: r[1] for r in table.filter("hub is not null").groupBy("shard").count().collect()}
        rooms = [q - held.get(s, 0) for s, q in enumerate(quotas(n, shards))]
        apart = F.col("hub").isin(cut)
        loose = known.filter(apart).join(table.filter(apart).select("row", "shard"), "row")
        table = stored(table.filter(~F.coalesce(apart, F.lit(False))).unionByName(
            propagated(stored(loose, "loose"), shards, rooms, buckets)), "shards")
    table = stored(levelled(table, shards, n, buckets), "shards")
    return ranked(table.withColumn("late", F.lit(0)), "shard", "late", "row", buckets, "slot").drop("late")


def cut_links(places: DataFrame, links: DataFrame) -> DataFrame:
    """(n_links, n_cut, pairs): links, links whose document stands outside its hub's main shard,
    and pairs of documents of one hub in different shards."""
    at = links.filter("hub is not null").distinct().join(places.select("row", "shard"), "row")
    n = F.col("n").cast("double")
    votes = at.groupBy("hub", "shard").agg(F.count("*").alias("n"))
    return votes.groupBy("hub").agg(
        F.sum("n").alias("total"), F.max("n").alias("most"),
        ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).alias("pairs")).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("n_links"),
        F.coalesce(F.sum(F.col("total") - F.col("most")), F.lit(0)).alias("n_cut"),
        F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs"))


def linked_by_text(docs: DataFrame) -> DataFrame:
    """(row, doc_id, size, text_crc32, hub): equal texts share a hub."""
    text = F.col("text").cast("string")
    described = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.sha2(text, 256)).alias("hash")), "texts")
    shared = described.filter("hash is not null").groupBy("hash").agg(
        F.count("*").alias("n"), F.min("row").alias("hub")).filter("n > 1")
    return by_key(described, shared, "hash", "n", described.count(), "left").select("row", "doc_id", "size", "text_crc32", "hub")


def digest(docs: DataFrame) -> DataFrame:
    rows = stored(linked_by_text(docs), "rows")
    places = placed(rows.select("row", "hub"))
    return rows.drop("hub").join(places.select("row", "shard", "slot", "hub"), "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("hub").alias("group_row"))
