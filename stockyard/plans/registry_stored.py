"""Registered queries of the stored and incremental forms: refreshed views, segmented windows, key index,
vector store and index, and the tool, parameter and flow surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockyard.plans import analysis as A
from stockyard.plans.registry import APPROXIMATE, FIRST_DAY, ONE_SYMBOL, ONE_YEAR, _batches, _row_queries, register, star
from stockyard.session import scratch_path

# Ends of the loads that the refreshed views take the history in: years, half a year, one day, the rest.
LOADS = ["1994-12-31", "1997-06-30", "1997-12-31", "1998-01-02", "2100-01-01"]
SEGMENT = 128                # rows of a segment in the segmented views: a stock has some hundreds


def _refreshed(spark, sf_dir, names):
    from stockyard.operators.retrieval import _kept
    from stockyard.plans.refresh import RefreshedViews
    from stockyard.sources.star import INDEX_MEMBERS
    s = star(spark, sf_dir)
    bars = _kept(s.daily_bars().select("StockKey", "Date", "Close", "Volume"), "bars")
    views = RefreshedViews(spark, scratch_path(spark, "refreshed"), s.dim_company, INDEX_MEMBERS, names)
    after = "0001-01-01"
    for end in LOADS:
        views.refresh(bars.where((F.col("Date") > F.lit(after).cast("date")) & (F.col("Date") <= F.lit(end).cast("date"))), end)
        after = end
    return views


@register("movement_refreshed")
def movement_refreshed(spark, sf_dir):
    """V-MV after five loads, each from its batch and the state before it."""
    return _refreshed(spark, sf_dir, ["movement"]).view("movement").drop("StockKey")


@register("performance_refreshed")
def performance_refreshed(spark, sf_dir):
    return _refreshed(spark, sf_dir, ["performance"]).view("performance").drop("StockKey")


@register("refresh_state")
def refresh_state(spark, sf_dir):
    """The state after all loads, against one computed from the whole history."""
    last = F.element_at("Tail", -1)
    return _refreshed(spark, sf_dir, []).state().select(
        "StockKey", "Year", "YearOpen", F.size("Tail").alias("TailRows"), last["Date"].alias("LastDate"),
        last["Close"].alias("LastClose"), F.element_at("Tail", 1)["Date"].alias("TailFrom"))


@register("movement_segmented")
def movement_segmented(spark, sf_dir):
    """V-MV with every stock's history cut into segments."""
    from stockyard.plans.long_history import movement
    return movement(star(spark, sf_dir), SEGMENT)


@register("performance_segmented")
def performance_segmented(spark, sf_dir):
    from stockyard.plans.long_history import performance
    return performance(star(spark, sf_dir), SEGMENT)


# ---- key index ---------------------------------------------------------------
@register("insert_rows_indexed")
def insert_rows_indexed(spark, sf_dir):
    """K2 against the stored key index of the loaded fact."""
    from stockyard.operators.key_index import key_index, rows_to_insert
    from stockyard.operators.retrieval import _kept
    old, new = _batches(star(spark, sf_dir))
    return rows_to_insert(_kept(key_index(old), "key_index"), new)


@register("strict_conflicts_indexed")
def strict_conflicts_indexed(spark, sf_dir):
    """K3 against an index that is merged from two loads'."""
    from stockyard.operators.key_index import key_conflicts, key_index, merged
    from stockyard.operators.retrieval import _kept
    old, new = _batches(star(spark, sf_dir))
    first = key_index(old.where(F.col("StockKey") % 2 == 0))
    return key_conflicts(_kept(merged(first, key_index(old.where(F.col("StockKey") % 2 != 0))), "key_index"), new)


@register("pk_duplicates_indexed")
def pk_duplicates_indexed(spark, sf_dir):
    """Q3 by counts: the fact with rows of some days repeated."""
    from stockyard.operators.key_index import duplicates
    f = star(spark, sf_dir).fact_price.select("TimeKey", "StockKey")
    copies = F.when(F.col("TimeKey") % 50 != 3, 1).when(F.col("StockKey") % 3 == 0, 3).otherwise(2)
    return duplicates(f.select("*", F.explode(F.array_repeat(F.lit(1), copies)).alias("_")).drop("_"))


# ---- stored vectors ------------------------------------------------------------
@register("vector_store_topk")
def vector_store_topk(spark, sf_dir):
    """Chunks stored by symbol, some documents stored again, and every row with a number divisible by 20
    searched among its own symbol's chunks."""
    from stockyard.operators.vector_store import VectorStore
    s = star(spark, sf_dir)
    texts = s.table("documents").select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 40).alias("text"))
    chunks = s.table("embeddings").join(texts, "vec_id", "left").select(
        F.concat(F.lit("S"), F.col("label")).alias("symbol"), F.expr("vec_id DIV 4").alias("doc_id"),
        (F.col("vec_id") % 4).cast("int").alias("chunk_id"), "text", "embedding")
    store = VectorStore(spark, scratch_path(spark, "vector_store"))
    store.replace(chunks)
    store.replace(chunks.where("doc_id % 3 = 0 AND chunk_id < 2").withColumns(
        {"embedding": F.reverse("embedding"), "text": F.lit("new")}))
    number = F.col("doc_id") * 4 + F.col("chunk_id")
    return store.topk(store.rows().where(number % 20 == 0).withColumn("query_id", number), k=10)


def ivfpq_topk_rows(spark, sf_dir):
    """V2 by the trained index, for every row with an id divisible by 20; tests hold its recall at 0.9."""
    from stockyard.operators.vector_index import VectorIndex
    s = star(spark, sf_dir)
    index = VectorIndex.build(s.table("embeddings"), scratch_path(spark, "vector_index"))
    return index.topk(_row_queries(s), k=10).withColumnRenamed("vec_id", "VecId")


APPROXIMATE["ivfpq_topk_rows"] = ivfpq_topk_rows


# ---- surfaces ------------------------------------------------------------------
@register("bound_parameter_read")
def bound_parameter_read(spark, sf_dir):
    """A registered view read with bound parameters."""
    from stockyard.plans.sql_views import query_view, register_views
    register_views(spark, star(spark, sf_dir))
    return query_view(spark, "vw_StockPriceSummary", {"StockSymbol": ONE_SYMBOL, "Year": ONE_YEAR})


@register("tool_price_summary")
def tool_price_summary(spark, sf_dir):
    """API5: the tool surface's price summary."""
    return A.Warehouse(star(spark, sf_dir)).analyze_stock_price_summary(ONE_SYMBOL, ONE_YEAR, 2).drop("StockKey")


@register("tool_index_performance")
def tool_index_performance(spark, sf_dir):
    return A.Warehouse(star(spark, sf_dir)).analyze_vn30_performance(top_n=5, period="quarter")


@register("quarterly_flow_state")
def quarterly_flow_state(spark, sf_dir):
    """L9 with its gate: dimensions first, then prices, then ratios; run twice."""
    from stockyard.operators.retrieval import _kept
    from stockyard.plans.flows import StoredWarehouse, daily_flow, quarterly_flow
    s = star(spark, sf_dir)
    wh = StoredWarehouse(spark, scratch_path(spark, "warehouse"))
    # a feed is an input of several runs: it is derived from the trades once
    feeds = (_kept(s.ratio_wide(), "ratios"), *s.company_feeds(), s.definition_feed())
    quarterly_flow(wh, *feeds)
    daily_flow(wh, s.staging_quotes(), start=FIRST_DAY)
    quarterly_flow(wh, *feeds)
    quarterly_flow(wh, *feeds)
    return (wh.fact_ratio.join(wh.dim_company.select("StockKey", "StockSymbol"), "StockKey")
            .join(wh.dim_ratio.select("RatioKey", "RatioName"), "RatioKey").select("TimeKey", "StockSymbol", "RatioName", "Value"))


@register("schema_downgraded")
def schema_downgraded(spark, sf_dir):
    """E5: the rating widened to decimal(5,2) and taken back to decimal(3,2), unless a rating needs the wider type."""
    from stockyard.operators.evolve import change_decimal, narrowed
    wide = change_decimal(star(spark, sf_dir).dim_company, "StockRating", 5, 2)
    return narrowed(wide, "StockRating", 3, 2).select("StockKey", "StockSymbol", F.col("StockRating").cast("double"))
