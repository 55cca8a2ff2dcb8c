"""Exact quantiles by radix selection: histograms over the magnitude of doubles, narrowed level by level.

A level counts, in the map tasks, how many values fall into each cell of an ordered grid, with the least and
greatest value met in the cell; only these histograms are shuffled. The first grid is the signed
exponent. Every further one cuts the cell that holds a wanted rank into ``CELLS`` even pieces between its
least and greatest value, so after the exponent a level settles twelve bits of the 52 of a mantissa, and a cell that holds one
value only is done. All functions that map values to cells are monotone (a subtraction, a
division and a product by constants, each rounded), so ranks are exact whatever the rounding. NaN counts as the greatest value.

The driver holds the wanted ranks: a few for each column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096
ENDS = {float("-inf"): -5000, float("inf"): 5000}


@dataclass(frozen=True)
class Rank:
    """The value of 0-based rank ``k`` of a column, known to lie in [low, high] with ``before`` values under low."""
    column: str
    k: int
    before: int = 0
    low: float | None = None
    high: float | None = None

    @property
    def done(self) -> bool:
        return self.low is not None and (self.low == self.high or math.isnan(self.low))


def exponent_cell(x: Column) -> Column:
    """Cells in the order of the values: sign and binary exponent."""
    size = F.floor(F.log2(F.abs(x))) + 2000
    return (F.when(F.isnan(x), 6000).when(x == float("inf"), 5000).when(x == float("-inf"), -5000)
            .when(x == 0, 0).when(x > 0, size).otherwise(-size)).cast("int")


def even_cell(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(CELLS - 1), F.floor((x - F.lit(low)) / F.lit(high - low) * CELLS)).cast("int")


def values_at(df: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values of the wanted 0-based ranks of double columns (nulls left out)."""
    open_ranks = [Rank(c, k) for c, ks in wanted.items() for k in sorted(set(ks))]
    found: dict[tuple[str, int], float] = {}
    while open_ranks:
        # ranks in one interval share its histogram
        spans = sorted({(r.column, r.before, r.low, r.high) for r in open_ranks}, key=str)
        number = {s: i for i, s in enumerate(spans)}
        counted = []
        for (column, _, low, high), i in number.items():
            x = F.col(column)
            inside = x.isNotNull() if low is None else (x >= F.lit(low)) & (x <= F.lit(high))
            cell = exponent_cell(x) if low is None else even_cell(x, low, high)
            counted.append(F.when(inside, F.struct(F.lit(i).alias("span"), cell.alias("cell"), x.alias("x"))))
        cells = (df.select(F.explode(F.array_compact(F.array(*counted))).alias("c"))
                 .groupBy("c.span", "c.cell").agg(F.count("*").alias("n"), F.min("c.x").alias("low"), F.max("c.x").alias("high")))
        upto = Window.partitionBy("span").orderBy("cell")
        ranked = cells.withColumn("stop", F.sum("n").over(upto)).withColumn("start", F.col("stop") - F.col("n"))
        hit = F.lit(False)
        for r in open_ranks:
            k = r.k - r.before
            hit = hit | ((F.col("span") == number[r.column, r.before, r.low, r.high]) & (F.col("start") <= k) & (F.col("stop") > k))
        rows: dict[int, list] = {}
        for row in ranked.where(hit).collect():          # a cell at most for each wanted rank
            rows.setdefault(row["span"], []).append(row)
        after = []
        for r in open_ranks:
            k = r.k - r.before
            row = next(x for x in rows[number[r.column, r.before, r.low, r.high]] if x["start"] <= k < x["stop"])
            after.append(Rank(r.column, r.k, r.before + row["start"], row["low"], row["high"]))
        found |= {(r.column, r.k): r.low for r in after if r.done}
        open_ranks = [r for r in after if not r.done]
    return found


def exact_quantiles(df: DataFrame, counts: dict[str, int], probs: tuple[float, ...]) -> dict[tuple[str, float], float | None]:
    """Linear-interpolation quantiles of double columns; ``counts`` are their non-null values."""
    places = {(c, q): (n - 1) * q for c, n in counts.items() if n for q in probs}
    wanted: dict[str, list[int]] = {}
    for (c, _), h in places.items():
        wanted.setdefault(c, []).extend((math.floor(h), math.ceil(h)))
    value = values_at(df, wanted) if wanted else {}
    out: dict[tuple[str, float], float | None] = {(c, q): None for c in counts for q in probs}
    for (c, q), h in places.items():
        low, high = value[c, math.floor(h)], value[c, math.ceil(h)]
        out[c, q] = low + (h - math.floor(h)) * (high - low)
    return out
