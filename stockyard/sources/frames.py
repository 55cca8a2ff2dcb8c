"""A star made of given DataFrames (hand fixtures, or tables already in memory)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class FrameStar:
    fact_price: DataFrame
    dim_time: DataFrame
    dim_company: DataFrame
    fact_ratio: DataFrame | None = None
    dim_ratio: DataFrame | None = None
    company_small: bool = True
    index_keys: list[int] | None = None

    def index_fact_price(self) -> DataFrame:
        if self.index_keys is None:
            return self.fact_price
        return self.fact_price.where(F.col("StockKey").isin(self.index_keys))
