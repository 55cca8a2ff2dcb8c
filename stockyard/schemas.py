"""Warehouse and staging schemas, keys and column limits."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- staging (feed) schemas ------------------------------------------------

QUOTE_SCHEMA = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("MaCK", T.StringType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

# The vendor's quote export, before renaming (one file for each symbol).
VENDOR_QUOTE_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("openPrice", T.DoubleType()),
    T.StructField("highPrice", T.DoubleType()),
    T.StructField("lowPrice", T.DoubleType()),
    T.StructField("closePrice", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

OVERVIEW_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("short_name", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("company_type", T.StringType()),
    T.StructField("stock_rating", T.DoubleType()),
    T.StructField("exchange", T.StringType()),
    T.StructField("industry_id", T.IntegerType()),
    T.StructField("website", T.StringType()),
])

PROFILE_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("company_name", T.StringType()),
    T.StructField("history_dev", T.StringType()),
    T.StructField("company_profile", T.StringType()),
])

DEFINITION_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("order", T.StringType()),
    T.StructField("com_type_code", T.StringType()),
])

# ---- warehouse tables ------------------------------------------------------

DIM_TIME = T.StructType([
    T.StructField("TimeKey", T.IntegerType(), False),
    T.StructField("Date", T.DateType()),
    T.StructField("Year", T.IntegerType()),
    T.StructField("Quarter", T.IntegerType()),
    T.StructField("Month", T.IntegerType()),
    T.StructField("Week", T.IntegerType()),
    T.StructField("Day", T.IntegerType()),
])

DIM_COMPANY = T.StructType([
    T.StructField("StockKey", T.IntegerType(), False),
    T.StructField("StockSymbol", T.StringType()),
    T.StructField("CompanyName", T.StringType()),
    T.StructField("ShortName", T.StringType()),
    T.StructField("Industry", T.StringType()),
    T.StructField("CompanyType", T.StringType()),
    T.StructField("StockRating", T.DecimalType(5, 2)),
])

DIM_RATIO = T.StructType([
    T.StructField("RatioKey", T.IntegerType(), False),
    T.StructField("RatioName", T.StringType()),
    T.StructField("Unit", T.StringType()),
    T.StructField("RatioType", T.StringType()),
])

FACT_STOCK_PRICE = T.StructType([
    T.StructField("TimeKey", T.IntegerType(), False),
    T.StructField("StockKey", T.IntegerType(), False),
    T.StructField("Open", T.DecimalType(10, 4)),
    T.StructField("High", T.DecimalType(10, 4)),
    T.StructField("Low", T.DecimalType(10, 4)),
    T.StructField("Close", T.DecimalType(10, 4)),
    T.StructField("Volume", T.LongType()),
])

FACT_FINANCIAL_RATIOS = T.StructType([
    T.StructField("TimeKey", T.IntegerType(), False),
    T.StructField("StockKey", T.IntegerType(), False),
    T.StructField("RatioKey", T.IntegerType(), False),
    T.StructField("Value", T.DecimalType(20, 4)),
])

TABLES = {
    "Dim_Time": DIM_TIME,
    "Dim_Company": DIM_COMPANY,
    "Dim_Ratio": DIM_RATIO,
    "Fact_StockPrice": FACT_STOCK_PRICE,
    "Fact_FinancialRatios": FACT_FINANCIAL_RATIOS,
}

PRIMARY_KEYS = {
    "Dim_Time": ["TimeKey"],
    "Dim_Company": ["StockKey"],
    "Dim_Ratio": ["RatioKey"],
    "Fact_StockPrice": ["TimeKey", "StockKey"],
    "Fact_FinancialRatios": ["TimeKey", "StockKey", "RatioKey"],
}

NATURAL_KEYS = {"Dim_Company": ["StockSymbol"], "Dim_Ratio": ["RatioName"]}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("Fact_FinancialRatios", "TimeKey", "Dim_Time", "TimeKey"),
    ("Fact_FinancialRatios", "StockKey", "Dim_Company", "StockKey"),
    ("Fact_FinancialRatios", "RatioKey", "Dim_Ratio", "RatioKey"),
    ("Fact_StockPrice", "TimeKey", "Dim_Time", "TimeKey"),
    ("Fact_StockPrice", "StockKey", "Dim_Company", "StockKey"),
]

# Declared varchar lengths (the warehouse DDL's limits).
VARCHAR_LIMITS = {
    "Dim_Company": {"StockSymbol": 10, "CompanyName": 100, "ShortName": 50,
                    "Industry": 30, "CompanyType": 10},
    "Dim_Ratio": {"RatioName": 50, "Unit": 20, "RatioType": 50},
}

# Declared decimal types whose range a value must fit.
DECIMAL_LIMITS = {
    "Dim_Company": {"StockRating": (5, 2)},
    "Fact_StockPrice": {"Open": (10, 4), "High": (10, 4), "Low": (10, 4), "Close": (10, 4)},
    "Fact_FinancialRatios": {"Value": (20, 4)},
}


def ddl(table: str, limits: bool = True) -> str:
    """Column list for CREATE TABLE, with varchar(n) where a limit is declared."""
    cols = []
    lim = VARCHAR_LIMITS.get(table, {}) if limits else {}
    for f in TABLES[table].fields:
        typ = f"varchar({lim[f.name]})" if f.name in lim else f.dataType.simpleString()
        cols.append(f"`{f.name}` {typ}{'' if f.nullable else ' NOT NULL'}")
    return ", ".join(cols)
