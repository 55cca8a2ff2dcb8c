"""Ratio and column names, and the name normalisation rules.

The lists below are fixed values: they must equal the source feed's names
for the warehouse to resolve keys, so they are stated as they appear there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (feed vocabulary).
# ---------------------------------------------------------------------------

# The 34 ratio names kept from the ratio-definition feed, in feed order.
RATIO_NAMES = [
    "Nợ/VCSH", "TSCĐ / Vốn CSH", "Vốn CSH/Vốn điều lệ",
    "Biên lợi nhuận ròng (%)", "ROE (%)", "ROIC (%)", "ROA (%)", "Tỷ suất cổ tức (%)",
    "Đòn bẩy tài chính", "Vốn hóa (Tỷ đồng)", "Số CP lưu hành (Triệu CP)",
    "P/E", "P/B", "P/S", "P/Cash Flow", "EPS (VND)", "BVPS (VND)",
    "(Vay NH+DH)/VCSH", "Vòng quay tài sản", "Vòng quay TSCĐ",
    "Số ngày thu tiền bình quân", "Số ngày tồn kho bình quân",
    "Số ngày thanh toán bình quân", "Chu kỳ tiền", "Vòng quay hàng tồn kho",
    "Biên EBIT (%)", "Biên lợi nhuận gộp (%)", "EBITDA (Tỷ đồng)", "EBIT (Tỷ đồng)",
    "Chỉ số thanh toán hiện thời", "Chỉ số thanh toán tiền mặt",
    "Chỉ số thanh toán nhanh", "Khả năng chi trả lãi vay", "EV/EBITDA",
]

# Rename of the wide ratio feed's columns to warehouse ratio names.
RATIO_COLUMN_RENAME = {
    "CP": "StockSymbol",
    "Nợ/VCSH": "Nợ/VCSH",
    "TSCĐ / Vốn CSH": "TSCĐ/Vốn CSH",
    "Vốn CSH/Vốn điều lệ": "Vốn CSH/Vốn điều lệ",
    "Biên lợi nhuận ròng (%)": "Biên lợi nhuận ròng",
    "ROE (%)": "ROE",
    "ROIC (%)": "ROIC",
    "ROA (%)": "ROA",
    "Tỷ suất cổ tức (%)": "Tỷ suất cổ tức",
    "Đòn bẩy tài chính": "Đòn bẩy tài chính",
    "Vốn hóa (Tỷ đồng)": "Vốn hóa",
    "Số CP lưu hành (Triệu CP)": "Số CP lưu hành",
    "P/E": "P/E",
    "P/B": "P/B",
    "P/S": "P/S",
    "P/Cash Flow": "P/Cash Flow",
    "EPS (VND)": "EPS",
    "BVPS (VND)": "BVPS",
    "(Vay NH+DH)/VCSH": "(Vay NH+DH)/VCSH",
    "Vòng quay tài sản": "Vòng quay tài sản",
    "Vòng quay TSCĐ": "Vòng quay TSCĐ",
    "Số ngày thu tiền bình quân": "Số ngày thu tiền bình quân",
    "Số ngày tồn kho bình quân": "Số ngày tồn kho bình quân",
    "Số ngày thanh toán bình quân": "Số ngày thanh toán bình quân",
    "Chu kỳ tiền": "Chu kỳ tiền",
    "Vòng quay hàng tồn kho": "Vòng quay hàng tồn kho",
    "Biên EBIT (%)": "Biên EBIT",
    "Biên lợi nhuận gộp (%)": "Biên lợi nhuận gộp",
    "EBITDA (Tỷ đồng)": "EBITDA",
    "EBIT (Tỷ đồng)": "EBIT",
    "Chỉ số thanh toán hiện thời": "Chỉ số thanh toán hiện thời",
    "Chỉ số thanh toán tiền mặt": "Chỉ số thanh toán tiền mặt",
    "Chỉ số thanh toán nhanh": "Chỉ số thanh toán nhanh",
    "Khả năng chi trả lãi vay": "Khả năng chi trả lãi vay",
    "EV/EBITDA": "EV/EBITDA",
}

# Company feed rename (overview + profile merged) to warehouse names.
COMPANY_RENAME = {
    "symbol": "StockSymbol", "company_name": "CompanyName", "industry": "Industry",
    "company_type": "CompanyType", "stock_rating": "StockRating", "short_name": "ShortName",
}

# Definition feed rename.
DEFINITION_RENAME = {"name": "RatioName", "type": "RatioType", "unit": "Unit"}

# Columns dropped from the company profile and overview feeds (absent ones ignored).
PROFILE_DROP = ["history_dev", "company_promise", "key_developments",
                "business_risk", "company_profile", "business_strategies"]
OVERVIEW_DROP = ["exchange", "no_shareholders", "foreign_percent",
                 "outstanding_share", "issue_share", "established_year",
                 "no_employees", "delta_in_week", "delta_in_month",
                 "delta_in_year", "website", "industry_id", "industry_id_v2"]

# Definition feed columns dropped before building the ratio dimension.
DEFINITION_DROP = ["order", "com_type_code"]

# Index membership list (30 symbols) of the production feed.
INDEX_SYMBOLS = [
    "VNM", "VIC", "VHM", "VCB", "GAS", "SAB", "BID", "MSN", "TCB", "HPG",
    "MWG", "VRE", "VJC", "PLX", "VPB", "FPT", "POW", "BVH", "NVL", "STB",
    "HDB", "TPB", "PNJ", "REE", "SSI", "CTG", "KDH", "GVR", "PDR", "ACB",
]

# Quote feed rename (vendor names to the staging names).
QUOTE_RENAME = {"date": "time", "openPrice": "open", "highPrice": "high",
                "lowPrice": "low", "closePrice": "close", "volume": "volume"}

# Pattern removing one trailing parenthetical, e.g. "ROE (%)" -> "ROE".
TRAILING_PAREN = r"\s*\([^)]*\)\s*$"

# Sentinel written into missing ratio values.
RATIO_SENTINEL = -99999999.0

# ---------------------------------------------------------------------------


def strip_trailing_paren(c: Column | str) -> Column:
    """Drop one trailing '(...)' and surrounding blanks, then trim."""
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(col, TRAILING_PAREN, ""))


def canonical_ratio_name(c: Column | str) -> Column:
    """Name used on both sides of the ratio key lookup in normalised mode.

    C7, then blanks around '/' removed, so the dimension's 'TSCĐ / Vốn CSH'
    and the fact's 'TSCĐ/Vốn CSH' meet (defect D8 fixed on both sides).
    """
    return F.regexp_replace(strip_trailing_paren(c), r"\s*/\s*", "/")
