"""Column-in / Column-out helpers. All JVM-side built-ins, no Python UDFs."""

from stockyard.functions.rounding import rnd, r2, r4
from stockyard.functions.dates import time_key, date_parts
from stockyard.functions.indicators import (
    pct_change, clip_gain, clip_loss, rsi_from_means, rsi_state, ma_signal, trend3,
)

__all__ = [
    "rnd", "r2", "r4", "time_key", "date_parts", "pct_change", "clip_gain", "clip_loss",
    "rsi_from_means", "rsi_state", "ma_signal", "trend3",
]
