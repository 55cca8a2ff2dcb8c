"""Price indicators as Column expressions.

Every windowed indicator takes the window spec from the caller, so one
plan computes it for all symbols at once (partition by the stock key).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockyard.functions.rounding import rnd

# Signals compare moving averages after rounding to this many decimals, so
# equal averages summed in a different order still compare equal.
SIGNAL_DIGITS = 8


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct_change(new: Column | str, old: Column | str) -> Column:
    """(new - old) / NULLIF(old, 0) * 100 - NULL instead of a division error."""
    new, old = _c(new), _c(old)
    return (new - old) / F.nullif(old, F.lit(0.0)) * 100


def clip_gain(delta: Column | str) -> Column:
    """max(delta, 0), keeping NULL (greatest() would turn NULL into 0)."""
    d = _c(delta)
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))


def clip_loss(delta: Column | str) -> Column:
    """-min(delta, 0), keeping NULL."""
    d = _c(delta)
    return F.when(d.isNotNull(), -F.least(d, F.lit(0.0)))


def rsi_from_means(avg_gain: Column | str, avg_loss: Column | str) -> Column:
    """100 - 100 / (1 + gain/loss); loss 0 and gain > 0 gives 100; 0/0 gives NULL."""
    g, l = _c(avg_gain), _c(avg_loss)
    return (F.when(l == 0, F.when(g > 0, F.lit(100.0)))
             .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + g / l)))


def rsi_state(r: Column | str) -> Column:
    r = _c(r)
    return (F.when(r > 70, F.lit("Overbought"))
             .when(r < 30, F.lit("Oversold"))
             .when(r.isNotNull(), F.lit("Neutral")))


def ma_signal(fast: Column | str, slow: Column | str) -> Column:
    """Two-way signal: Bullish when fast > slow, everything else (ties, NULL) Bearish."""
    f, s = rnd(_c(fast), SIGNAL_DIGITS), rnd(_c(slow), SIGNAL_DIGITS)
    return F.when(f > s, F.lit("Bullish")).otherwise(F.lit("Bearish"))


def trend3(fast: Column | str, slow: Column | str) -> Column:
    """Three-way trend: Bullish / Bearish / Neutral (ties and NULLs)."""
    f, s = _c(fast), _c(slow)
    return (F.when(f > s, F.lit("Bullish"))
             .when(f < s, F.lit("Bearish"))
             .otherwise(F.lit("Neutral")))
