"""The whole frame of signals: windowed indicators in one sorted pass, recursive ones beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidepool.functions import recursive
from tidepool.operators import windows

#: Columns of the frame beside ticker and date.
SIGNALS = ("sma", "upper", "lower", "width", "stoch_k", "williams_r", "obv", "roc", "volume_roc", "proximity", "sma_deviation", "ret_1", "ret_5")


def signals(bars: DataFrame) -> DataFrame:
    """ticker, date, the windowed signals and the recursive ones; nulls where a signal's own past is too short."""
    out = bars
    for step in (windows.proximity, windows.bollinger, windows.stochastic, windows.obv, windows.rate_of_change, windows.sma_deviation, windows.lag_returns):  # proximity sorts blocks, so while rows are narrow
        out = step(out)
    kept = out.select("ticker", "date", *SIGNALS)
    again = recursive.recursive_indicators(bars)
    return kept.join(again.select("ticker", "date", *recursive.INDICATORS), ["ticker", "date"], "left")
