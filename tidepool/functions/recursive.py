"""Exponential recursions, which no framed window expresses: one grouped pandas pass per ticker."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

INDICATORS = ("ema_9", "ema_21", "ema_50", "macd_diff", "rsi_14", "atr_14")


def _per_ticker(pdf: pd.DataFrame) -> pd.DataFrame:
    d = pdf.sort_values("date")
    c = d["close"]
    ema = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n).mean()
    wilder = lambda x, n: x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    move = c.diff()
    gain, loss = wilder(move.clip(lower=0), 14), wilder(-move.clip(upper=0), 14)
    macd = ema(c, 12) - ema(c, 26)
    before = c.shift()
    tr = pd.concat([d["high"] - d["low"], (d["high"] - before).abs(), (d["low"] - before).abs()], axis=1).max(axis=1)
    rsi = (100 - 100 / (1 + gain / loss)).where(loss != 0, 100.0).where(loss.notna())
    return pd.DataFrame({"ticker": d["ticker"], "date": d["date"], "ema_9": ema(c, 9), "ema_21": ema(c, 21), "ema_50": ema(c, 50),
                         "macd_diff": macd - macd.ewm(span=9, adjust=False, min_periods=9).mean(), "rsi_14": rsi, "atr_14": wilder(tr, 14)})


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """EMA 9, 21, 50, MACD histogram (12, 26, 9), Wilder's RSI 14 and ATR 14, null in their warm-up.

    A ticker's bars are one group: a few thousand rows whatever the size of the market.
    """
    schema = "ticker long, date date, " + ", ".join(f"{c} double" for c in INDICATORS)
    return bars.select("ticker", "date", "high", "low", "close").groupBy("ticker").applyInPandas(_per_ticker, schema)
