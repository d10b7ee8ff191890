"""Streaming variants: a market's last quote, and articles joined to events by interval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_candles(trades: DataFrame, late: str = "2 hours") -> DataFrame:
    """Candles from a stream of trades (``ts`` timestamp, ``market_ticker``, ``p``); a candle
    is handed on when its hour has closed and the watermark has passed it."""
    hours = trades.withWatermark("ts", late).groupBy("market_ticker", F.window("ts", "1 hour"))
    made = hours.agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count("*").cast("double").alias("volume"))
    return made.select("market_ticker", F.unix_timestamp("window.end").alias("ts"), "low", "high", "volume")


def last_quotes(updates: DataFrame, max_age: int, late: str = "2 hours", forget: int = 30 * 86_400) -> DataFrame:
    """Probes of a stream answered by the latest earlier quote of their market.

    ``updates`` has ``market_ticker, at (timestamp), kind (quote or probe), mid``. The state
    is one quote a market; a quote older than ``max_age`` seconds is stale, and a market of
    which nothing was heard for ``forget`` seconds of the watermark's time is forgotten. Rows
    of one batch are taken in order of time, quotes first.
    """
    state = "ts double, mid double"

    def one(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        ts, mid = held.get if held.exists else (float("-inf"), float("nan"))
        rows = pd.concat(list(parts))
        rows["e"] = rows["at"].astype("datetime64[us]").astype("int64") / 1e6
        rows["probe"] = rows["kind"] == "probe"
        rows = rows.sort_values(["e", "probe"], ignore_index=True)
        # The place of the latest quote at each row, 0 for the one of the state.
        fresh = ~rows["probe"] & (rows["e"] >= ts)
        place = (rows.index.to_series() + 1).where(fresh).ffill().fillna(0).astype(int)
        times, mids = np.append(ts, rows["e"])[place], np.append(mid, rows["mid"].astype(float))[place]
        age = rows["e"] - times
        status = np.where(np.isneginf(times), "no_quote", np.where(age > max_age, "stale", "valid"))
        made = pd.DataFrame({"market_ticker": key[0], "at": rows["at"], "state": status, "mid": np.where(status == "valid", mids, np.nan)})
        held.update((float(times[-1]), float(mids[-1])))
        heard = max(float(rows["e"].iloc[-1]) * 1000, held.getCurrentWatermarkMs())
        held.setTimeoutTimestamp(int(heard) + forget * 1000)
        yield made[rows["probe"]]

    return (
        updates.withWatermark("at", late)
        .groupBy("market_ticker")
        .applyInPandasWithState(one, "market_ticker string, at timestamp, state string, mid double", state, "append", GroupStateTimeout.EventTimeTimeout)
    )


def articles_before(events: DataFrame, articles: DataFrame, lookback: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Stream-stream interval join: articles published in [t0 - lookback, t0) of an event.

    ``events`` has ``market_ticker, t0``; ``articles`` ``market_ticker, published`` and more;
    both times are timestamps.
    """
    left = events.withWatermark("t0", late).alias("e")
    right = articles.withWatermark("published", late).withColumnRenamed("market_ticker", "_market").alias("a")
    inside = F.expr(f"_market = market_ticker AND published < t0 AND published >= t0 - INTERVAL {lookback}")
    return left.join(right, inside).drop("_market")
