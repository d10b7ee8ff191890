"""Candle JSON of two dialects as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitpanel.functions.numeric import number

SIDES = [("yes_bid", "bid"), ("yes_ask", "ask"), ("price", "price")]
FIELDS = ["open", "high", "low", "close"]
#: The fixed columns of a flat candle.
CANDLE = ["end_period_ts", *(f"{side}_{f}" for _, side in SIDES for f in FIELDS), "volume", "open_interest"]


def schema(live: bool) -> str:
    """Of one candle; the live dialect has suffixed names. All amounts are text."""
    money, size = ("_dollars", "_fp") if live else ("", "")
    sides = ", ".join(f"{side}: struct<{', '.join(f'{f}{money}: string' for f in FIELDS)}>" for side, _ in SIDES)
    return f"struct<end_period_ts: bigint, open_interest{size}: string, volume{size}: string, {sides}>"


def flatten(candle: Column, live: bool) -> list[Column]:
    """The fixed columns; null where a side or field is absent, never zero."""
    money, size = ("_dollars", "_fp") if live else ("", "")
    out = [candle["end_period_ts"].alias("end_period_ts")]
    out += [number(candle[side][f"{f}{money}"]).alias(f"{name}_{f}") for side, name in SIDES for f in FIELDS]
    return [*out, number(candle[f"volume{size}"]).alias("volume"), number(candle[f"open_interest{size}"]).alias("open_interest")]


def parse(rows: DataFrame, json_col: str, source_col: str) -> DataFrame:
    """Rows with one candle's JSON text and a source tag, ``historical`` or ``live``, as flat candles."""
    old, new = (F.from_json(json_col, schema(live)) for live in (False, True))
    is_live = F.col(source_col) == "live"
    flat = [F.when(is_live, b).otherwise(a).alias(name) for name, a, b in zip(CANDLE, flatten(old, False), flatten(new, True))]
    return rows.select(*[c for c in rows.columns if c not in (json_col, *CANDLE)], *flat)


def read_market_candles(spark: SparkSession, root: str, live: bool = False) -> DataFrame:
    """All files ``candles/<series>/<ticker>__<window>.json.gz`` under ``root`` as flat candles.

    A market's repeated hours keep the row of the last file, and of its last candle.
    """
    raw = spark.read.schema(f"candlesticks array<{schema(live)}>").option("multiLine", True).json(f"{root}/candles/*/*.json.gz")
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, r"([^/]+)__[^/]*\.json\.gz$", 1)
    rows = raw.select(name.alias("market_ticker"), path.alias("file"), F.posexplode("candlesticks").alias("place", "candle"))
    rows = rows.select("market_ticker", "file", "place", *flatten(F.col("candle"), live))
    return keep_last(rows, ["market_ticker", "end_period_ts"], [F.desc("file"), F.desc("place")]).drop("file", "place")


def keep_last(rows: DataFrame, keys: list[str], latest_first: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order."""
    order = Window.partitionBy(*keys).orderBy(*latest_first)
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def request_windows(markets: DataFrame, period_minutes: int = 60, most: int = 5000) -> DataFrame:
    """Contiguous request windows of each market, each under the cap of candles a request."""
    span = (most - 1) * period_minutes * 60
    starts = F.when(F.col("open_ts") < F.col("close_ts"), F.sequence("open_ts", F.col("close_ts") - 1, F.lit(span).cast("bigint")))
    return markets.select("market_ticker", "close_ts", F.explode(starts).alias("start_ts")).select(
        "market_ticker", "start_ts", F.least(F.col("start_ts") + span, "close_ts").alias("end_ts")
    )
