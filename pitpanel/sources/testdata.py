"""Panels of markets and candles, derived from the event stream of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitpanel.functions.numeric import epoch

#: First second of the event stream, and three days.
ORIGIN, BUCKET = 1_704_067_200, 259_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, staggered: bool) -> DataFrame:
    """One row an event: market, group, series, epoch seconds, price in (0, 1)."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("series"), epoch(F.col("ts")).alias("e"), "value")
    if staggered:
        group = F.concat("series", F.lit("-B"), F.floor((F.col("e") - ORIGIN) / BUCKET).cast("string"))
        market = F.concat(group, F.lit("-"), (F.col("user_id") % 4).cast("string"))
    else:
        group = F.concat("series", F.lit("-G"), (F.col("user_id") % 2).cast("string"))
        market = F.concat("series", F.lit("-"), (F.col("user_id") % 4).cast("string"))
    return rows.select("event_id", "series", group.alias("event_group"), market.alias("market_ticker"), "e", (F.col("value") / (F.col("value") + 50)).alias("p"))


def candles(spark: SparkSession, sf_dir: str, staggered: bool = False) -> DataFrame:
    """Hourly candles: ``market_ticker, ts, bid, ask, volume, open_interest``."""
    hours = (
        trades(spark, sf_dir, staggered)
        .groupBy("market_ticker", ((F.floor(F.col("e") / 3600) + 1) * 3600).cast("bigint").alias("ts"))
        .agg(F.min("event_id").alias("first_id"), F.min("p").alias("low"), F.max("p").alias("high"), F.count("*").alias("n"))
    )
    seen = Window.partitionBy("market_ticker").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return hours.select(
        "market_ticker", "ts",
        F.when(F.col("first_id") % 17 == 0, 0.0).otherwise(F.col("low")).alias("bid"),
        F.when(F.col("first_id") % 13 == 0, F.col("low") - 0.01).otherwise(F.col("high") + 0.02).alias("ask"),
        F.col("n").cast("double").alias("volume"),
        F.sum("n").over(seen).cast("double").alias("open_interest"),
    )


def markets(spark: SparkSession, sf_dir: str, staggered: bool = False) -> DataFrame:
    """``market_ticker, event_group, series, open_ts, close_ts``."""
    return (
        trades(spark, sf_dir, staggered)
        .groupBy("market_ticker", "event_group", "series")
        .agg(F.min("e").alias("first"), F.max("e").alias("close_ts"))
        .select("market_ticker", "event_group", "series", ((F.floor(F.col("first") / 14400) - 1) * 14400).cast("bigint").alias("open_ts"), "close_ts")
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored articles from documents: ``url, ts, label, positive, negative, neutral, confidence, market_ticker``.

    Scores and times follow from ids and lengths alone, so any engine can derive them.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    a, b = F.col("doc_id") * 37 % 100, F.col("n_chars") * 13 % 100
    total = (a + b + 50).cast("double")
    series = F.element_at(F.array(*map(F.lit, SERIES)), (F.col("doc_id") % len(SERIES) + 1).cast("int"))
    scored = d.select(
        (F.col("doc_id") % 900).alias("url_id"),
        (F.lit(ORIGIN) + F.col("doc_id") * 7919 % (29 * 86400)).cast("bigint").alias("ts"),
        F.concat(series, F.lit("-"), (F.floor(F.col("doc_id") / len(SERIES)) % 4).cast("string")).alias("market_ticker"),
        (a / total).alias("positive"), (b / total).alias("negative"), (F.lit(50.0) / total).alias("neutral"), "doc_id",
    )
    best = F.greatest("positive", "negative", "neutral")
    return scored.select(
        F.concat(F.lit("https://news.example.com/"), F.col("url_id").cast("string")).alias("url"), "doc_id", "market_ticker", "ts",
        F.when(F.col("positive") == best, "positive").when(F.col("negative") == best, "negative").otherwise("neutral").alias("label"),
        "positive", "negative", "neutral", best.alias("confidence"),
    )


#: The event types of the stream.
SERIES = ["click", "error", "purchase", "signup", "view"]
