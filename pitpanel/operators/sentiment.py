"""Sentiment features of events over the articles published before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.numeric import HOUR
from pitpanel.operators.asof import in_window

EVENT_FEATURES = [
    "mean_positive", "mean_negative", "mean_neutral", "mean_sentiment", "pct_positive", "pct_negative", "non_neutral_ratio",
    "sentiment_abs_mean", "sentiment_variance", "sentiment_range", "avg_confidence", "article_count", "log_article_count",
    "agreement_ratio", "entropy", "sentiment_kurtosis", "dual_polarity_ratio", "polarity_strength",
]
TEMPORAL_FEATURES = ["recency_weighted_sentiment", "early_vs_late_sentiment", "sentiment_momentum", "freshness", "event_hour"]
SENTIMENT_FEATURES = [*EVENT_FEATURES, *TEMPORAL_FEATURES, "sentiment_shock"]
TINY = 1e-6


def assign_articles(events: DataFrame, articles: DataFrame, lookback_h: int = 6) -> DataFrame:
    """Event keys with the articles in [t0 - lookback, t0), each url once an event, the earliest."""
    keys = events.select("market_ticker", "t0")
    met = in_window(keys, articles, "market_ticker", "t0", "ts", lookback_h * HOUR)
    first = Window.partitionBy("market_ticker", "t0", "url").orderBy("ts", "doc_id")
    return met.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def sentiment_features(events: DataFrame, articles: DataFrame, lookback_h: int = 6) -> DataFrame:
    """``market_ticker, t0`` and the features; null where an event has no article, apart from
    ``event_hour`` and ``sentiment_shock``."""
    s = F.col("positive") - F.col("negative")
    rows = assign_articles(events, articles, lookback_h).select(
        "market_ticker", "t0", "label", "positive", "negative", "neutral", "confidence", s.alias("s"),
        F.greatest((F.col("t0") - F.col("ts")) / HOUR, F.lit(0.0)).alias("h"),
    )
    half = Window.partitionBy("market_ticker", "t0")
    rows = rows.withColumn("half", F.percentile("h", F.lit(0.5)).over(half))
    n = F.count("*")
    share = lambda name: F.count_if(F.col("label") == name) / n
    part = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    weight = F.pow(F.lit(0.94), F.col("h"))
    s, h = F.col("s"), F.col("h")
    late, early = F.avg(F.when(h <= F.col("half"), s)), F.avg(F.when(h > F.col("half"), s))
    wide = rows.groupBy("market_ticker", "t0").agg(
        n.alias("n"),
        *(F.avg(c).alias(f"mean_{c}") for c in ("positive", "negative", "neutral")),
        F.avg(s).alias("mean_sentiment"),
        share("positive").alias("pct_positive"), share("negative").alias("pct_negative"), share("neutral").alias("pct_neutral"),
        F.avg(F.abs(s)).alias("sentiment_abs_mean"), F.var_pop(s).alias("sentiment_variance"),
        (F.max(s) - F.min(s)).alias("sentiment_range"), F.avg("confidence").alias("avg_confidence"),
        F.stddev_pop(s).alias("std"), F.kurtosis(s).alias("kurtosis"),
        (F.sum(weight * s) / F.sum(weight)).alias("recency_weighted_sentiment"),
        F.coalesce(late - early, F.lit(0.0)).alias("early_vs_late_sentiment"),
        F.regr_slope(s, -h).alias("slope"), (F.max(h) - F.min(h)).alias("h_range"), F.min(h).alias("freshness"),
    ).select(
        "market_ticker", "t0", "mean_positive", "mean_negative", "mean_neutral", "mean_sentiment", "pct_positive", "pct_negative",
        (1 - F.col("pct_neutral")).alias("non_neutral_ratio"), "sentiment_abs_mean", "sentiment_variance", "sentiment_range", "avg_confidence",
        F.col("n").cast("double").alias("article_count"), F.log1p(F.col("n").cast("double")).alias("log_article_count"),
        F.greatest("pct_positive", "pct_negative", "pct_neutral").alias("agreement_ratio"),
        (part(F.col("pct_positive")) + part(F.col("pct_negative")) + part(F.col("pct_neutral"))).alias("entropy"),
        F.when((F.col("n") >= 4) & (F.col("std") >= TINY), F.col("kurtosis")).otherwise(0.0).alias("sentiment_kurtosis"),
        (F.col("mean_positive") / (F.col("mean_positive") + F.col("mean_negative") + TINY)).alias("dual_polarity_ratio"),
        F.abs(F.col("pct_positive") - F.col("pct_negative")).alias("polarity_strength"),
        "recency_weighted_sentiment", "early_vs_late_sentiment",
        F.when((F.col("n") >= 2) & (F.col("h_range") >= 0.1), F.col("slope")).otherwise(0.0).alias("sentiment_momentum"), "freshness",
    )
    out = events.select("market_ticker", "t0").join(wide, ["market_ticker", "t0"], "left")
    out = out.withColumn("event_hour", F.floor(F.col("t0") / HOUR % 24).cast("double"))
    before = Window.partitionBy("market_ticker").orderBy("t0").rowsBetween(-20, -1)
    m = F.col("mean_sentiment")
    enough = F.count(m).over(before) >= 3
    shock = (m - F.avg(m).over(before)) / F.greatest(F.stddev_samp(m).over(before), F.lit(TINY))
    return out.withColumn("sentiment_shock", F.coalesce(F.when(enough, shock), F.lit(0.0))).select("market_ticker", "t0", *SENTIMENT_FEATURES)


def zero_filled(features: DataFrame) -> DataFrame:
    """The defaults of an event without articles: all zeros."""
    return features.fillna(0.0, SENTIMENT_FEATURES)
