"""Splits by time and group: blocks, walk-forward folds, the sealed part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.numeric import HOUR
from pitpanel.operators.ranges import numbered, quantiles


def first_t0(events: DataFrame) -> DataFrame:
    return events.groupBy("event_group").agg(F.min("t0").alias("first_t0"))


def group_blocks(events: DataFrame, blocks: int) -> DataFrame:
    """``event_group, block``: groups ranked by first t0 (then name) in equal parts."""
    ranked = numbered(first_t0(events), "first_t0", ["event_group"], "rank", "n")
    return ranked.select("event_group", F.floor(F.col("rank") * blocks / F.col("n")).cast("bigint").alias("block"))


def walk_forward(events: DataFrame, splits: int = 5, embargo_h: int = 4) -> DataFrame:
    """``market_ticker, t0, fold, role``: fold k validates on block k and trains on earlier
    blocks whose label windows end an embargo before the first validation time.

    A fold without training rows is left out.
    """
    rows = events.join(group_blocks(events, splits + 1), "event_group")
    bounds = rows.filter("block >= 1").groupBy(F.col("block").alias("fold")).agg((F.min("t0") - embargo_h * HOUR).alias("cutoff"))
    # At most ``splits`` rows of bounds.
    met = rows.join(F.broadcast(bounds), F.col("block") <= F.col("fold"))
    role = F.when(F.col("block") == F.col("fold"), "val").when(F.col("t_end") <= F.col("cutoff"), "train")
    both = met.select("market_ticker", "t0", "fold", role.alias("role")).filter("role is not null")
    full = both.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n")).filter("n > 0").select("fold")
    return both.join(F.broadcast(full), "fold", "left_semi").select("market_ticker", "t0", "fold", "role")


def seal_time(events: DataFrame, fraction: float = 0.15) -> DataFrame:
    """One row: the t0 quantile at 1 - fraction, truncated."""
    return quantiles(events, F.col("t0"), {"seal": 1 - fraction}).select(F.col("seal").cast("bigint").alias("seal"))


def seal_split(events: DataFrame, fraction: float = 0.15, embargo_h: int = 4) -> DataFrame:
    """``events`` with ``part``: groups that start at the seal time or later are sealed, dev
    rows end an embargo before it, the rest is purged."""
    rows = events.join(first_t0(events), "event_group").crossJoin(F.broadcast(seal_time(events, fraction)))
    part = F.when(F.col("first_t0") >= F.col("seal"), "sealed").when(F.col("t_end") <= F.col("seal") - embargo_h * HOUR, "dev").otherwise("purged")
    return rows.withColumn("part", part).drop("first_t0", "seal")


def events_index(split: DataFrame) -> DataFrame:
    """The label-free projection of a split."""
    return split.select("market_ticker", "event_group", "series", "t0", F.col("part").alias("split"))


def check_fit_rows(fit: DataFrame, fold: DataFrame) -> None:
    """Raises if a row to fit on isn't a training row of the fold."""
    outside = fit.select("market_ticker", "t0").exceptAll(fold.select("market_ticker", "t0"))
    n = outside.count()
    if n:
        raise ValueError(f"{n} rows to fit on lie outside the training fold")
