"""Candidate grid, filter cascade and labels of events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.numeric import HOUR, divide_up
from pitpanel.operators.asof import asof, classified, quote_at

LABELS = ["DOWN", "FLAT", "UP"]
VALUE = {"DOWN": -1.0, "FLAT": 0.0, "UP": 1.0}


@dataclass(frozen=True)
class LabelConfig:
    horizon_h: int = 4
    threshold: float = 0.03
    staleness_h: int = 2
    max_spread: float = 0.20
    settle_buffer_h: int = 4


#: What suits the derived panels.
PANEL = LabelConfig(threshold=0.10, max_spread=0.5)


def grid(markets: DataFrame, cfg: LabelConfig = LabelConfig()) -> DataFrame:
    """``markets`` exploded to candidates: every grid time from open on and before close."""
    step = cfg.horizon_h * HOUR
    first = divide_up(F.col("open_ts"), step) * step
    times = F.when(first < F.col("close_ts"), F.sequence(first.cast("bigint"), F.col("close_ts") - 1, F.lit(step).cast("bigint")))
    return markets.withColumn("t0", F.explode(times)).withColumn("t_end", F.col("t0") + step)


def label_of(move: Column, threshold: float) -> Column:
    return F.when(move > threshold, "UP").when(move < -threshold, "DOWN").otherwise("FLAT")


def label_value(label: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in VALUE.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def candidates(markets: DataFrame, candles: DataFrame, cfg: LabelConfig = LabelConfig(), bucket: int | None = None) -> DataFrame:
    """All candidates with both quotes, ``status`` (first failing filter, or ``event``) and label.

    Both ends of a candidate are probes of one as-of lookup.
    """
    points = grid(markets, cfg).withColumn("at", F.explode(F.array("t0", "t_end")))
    facts = classified(candles)
    seen = asof(points, facts, "market_ticker", "at", "ts", ["state", "mid", "spread"], bucket)
    state = quote_at(F.col("fact"), F.col("at"), cfg.staleness_h * HOUR)
    valid = state == "valid"
    seen = seen.select(
        *markets.columns, "t0", "t_end", "at", state.alias("state"), ((F.col("at") - F.col("fact.ts")) / HOUR).alias("age_h"),
        F.when(valid, F.col("fact.mid")).alias("mid"), F.when(valid, F.col("fact.spread")).alias("spread"),
    )
    side = {"t0": F.col("at") == F.col("t0"), "end": F.col("at") == F.col("t_end")}
    both = seen.groupBy(*markets.columns, "t0", "t_end").agg(
        *(F.max(F.when(on, F.col(c))).alias(f"{c}_{end}") for end, on in side.items() for c in ("state", "mid", "spread", "age_h"))
    )
    move = F.col("mid_end") - F.col("mid_t0")
    status = (
        F.when(F.col("t_end") > F.col("close_ts") - cfg.settle_buffer_h * HOUR, "near_close")
        .when(F.col("state_t0") != "valid", F.concat(F.lit("t0_"), "state_t0"))
        .when(F.col("state_end") != "valid", F.concat(F.lit("end_"), "state_end"))
        .when(F.greatest("spread_t0", "spread_end") > cfg.max_spread, "wide_spread")
        .otherwise("event")
    )
    return both.withColumns({"status": status, "dmid": move}).withColumn("label", F.when(F.col("status") == "event", label_of(F.col("dmid"), cfg.threshold)))


def events(markets: DataFrame, candles: DataFrame, cfg: LabelConfig = LabelConfig(), bucket: int | None = None) -> DataFrame:
    """The labelled events; the label is of the unrounded move, which is then rounded."""
    rows = candidates(markets, candles, cfg, bucket).filter("status = 'event'")
    return rows.select(
        "market_ticker", "event_group", "series", "t0", "t_end", "mid_t0", "mid_end", F.round("dmid", 6).alias("dmid"),
        "spread_t0", "spread_end", F.col("age_h_t0").alias("quote_age_t0_h"), F.col("age_h_end").alias("quote_age_end_h"), "label",
    )


def attrition(candidates: DataFrame) -> DataFrame:
    """``status, n``: how many candidates each filter drops, the events, and all candidates."""
    return candidates.rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("candidates")).alias("status"), "n")
