"""Price features of events, all from one shuffle by market."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.numeric import HOUR, finite
from pitpanel.operators.asof import classified
from pitpanel.operators.labels import label_value

PRICE_FEATURES = [
    "mid", "spread", "rel_spread", "dist_from_half", "ret_1h", "ret_4h", "ret_24h", "prev_label",
    "vol_24h", "range_24h", "log_volume_24h", "active_hours_24h", "oi_change_24h", "hours_since_open", "hours_to_close",
]
#: Known before t0, yet left out of the default columns.
PROVISIONAL = ["hours_to_close"]
DEFAULT_COLUMNS = [c for c in PRICE_FEATURES if c not in PROVISIONAL]
BACK = (0, 1, 4, 24)


def price_features(events: DataFrame, candles: DataFrame, markets: DataFrame, staleness_h: int = 2) -> DataFrame:
    """``events`` with the price features, each from candles at or before t0.

    An event is four probes (now and 1, 4, 24 hours ago) among its market's candles; the
    windows of the last value, the last valid value and the last day share one sort. The
    present probe carries the event, so events are computed once and not joined back.
    """
    keys = ["market_ticker", "t0"]
    bounds = markets.select("market_ticker", "open_ts", "close_ts")
    rows = events.join(bounds, "market_ticker")
    event = F.struct(*events.columns, "open_ts", "close_ts")
    probes = rows.select("market_ticker", "t0", event.alias("event"), F.explode(F.array(*map(F.lit, BACK))).alias("back"))
    probes = probes.withColumn("event", F.when(F.col("back") == 0, F.col("event")))
    probes = probes.withColumns({"at": F.col("t0") - F.col("back") * HOUR, "probe": F.lit(1)})
    facts = classified(candles).select(
        "market_ticker", F.col("ts").alias("at"), F.lit(0).alias("probe"), "ts", "state", "mid", "spread", "volume", "open_interest"
    )
    union = probes.unionByName(facts, allowMissingColumns=True)
    seen = Window.partitionBy("market_ticker").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy("market_ticker").orderBy("at").rangeBetween(-24 * HOUR + 1, 0)
    is_fact = F.col("probe") == 0
    fact = F.last(F.when(is_fact, F.struct("ts", "state", "mid", "spread", "open_interest")), True).over(seen)
    valid = F.last(F.when(is_fact & F.col("mid").isNotNull(), F.struct("ts", "mid")), True).over(seen)
    mids = F.collect_list(F.when(is_fact & F.col("mid").isNotNull(), F.struct("ts", "mid"))).over(day)
    found = union.select(
        "market_ticker", "t0", "event", "at", "probe", "back", fact.alias("fact"), valid.alias("last"), F.array_sort(mids).alias("mids"),
        F.sum(F.when(is_fact, F.col("volume"))).over(day).alias("day_volume"), F.count_if(is_fact & (F.col("volume") > 0)).over(day).alias("active"),
    ).filter("probe = 1")
    now = F.col("back") == 0
    fresh = now & (F.col("fact.state") == "valid") & (F.col("at") - F.col("fact.ts") <= staleness_h * HOUR)
    path = F.transform("mids", lambda m: m["mid"])
    wide = found.groupBy(*keys).agg(
        F.first("event", ignorenulls=True).alias("event"),
        F.max(F.when(fresh, F.col("fact.mid"))).alias("mid"),
        F.max(F.when(fresh, F.col("fact.spread"))).alias("spread"),
        *(
            F.max(F.when((F.col("back") == h) & (F.col("at") - F.col("last.ts") <= max(h, staleness_h) * HOUR), F.col("last.mid"))).alias(f"mid_{h}h")
            for h in BACK[1:]
        ),
        F.max(F.when(now, F.col("fact.open_interest"))).alias("oi_now"),
        F.max(F.when(F.col("back") == 24, F.col("fact.open_interest"))).alias("oi_then"),
        F.max(F.when(now, path)).alias("path"),
        F.max(F.when(now, F.col("day_volume"))).alias("day_volume"),
        F.max(F.when(now, F.col("active"))).alias("active"),
    )
    n = F.size("path")
    steps = F.when(n >= 3, F.zip_with(F.slice("path", 2, F.greatest(n - 1, F.lit(1))), F.slice("path", 1, F.greatest(n - 1, F.lit(1))), lambda b, a: b - a))
    wide = wide.withColumn("steps", steps)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    wide = wide.withColumn("step_mean", total("steps") / F.size("steps"))
    spread_of = F.sqrt(F.aggregate("steps", F.lit(0.0), lambda a, x: a + (x - F.col("step_mean")) * (x - F.col("step_mean"))) / F.size("steps"))
    order = Window.partitionBy("market_ticker").orderBy("t0")
    mid = F.col("mid")
    return (
        wide.drop(*keys).select("event.*", "*").drop("event")
        .withColumns({"_end": F.lag("t_end").over(order), "_label": F.lag("label").over(order)})
        .select(
            *events.columns,
            mid, F.col("spread"),
            finite(F.when(mid != 0, F.col("spread") / mid)).alias("rel_spread"),
            F.abs(mid - 0.5).alias("dist_from_half"),
            *((mid - F.col(f"mid_{h}h")).alias(f"ret_{h}h") for h in BACK[1:]),
            F.when(F.col("_end") <= F.col("t0"), label_value(F.col("_label"))).alias("prev_label"),
            F.when(n >= 3, spread_of).alias("vol_24h"),
            F.when(n > 0, F.array_max("path") - F.array_min("path")).alias("range_24h"),
            F.log1p(F.coalesce("day_volume", F.lit(0.0))).alias("log_volume_24h"),
            F.coalesce("active", F.lit(0)).cast("double").alias("active_hours_24h"),
            (F.col("oi_now") - F.col("oi_then")).alias("oi_change_24h"),
            ((F.col("t0") - F.col("open_ts")) / HOUR).alias("hours_since_open"),
            ((F.col("close_ts") - F.col("t0")) / HOUR).alias("hours_to_close"),
        )
    )
