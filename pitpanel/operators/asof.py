"""As-of and interval lookups by one shuffle: probes and facts are united and windowed.

A probe is a row with a key and a time; it sees facts of its key at or before that time.
A key with more rows than a task should hold is cut into time buckets: each bucket gets
the last fact before it as a carry-in, found on one summary row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.operators.ranges import running


def asof(probes: DataFrame, facts: DataFrame, key: str, at: str, ts: str, payload: list[str], bucket: int | None = None) -> DataFrame:
    """Each probe with ``fact``: a struct of the latest fact's ``ts`` and payload, or null.

    Of facts at one time the greatest payload counts. With ``bucket`` (seconds), time is
    cut so that no task holds a whole key.
    """
    columns = probes.columns
    fact = F.struct(F.col(ts).alias("ts"), *payload)
    left = probes.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_probe"), F.struct(*columns).alias("_row"))
    right = facts.select(F.col(key).alias("_key"), F.col(ts).alias("_at"), F.lit(0).alias("_probe"), fact.alias("_fact"))
    keys = ["_key"]
    if bucket:
        keys = ["_key", "_bucket"]
        left = left.withColumn("_bucket", F.floor(F.col("_at") / bucket))
        right = right.withColumn("_bucket", F.floor(F.col("_at") / bucket))
        last = right.groupBy("_key", "_bucket").agg(F.max("_fact").alias("_fact"))
        wanted = left.select("_key", "_bucket").distinct()
        summary = last.unionByName(wanted, allowMissingColumns=True).groupBy("_key", "_bucket").agg(F.max("_fact").alias("_fact"))
        before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carry = summary.withColumn("_fact", F.last("_fact", True).over(before)).filter("_fact is not null")
        right = right.unionByName(carry.withColumns({"_at": (F.col("_bucket") * bucket).cast(right.schema["_at"].dataType), "_probe": F.lit(-1)}))
    rows = left.unionByName(right, allowMissingColumns=True)
    seen = Window.partitionBy(*keys).orderBy("_at", "_probe", "_fact").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("fact", F.last("_fact", True).over(seen)).filter("_probe = 1")
    return found.select("_row.*", "fact")


def quote_state(bid: Column, ask: Column) -> Column:
    """no_quote, one_sided, crossed or valid, tested in that order."""
    return (
        F.when(bid.isNull() | ask.isNull(), "no_quote")
        .when((bid <= 0) | (ask >= 1), "one_sided")
        .when(bid >= ask, "crossed")
        .otherwise("valid")
    )


def classified(candles: DataFrame) -> DataFrame:
    """Candles with ``state``, and ``mid`` and ``spread`` where the quote is valid."""
    rows = candles.withColumn("state", quote_state(F.col("bid"), F.col("ask")))
    valid = F.col("state") == "valid"
    return rows.withColumns({"mid": F.when(valid, (F.col("bid") + F.col("ask")) / 2), "spread": F.when(valid, F.col("ask") - F.col("bid"))})


def quote_at(fact: Column, at: Column, max_age: int) -> Column:
    """The state a probe sees: none at all, then too old, then the quote's own state."""
    return F.when(fact.isNull(), "no_quote").when(at - fact["ts"] > max_age, "stale").otherwise(fact["state"])


def within(fact: Column, at: Column, max_age: int) -> Column:
    """The fact unless it is older than ``max_age``; exactly as old is still seen."""
    return F.when(at - fact["ts"] <= max_age, fact)


def in_window(probes: DataFrame, facts: DataFrame, key: str, at: str, ts: str, before: int, bucket: int | None = None, open_right: bool = True) -> DataFrame:
    """Interval join: facts with at - before <= ts < at (or at - before < ts <= at).

    Both sides are cut into time buckets of at least ``before`` seconds, and a probe looks
    into its own and the previous one: an equi-join that spreads a key over its history.
    """
    width = max(bucket or before, before)
    mine = F.floor(F.col(at) / width)
    left = probes.withColumn("_bucket", F.explode(F.array(mine, mine - 1)))
    right = facts.withColumnRenamed(key, "_key").withColumn("_fact_bucket", F.floor(F.col(ts) / width))
    inside = (F.col(ts) >= F.col(at) - before) & (F.col(ts) < F.col(at)) if open_right else (F.col(ts) > F.col(at) - before) & (F.col(ts) <= F.col(at))
    met = left.join(right, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_fact_bucket")) & inside)
    return met.drop("_key", "_bucket", "_fact_bucket")


def resolved(rows: DataFrame, labels: DataFrame, keys: list[str], at: str, sums: dict[str, Column], asks: DataFrame | None = None) -> DataFrame:
    """``rows`` with running sums over the labels of their group that ended by ``at``.

    Labels are summed by end time first, so a group's history is one row a time. ``asks``
    can name the keys and times of the rows, where they are known apart from these. Without
    keys all rows are one group, whose times are summed in ranges.
    """
    if not keys:
        times = labels.select(F.col("t_end").alias(at), *(c.alias(name) for name, c in sums.items()))
        times = times.unionByName((rows if asks is None else asks).select(at).distinct(), allowMissingColumns=True)
        times = times.groupBy(at).agg(*(F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in sums))
        totals = running(times, at, list(sums)).select(at, *((F.col(name) + F.col(f"{name}_before")).alias(name) for name in sums))
        return rows.join(totals, at, "left")
    ends = labels.groupBy(*keys, F.col("t_end").alias("_at")).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    asks = (rows if asks is None else asks).select(*keys, F.col(at).alias("_at")).distinct().withColumn("_ask", F.lit(1))
    both = ends.withColumn("_ask", F.lit(0)).unionByName(asks, allowMissingColumns=True)
    seen = Window.partitionBy(*keys).orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    totals = both.select(*keys, "_at", "_ask", *(F.coalesce(F.sum(name).over(seen), F.lit(0.0)).alias(name) for name in sums)).filter("_ask = 1").drop("_ask")
    return rows.join(totals.withColumnRenamed("_at", at), [*keys, at], "left")
