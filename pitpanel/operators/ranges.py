"""Orders of whole tables, told without sorting a whole table in one task.

Distinct values are counted first and dealt out to ranges, whose edges are approximate
quantiles found inside the same plan. Ranges are summed side by side; only a row a range is
summed up as a whole. Where the edges lie doesn't alter any result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def in_ranges(values: DataFrame, by: str) -> DataFrame:
    """``values`` with ``_range``, which grows with ``by``; equal values share one."""
    edges = values.agg(F.percentile_approx(by, [k / RANGES for k in range(1, RANGES)], 1000).alias("_edges"))
    number = F.size(F.filter("_edges", lambda e: e < F.col(by)))
    return values.crossJoin(F.broadcast(edges)).withColumn("_range", F.coalesce(number, F.lit(0))).drop("_edges")


def running(values: DataFrame, by: str, weights: list[str]) -> DataFrame:
    """``values``, a row a value of ``by``, with ``w_before`` and ``w_all`` for each weight w:
    its sum over smaller values and over all."""
    dealt = in_ranges(values, by)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows
    sums = dealt.groupBy("_range").agg(*(F.sum(w).alias(w) for w in weights))
    bases = sums.select("_range", *(F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"_{w}_base") for w in weights), *(F.sum(w).over(Window.partitionBy()).alias(f"{w}_all") for w in weights))
    inside = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.join(F.broadcast(bases), "_range")
    before = {f"{w}_before": F.col(f"_{w}_base") + F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights}
    return met.withColumns(before).drop("_range", *(f"_{w}_base" for w in weights))


def numbered(rows: DataFrame, first: str, rest: list[str], at: str, total: str) -> DataFrame:
    """``rows`` with their place ``at`` in the order of ``first`` and ``rest``, from 0, and their number."""
    counts = running(rows.groupBy(first).agg(F.count("*").alias("_in")), first, ["_in"])
    own = F.row_number().over(Window.partitionBy(first).orderBy(*rest)) - 1
    met = rows.join(counts.select(first, "_in_before", F.col("_in_all").alias(total)), first)
    return met.withColumn(at, F.col("_in_before") + own).drop("_in_before")


def quantiles(rows: DataFrame, x: Column, wanted: dict[str, float]) -> DataFrame:
    """One row: exact quantiles of ``x``, linear between two values; null of no values."""
    counts = rows.filter(x.isNotNull()).groupBy(x.alias("_x")).agg(F.count("*").alias("_n"))
    met = running(counts, "_x", ["_n"])
    value, last = F.col("_x").cast("double"), F.col("_n_before") + F.col("_n")
    found, out = [], []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("_n_all") - 1)
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            found.append(F.max(F.when((F.col("_n_before") <= at) & (at < last), value)).alias(f"_{name}_{end}"))
        found.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
        lo, hi, part = (F.col(f"_{name}_{k}") for k in ("lo", "hi", "part"))
        out.append((lo + part * (hi - lo)).alias(name))
    return met.agg(*found).select(*out)


def least_later(values: DataFrame, by: str, x: Column) -> DataFrame:
    """``values``, a row a value of ``by``, with ``least``: the least ``x`` of this and all greater values."""
    dealt = in_ranges(values, by).withColumn("least", x)
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows
    bases = dealt.groupBy("_range").agg(F.min("least").alias("_m")).select("_range", F.min("_m").over(later).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(bases), "_range").withColumn("least", F.least(F.min("least").over(inside), "_base")).drop("_range", "_base")
