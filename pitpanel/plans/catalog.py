"""The registry of queries and of their SQL, and the derived panels in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.operators import labels as L
from pitpanel.operators.price import price_features
from pitpanel.sources import testdata as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Rows of panel B whose label ended by then are fitted on.
FIT_UNTIL = 1_705_500_000


def query(name: str, sql: str | None = None):
    """Register a query; its SQL is for DuckDB over the same tables."""

    def add(made: Query) -> Query:
        QUERIES[name] = made
        if sql:
            SQL[name] = sql
        return made

    return add


def r(c: Column | str) -> Column:
    """Rounded, and without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *kept: str) -> DataFrame:
    """All columns, doubles rounded but for those ``kept``."""
    return df.select(*(r(f"`{n}`").alias(n) if t == "double" and n not in kept else F.col(f"`{n}`") for n, t in df.dtypes))


def panel(spark: SparkSession, sf_dir: str, staggered: bool = False) -> tuple[DataFrame, DataFrame]:
    return T.markets(spark, sf_dir, staggered), T.candles(spark, sf_dir, staggered)


def panel_events(spark: SparkSession, sf_dir: str, staggered: bool = False) -> DataFrame:
    return L.events(*panel(spark, sf_dir, staggered), L.PANEL)


def featured(spark: SparkSession, sf_dir: str, staggered: bool = False) -> DataFrame:
    """Events with price features and the mark of rows to fit on."""
    markets, candles = panel(spark, sf_dir, staggered)
    rows = price_features(L.events(markets, candles, L.PANEL), candles, markets)
    return rows.withColumn("fit", F.col("t_end") <= FIT_UNTIL)


_GROUPS = {
    False: "event_type || '-G' || (user_id % 2) AS event_group, event_type || '-' || (user_id % 4) AS market_ticker",
    True: "event_type || '-B' || ((epoch_us(ts) // 1000000 - 1704067200) // 259200) AS event_group, "
    "event_type || '-B' || ((epoch_us(ts) // 1000000 - 1704067200) // 259200) || '-' || (user_id % 4) AS market_ticker",
}


def panel_sql(staggered: bool = False) -> str:
    """Common table expressions: tr, candles, markets, q (classified candles)."""
    return f"""
tr AS (SELECT event_id, event_type AS series, {_GROUPS[staggered]}, epoch_us(ts) // 1000000 AS e, value / (value + 50e0) AS p FROM events),
hours AS (SELECT market_ticker, (e // 3600 + 1) * 3600 AS ts, min(event_id) AS f, min(p) AS lo, max(p) AS hi, count(*) AS n FROM tr GROUP BY ALL),
candles AS (SELECT market_ticker, ts, CASE WHEN f % 17 = 0 THEN 0e0 ELSE lo END AS bid, CASE WHEN f % 13 = 0 THEN lo - 0.01e0 ELSE hi + 0.02e0 END AS ask,
  CAST(n AS DOUBLE) AS volume, CAST(sum(n) OVER (PARTITION BY market_ticker ORDER BY ts) AS DOUBLE) AS open_interest FROM hours),
markets AS (SELECT market_ticker, event_group, series, (min(e) // 14400 - 1) * 14400 AS open_ts, max(e) AS close_ts FROM tr GROUP BY 1, 2, 3),
states AS (SELECT *, CASE WHEN bid IS NULL OR ask IS NULL THEN 'no_quote' WHEN bid <= 0 OR ask >= 1 THEN 'one_sided' WHEN bid >= ask THEN 'crossed' ELSE 'valid' END AS state FROM candles),
q AS (SELECT *, CASE WHEN state = 'valid' THEN (bid + ask) / 2 END AS mid, CASE WHEN state = 'valid' THEN ask - bid END AS spread FROM states)"""


def events_sql(staggered: bool = False) -> str:
    """More of them: grid, cand (candidates with status), ev (labelled events)."""
    return (
        panel_sql(staggered)
        + """,
grid AS (SELECT market_ticker, event_group, series, open_ts, close_ts, unnest(range(CAST(ceil(open_ts / 14400e0) AS BIGINT) * 14400, close_ts, 14400)) AS t0 FROM markets),
c0 AS (SELECT g.*, g.t0 + 14400 AS t_end, CASE WHEN q.ts IS NULL THEN 'no_quote' WHEN g.t0 - q.ts > 7200 THEN 'stale' ELSE q.state END AS s0,
  q.mid AS m0, q.spread AS w0, (g.t0 - q.ts) / 3600e0 AS a0 FROM grid g ASOF LEFT JOIN q ON g.market_ticker = q.market_ticker AND g.t0 >= q.ts),
c1 AS (SELECT g.*, CASE WHEN q.ts IS NULL THEN 'no_quote' WHEN g.t_end - q.ts > 7200 THEN 'stale' ELSE q.state END AS s1,
  q.mid AS m1, q.spread AS w1, (g.t_end - q.ts) / 3600e0 AS a1 FROM c0 g ASOF LEFT JOIN q ON g.market_ticker = q.market_ticker AND g.t_end >= q.ts),
cand AS (SELECT *, CASE WHEN t_end > close_ts - 14400 THEN 'near_close' WHEN s0 <> 'valid' THEN 't0_' || s0 WHEN s1 <> 'valid' THEN 'end_' || s1
  WHEN greatest(w0, w1) > 0.5e0 THEN 'wide_spread' ELSE 'event' END AS status FROM c1),
ev AS (SELECT market_ticker, event_group, series, open_ts, close_ts, t0, t_end, m0 AS mid_t0, m1 AS mid_end, m1 - m0 AS dmid, w0 AS spread_t0, w1 AS spread_end, a0, a1,
  CASE WHEN m1 - m0 > 0.1e0 THEN 'UP' WHEN m1 - m0 < -0.1e0 THEN 'DOWN' ELSE 'FLAT' END AS label FROM cand WHERE status = 'event')"""
    )


def featured_sql(staggered: bool = False) -> str:
    """More of them: valid (valid candles), fx (events with all price features and fit)."""
    last = lambda h, age: (
        f"l{h} AS (SELECT e.market_ticker, e.t0, CASE WHEN e.t0 - {h * 3600} - v.ts <= {age * 3600} THEN v.mid END AS m "
        f"FROM ev e ASOF LEFT JOIN valid v ON e.market_ticker = v.market_ticker AND e.t0 - {h * 3600} >= v.ts)"
    )
    return (
        events_sql(staggered)
        + f""",
valid AS (SELECT * FROM q WHERE state = 'valid'),
{last(1, 2)}, {last(4, 4)}, {last(24, 24)},
o0 AS (SELECT e.market_ticker, e.t0, q.open_interest AS oi FROM ev e ASOF LEFT JOIN q ON e.market_ticker = q.market_ticker AND e.t0 >= q.ts),
o24 AS (SELECT e.market_ticker, e.t0, q.open_interest AS oi FROM ev e ASOF LEFT JOIN q ON e.market_ticker = q.market_ticker AND e.t0 - 86400 >= q.ts),
dayrows AS (SELECT e.market_ticker, e.t0, q.ts, q.mid, q.volume FROM ev e JOIN q ON q.market_ticker = e.market_ticker AND q.ts > e.t0 - 86400 AND q.ts <= e.t0),
dayvol AS (SELECT market_ticker, t0, sum(volume) AS vol, count(*) FILTER (volume > 0) AS act FROM dayrows GROUP BY ALL),
steps AS (SELECT market_ticker, t0, mid, mid - lag(mid) OVER (PARTITION BY market_ticker, t0 ORDER BY ts) AS step FROM dayrows WHERE mid IS NOT NULL),
dayvar AS (SELECT market_ticker, t0, count(*) AS n, stddev_pop(step) AS sd, max(mid) - min(mid) AS rng FROM steps GROUP BY ALL),
prev AS (SELECT market_ticker, t0, lag(t_end) OVER w AS pe, lag(label) OVER w AS pl FROM ev WINDOW w AS (PARTITION BY market_ticker ORDER BY t0)),
fx AS (SELECT ev.*, mid_t0 AS mid, spread_t0 AS spread, CASE WHEN mid_t0 <> 0 THEN spread_t0 / mid_t0 END AS rel_spread, abs(mid_t0 - 0.5e0) AS dist_from_half,
  mid_t0 - l1.m AS ret_1h, mid_t0 - l4.m AS ret_4h, mid_t0 - l24.m AS ret_24h,
  CASE WHEN pe <= ev.t0 THEN CASE pl WHEN 'DOWN' THEN -1e0 WHEN 'FLAT' THEN 0e0 ELSE 1e0 END END AS prev_label,
  CASE WHEN dayvar.n >= 3 THEN dayvar.sd END AS vol_24h, dayvar.rng AS range_24h, ln(1e0 + coalesce(vol, 0e0)) AS log_volume_24h,
  CAST(coalesce(act, 0) AS DOUBLE) AS active_hours_24h, o0.oi - o24.oi AS oi_change_24h, (ev.t0 - open_ts) / 3600e0 AS hours_since_open,
  (close_ts - ev.t0) / 3600e0 AS hours_to_close, ev.t_end <= {FIT_UNTIL} AS fit
  FROM ev LEFT JOIN l1 USING (market_ticker, t0) LEFT JOIN l4 USING (market_ticker, t0) LEFT JOIN l24 USING (market_ticker, t0)
  LEFT JOIN o0 USING (market_ticker, t0) LEFT JOIN o24 USING (market_ticker, t0) LEFT JOIN dayvol USING (market_ticker, t0)
  LEFT JOIN dayvar USING (market_ticker, t0) LEFT JOIN prev USING (market_ticker, t0))"""
    )


def sql_round(expr: str) -> str:
    return f"round({expr}, 6) + 0e0"
