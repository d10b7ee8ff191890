"""Queries of the feature language: every operator with all of its parameters."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.plans import compile as language
from pitpanel.plans.catalog import QUERIES, SQL, featured, featured_sql, query, r, sql_round
from pitpanel.plans.registry import OPS
from pitpanel.plans.spec import Spec, col, node
from pitpanel.sources.storage import materialised

X, Y = "mid", "ret_4h"
#: Numbers of the operators in the survey.
ORDER = [
    "slog", "square", "abs", "sign", "logit", "add", "sub", "mul", "ratio", "min", "max", "gate_pos", "hour_of_day", "day_of_week", "lag", "diff", "roll",
    "roll_z", "ewm", "hours_since_prev_event", "n_prev_events", "xs_rank", "xs_dev", "zscore", "qrank", "winsor", "group_dev", "gate_q", "series_freq", "series_target",
]


def variants(name: str) -> dict[str, Spec]:
    """Column name -> spec, for every choice of an operator's parameters."""
    op = OPS[name]
    args = [col(c) for c in ((Y, X) if op.arity == 2 else (Y,))[: op.arity]]
    out = {}
    for values in product(*op.params.values()):
        chosen = dict(zip(op.params, values))
        label = "_".join([name, *(str(v).replace(".", "p") for v in values)])
        out[f"v_{label}"] = node(name, *args, **chosen)
    return out


def values(spark: SparkSession, sf_dir: str, specs: dict[str, Spec], staggered: bool) -> DataFrame:
    fit = "fit" if any(s.needs_fit for s in specs.values()) else None
    rows = featured(spark, sf_dir, staggered)
    if fit or any(OPS[s.op].step for s in specs.values()):
        rows = materialised(rows)  # every statistic reads them
    c = language.Compiler(rows, fit, [X, Y], include_cross=True)
    made = {label: c.add(spec) for label, spec in specs.items()}
    return c.df.select("market_ticker", "t0", *(r(name).alias(label) for label, name in made.items()))


# -- SQL of each operator, over fx --

_M = "OVER (PARTITION BY market_ticker ORDER BY t0)"
_ROW = {
    "slog": f"sign({Y}) * ln(1e0 + abs({Y}))",
    "square": f"{Y} * {Y}",
    "abs": f"abs({Y})",
    "sign": f"CAST(sign({Y}) AS DOUBLE)",
    "logit": f"CASE WHEN {Y} BETWEEN 0 AND 1 THEN ln(greatest(least({Y}, 0.99e0), 0.01e0) / (1 - greatest(least({Y}, 0.99e0), 0.01e0))) END",
    "add": f"{Y} + {X}",
    "sub": f"{Y} - {X}",
    "mul": f"{Y} * {X}",
    "ratio": f"CASE WHEN abs({X}) >= 1e-9 THEN {Y} / {X} END",
    "min": f"CASE WHEN {X} IS NOT NULL AND {Y} IS NOT NULL THEN least({X}, {Y}) END",
    "max": f"CASE WHEN {X} IS NOT NULL AND {Y} IS NOT NULL THEN greatest({X}, {Y}) END",
    "gate_pos": f"CASE WHEN {X} IS NOT NULL THEN CASE WHEN {X} > 0 THEN {Y} ELSE 0e0 END END",
    "hour_of_day": "CAST((t0 // 3600) % 24 AS DOUBLE)",
    "day_of_week": "CAST((t0 // 86400 + 3) % 7 AS DOUBLE)",
    "hours_since_prev_event": f"(t0 - lag(t0) {_M}) / 3600e0",
    "n_prev_events": f"CAST(row_number() {_M} - 1 AS DOUBLE)",
}


def _window_sql(name: str, p: dict) -> str:
    if name == "lag":
        return f"lag({Y}, {p['k']}) {_M}"
    if name == "diff":
        return f"{Y} - lag({Y}, {p['k']}) {_M}"
    frame = f"OVER (PARTITION BY market_ticker ORDER BY t0 ROWS BETWEEN {p.get('w')} PRECEDING AND 1 PRECEDING)"
    if name == "roll":
        return {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}[p["stat"]] + f"({Y}) {frame}"
    if name == "roll_z":
        return f"CASE WHEN count({Y}) {frame} >= 3 AND stddev_samp({Y}) {frame} > 1e-9 THEN ({Y} - avg({Y}) {frame}) / stddev_samp({Y}) {frame} END"
    peers = "PARTITION BY t0" if p["scope"] == "all" else f"PARTITION BY {p['scope']}, t0"
    if name == "xs_dev":
        return f"CASE WHEN count({Y}) OVER ({peers}) >= 2 THEN {Y} - avg({Y}) OVER ({peers}) END"
    rank = f"rank() OVER ({peers} ORDER BY {Y} NULLS LAST) + (count({Y}) OVER ({peers}, {Y}) - 1) / 2e0"
    return f"CASE WHEN {Y} IS NOT NULL AND count({Y}) OVER ({peers}) >= 2 THEN ({rank} - 0.5e0) / count({Y}) OVER ({peers}) END"


def _fold_sql(name: str, p: dict) -> str:
    """A scalar expression over fx with correlated statistics of the rows to fit on."""
    f = "FROM fx f WHERE f.fit"
    if name == "zscore":
        return f"CASE WHEN (SELECT count({Y}) {f}) >= 2 THEN ({Y} - (SELECT avg({Y}) {f})) / (SELECT stddev_pop({Y}) {f}) END"
    if name == "winsor":
        return f"CASE WHEN {Y} IS NOT NULL THEN least(greatest({Y}, (SELECT quantile_cont({Y}, {p['q']}) {f})), (SELECT quantile_cont({Y}, {1 - p['q']}) {f})) END"
    if name == "gate_q":
        sign = ">" if p["side"] == "above" else "<="
        return f"CASE WHEN {X} IS NOT NULL THEN CASE WHEN {X} {sign} (SELECT quantile_cont({X}, {p['q']}) {f}) THEN {Y} ELSE 0e0 END END"
    if name == "qrank":
        return f"CASE WHEN {Y} IS NOT NULL THEN (SELECT sum(CASE WHEN f.{Y} < fx.{Y} THEN 1e0 WHEN f.{Y} = fx.{Y} THEN 0.5e0 ELSE 0e0 END) {f} AND f.{Y} IS NOT NULL) / (SELECT count({Y}) {f}) END"
    if name == "group_dev":
        same = "f.series = fx.series" if p["by"] == "series" else "(f.t0 // 3600) % 24 = (fx.t0 // 3600) % 24"
        return f"{Y} - (SELECT avg(f.{Y}) {f} AND {same})"
    if name == "series_freq":
        return f"(SELECT count(*) {f} AND f.series = fx.series) / (SELECT count(*)::DOUBLE {f})"
    y = {"up": "(f.label = 'UP')::INT", "down": "(f.label = 'DOWN')::INT", "move": "(f.label <> 'FLAT')::INT"}.get(p["stat"], "(f.label = 'UP')::INT - (f.label = 'DOWN')::INT")
    done = f"{f} AND f.t_end <= fx.t0"
    own = f"{done} AND f.series = fx.series"
    return f"(coalesce((SELECT sum({y}) {own}), 0) + {p['m']} * (SELECT avg({y}) {done})) / ((SELECT count(*) {own}) + {p['m']})"


def _ewm_sql(p: dict) -> str:
    terms = "FROM n b WHERE b.market_ticker = fx.market_ticker AND b.i < n.i AND b.y IS NOT NULL"
    decay = f"pow(0.5e0, (n.i - 1 - b.i) / {p['halflife']}e0)"
    return f"(SELECT sum(b.y * {decay}) / sum({decay}) {terms})"


def _sql(name: str, staggered: bool) -> str:
    columns = []
    for label, spec in variants(name).items():
        p = dict(spec.params)
        if name in _ROW:
            expr = _ROW[name]
        elif name == "ewm":
            expr = _ewm_sql(p)
        elif OPS[name].kind == "fold":
            expr = _fold_sql(name, p)
        else:
            expr = _window_sql(name, p)
        columns.append(f"{sql_round(expr)} AS {label}")
    extra = f", n AS (SELECT market_ticker, t0, {Y} AS y, row_number() {_M} AS i FROM fx)" if name == "ewm" else ""
    source = "fx JOIN n ON n.market_ticker = fx.market_ticker AND n.t0 = fx.t0" if name == "ewm" else "fx"
    return f"WITH {featured_sql(staggered)}{extra} SELECT fx.market_ticker, fx.t0, {', '.join(columns)} FROM {source}"


def _register() -> None:
    for number, name in enumerate(ORDER, 1):
        staggered = OPS[name].kind == "fold"
        label = f"g{number:02d}_{name}"

        def made(spark: SparkSession, sf_dir: str, name: str = name, staggered: bool = staggered) -> DataFrame:
            return values(spark, sf_dir, variants(name), staggered)

        QUERIES[label] = made
        SQL[label] = _sql(name, staggered)


_register()


@query("g33_nested_spec", f"WITH {featured_sql()}, a AS (SELECT *, {Y} - lag({Y}, 1) {_M} AS d, stddev_samp({Y}) OVER (PARTITION BY market_ticker ORDER BY t0 ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS s FROM fx) SELECT market_ticker, t0, {sql_round('sign(CASE WHEN abs(s) >= 1e-9 THEN d / s END) * ln(1e0 + abs(CASE WHEN abs(s) >= 1e-9 THEN d / s END))')} AS value FROM a")
def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = node("slog", node("ratio", node("diff", col(Y), k=1), node("roll", col(Y), stat="std", w=6)))
    out = language.evaluate(spec, featured(spark, sf_dir), columns=[X, Y])
    return out.select("market_ticker", "t0", r("value").alias("value"))


_STATS = f"""SELECT count({Y}) AS n, {sql_round(f'avg({Y})')} AS mean, {sql_round(f'stddev_pop({Y})')} AS std, {sql_round(f'quantile_cont({Y}, 0.05)')} AS q05, {sql_round(f'quantile_cont({Y}, 0.95)')} AS q95 FROM fx WHERE fit"""


@query("ag15_fit_statistics", f"WITH {featured_sql(True)} {_STATS}")
def ag15(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = featured(spark, sf_dir, True).filter("fit")
    q = {name: F.percentile(Y, F.lit(p)) for name, p in (("q05", 0.05), ("q95", 0.95))}
    return fitted.agg(F.count(Y).alias("n"), r(F.avg(Y)).alias("mean"), r(F.stddev_pop(Y)).alias("std"), *(r(c).alias(n) for n, c in q.items()))


@query("g34_duplicate_keys", f"WITH {featured_sql()} SELECT market_ticker, t0, count(*) AS n FROM fx GROUP BY ALL HAVING count(*) > 1")
def g34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).groupBy("market_ticker", "t0").agg(F.count("*").alias("n")).filter("n > 1")
