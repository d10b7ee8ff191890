"""Queries of scores over a panel without labelled events, and over one with few."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from pitpanel.plans import compile as language
from pitpanel.plans import queries_files, queries_scores  # noqa: F401
from pitpanel.plans.catalog import QUERIES, SQL, panel_events
from pitpanel.plans.spec import col, node


def shortened(spark, sf_dir, folder, until):
    """The test tables' events up to a time, and DuckDB over them."""
    spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("ts") < F.lit(until).cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return str(folder), con


@pytest.fixture(scope="module")
def none(spark, sf_dir, tmp_path_factory):
    """Markets that close within hours of their start, so that no candidate is labelled."""
    made = shortened(spark, sf_dir, tmp_path_factory.mktemp("none"), "2024-01-01 04:00:00")
    assert panel_events(spark, made[0], True).count() == 0
    return made


def rows(spark, folder, name):
    return [tuple(r) for r in QUERIES[name](spark, folder).collect()]


def test_forest_without_folds(spark, none):
    df = QUERIES["ml3_forest_cross_validation"](spark, none[0])
    assert df.columns == ["market_ticker", "t0", "fold", "p_DOWN", "p_FLAT", "p_UP", "event_group", "label", "pred"] and df.count() == 0


def test_report_without_predictions(spark, none):
    assert rows(spark, none[0], "ml7_report") == [(n, 0.0, None, None) for n in ("model", "majority", "no_change", "momentum", "random")]


def test_search_without_folds(spark, none):
    found = rows(spark, none[0], "se1_search_run")
    assert [r[0] for r in found] == [0, 1] and {r[2:] for r in found} == {("rejected", "dm_too_few_blocks")}


def test_fitted_spec_without_folds(spark):
    events = spark.createDataFrame([], "market_ticker string, t0 bigint, mid double")
    folds = spark.createDataFrame([], "market_ticker string, t0 bigint, fold bigint, role string")
    made = language.evaluate_folds(node("zscore", col("mid")), events, folds, [], ["mid"])
    assert dict(made.dtypes)["value"] == "double" and made.count() == 0


def test_trial_without_folds(spark, none):
    assert rows(spark, none[0], "se2_candidate_trial") == [("dm_too_few_blocks", None, 1.0, 0.0)]


def test_gate_without_rows(spark, none):
    assert rows(spark, none[0], "st13_gate") == [("dm_too_few_blocks", None, 1.0, 1.0, 1.0)]


@pytest.fixture(scope="module")
def one(spark, sf_dir, tmp_path_factory):
    return shortened(spark, sf_dir, tmp_path_factory.mktemp("one"), "2024-01-02 00:00:00")


@pytest.fixture(scope="module")
def few(spark, sf_dir, tmp_path_factory):
    return shortened(spark, sf_dir, tmp_path_factory.mktemp("few"), "2024-01-08 00:00:00")


@pytest.mark.parametrize(
    ("name", "panel"),
    [
        ("st9_f1_bootstrap", "none"),
        ("ag12_kish", "none"), ("ag12_kish", "few"),
        ("st4_bartlett_hac", "none"), ("st4_bartlett_hac", "few"),
        ("st5_bartlett_within_groups", "none"), ("st5_bartlett_within_groups", "few"),
        ("st7_dm_test", "none"), ("st7_dm_test", "one"), ("st7_dm_test", "few"),
        ("st8_sign_flip", "none"), ("st8_sign_flip", "few"),
    ],
)
def test_same_as_sql(spark, request, name, panel):
    folder, con = request.getfixturevalue(panel)
    made = con.sql(SQL[name])
    digits = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    df = QUERIES[name](spark, folder).select(*made.columns)
    assert digits(map(tuple, df.collect())) == digits(made.fetchall())
