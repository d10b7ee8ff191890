"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import math

import pytest

import __spark_entry__
from pitpanel.operators import splits
from pitpanel.plans import queries_scores
from pitpanel.plans.catalog import QUERIES, SQL

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return v if v is None else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = plain(map(tuple, df.select(*(f"`{c}`" for c in columns)).collect()))
    made = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    assert columns == sorted(duck.sql(SQL[name]).columns)
    assert [TYPES[t] for t in (dict(df.dtypes)[c] for c in columns)] == list(map(str, made.types))
    assert ours == plain(made.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"ml6_cross_validation", "ml3_forest_cross_validation", "se2_candidate_trial"}))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_forest_is_validated_on_all_folds(spark, sf_dir, monkeypatch):
    given = {}
    monkeypatch.setattr(queries_scores.model, "cross_validate", lambda rows, folds, *args, **kw: given.update(rows=rows, folds=folds))
    queries_scores.ml3(spark, sf_dir)
    want = {r[0] for r in splits.walk_forward(given["rows"]).select("fold").distinct().collect()}
    assert max(want) > 2 and {r[0] for r in given["folds"].select("fold").distinct().collect()} == want
