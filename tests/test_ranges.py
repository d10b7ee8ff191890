"""Orders of whole tables, plain text of HTML, and the sides of a cutoff."""

from __future__ import annotations

from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.functions.text import plain
from pitpanel.operators import inference as I
from pitpanel.operators import ranges


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 3, 5000), 2)
    x[:1700] = 0.5  # a hot value
    return pd.DataFrame({"x": rng.permutation(x), "id": np.arange(5000)})


def test_quantiles_are_exact(spark, values):
    rows = spark.createDataFrame(values).withColumn("x", F.when(F.col("id") % 97 == 0, None).otherwise(F.col("x")))
    kept = values[values["id"] % 97 != 0]["x"]
    wanted = {f"q{k}": q for k, q in enumerate([0.0, 0.01, 0.25, 0.5, 0.85, 0.999, 1.0])}
    got = ranges.quantiles(rows, F.col("x"), wanted).first().asDict()
    assert got == {k: pytest.approx(np.quantile(kept, q), abs=1e-12) for k, q in wanted.items()}
    assert ranges.quantiles(rows.filter("id % 97 = 0"), F.col("x"), {"q": 0.5}).first()[0] is None


def test_places_and_running_sums(spark, values):
    rows = spark.createDataFrame(values)
    got = ranges.numbered(rows, "x", ["id"], "at", "n").toPandas().sort_values("at")
    want = values.sort_values(["x", "id"])
    assert got["at"].tolist() == list(range(5000)) and got["id"].tolist() == want["id"].tolist() and set(got["n"]) == {5000}
    sums = ranges.running(rows.groupBy("x").agg(F.sum("id").alias("w")), "x", ["w"]).toPandas().sort_values("x")
    by = values.groupby("x")["id"].sum()
    assert sums["w_before"].tolist() == (by.cumsum() - by).tolist() and set(sums["w_all"]) == {by.sum()}


def test_later_minima_and_q_values(spark):
    rng = np.random.default_rng(8)
    p = np.round(rng.random(400) ** 2, 3)
    rows = spark.createDataFrame(pd.DataFrame({"id": range(400), "p": p}))
    got = I.benjamini_hochberg(rows).toPandas().sort_values("id")
    assert got["q"].tolist() == pytest.approx(I.q_values(p.tolist()), abs=1e-12)


def test_draws_agree_with_theory(spark):
    """Signs are fair, weights Poisson, offsets in bounds; another seed gives other draws."""
    names = spark.createDataFrame([(f"g{k}",) for k in range(60)], "name string")
    signs = I.signs(names, 1, "group", 500).toPandas()
    assert len(signs) == 30_000 and abs(signs["sign"].mean()) < 0.03 and set(signs["sign"]) == {-1, 1}
    other = I.signs(names, 2, "group", 500).toPandas().sort_values(["name", "draw"])
    assert (signs.sort_values(["name", "draw"])["sign"].to_numpy() != other["sign"].to_numpy()).mean() == pytest.approx(0.5, abs=0.03)
    w = I.poisson(names, 1, "boot", 500).toPandas()["weight"]
    assert len(w) == 30_000 and w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.05) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.02)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("a &eacute; &#8217; &#x41; &amp;lt;", "a é ’ A &lt;"), ("<p>One <b> two</b></p>\n<p>three</p>", "One two three"),
        ("x<script>if (a < b) { '</p>' }</script>y<style>p{}</style>z", "x y z"), ("a<!-- <p>no</p> -->b<br/>c", "a b c"), ("1 < 2 &copy", "1 < 2 ©"), ("<SCRIPT>x</SCRIPT >ok", "ok"),
    ],
)
def test_plain_text_of_html(html, text):
    assert plain(html) == text


def test_cutoffs(spark):
    assert I.epoch(5) == 5 and I.epoch("1970-01-01T00:01:00") == I.epoch("1970-01-01T01:01:00+01:00") == I.epoch(datetime(1970, 1, 1, 0, 1, tzinfo=UTC)) == 60
    rng = np.random.default_rng(1)
    n = 800
    p = rng.dirichlet([2, 4, 2], (2, n))
    df = pd.DataFrame({"event_group": [f"g{k % 40}" for k in range(n)], "t0": 86_400 * (10 + np.arange(n) % 100), "label": rng.choice(["DOWN", "FLAT", "UP"], n)})
    for side, made in zip("rp", p):
        for k, label in enumerate(("DOWN", "FLAT", "UP")):
            df[f"{side}_{label}"] = made[:, k]
    scored = spark.createDataFrame(df)
    cutoff = "1970-03-02"  # the start of day 60
    counts = {r["side"]: r["n"] for r in I.cutoff_split(scored, cutoff).collect()}
    tests = I.cutoff_tests(scored, cutoff)
    assert counts == {"before": int((df["t0"] < 86_400 * 60).sum()), "after": int((df["t0"] >= 86_400 * 60).sum())}
    assert {side: t["n_events"] for side, t in tests.items()} == counts and all(0 <= t["dm_p"] <= 1 for t in tests.values())
