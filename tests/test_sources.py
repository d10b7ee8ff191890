"""Sources, sinks, the hold-out's gateway, text functions and streams."""

from __future__ import annotations

import gzip
import json
import os
from datetime import datetime, timedelta


import pytest
from pyspark.sql import functions as F

from pitpanel.functions import text as X
from pitpanel.operators import asof, labels
from pitpanel.plans.catalog import panel
from pitpanel.sources import candles, files, http, manifest
from pitpanel.streaming import quotes

# A candle of each dialect.
OLD = {"end_period_ts": 1708142400, "open_interest": "120", "volume": "0", "price": {"open": None, "high": None, "low": None, "close": None}, "yes_bid": {"open": "0.0000", "high": "0.0000", "low": "0.0000", "close": "0.0000"}, "yes_ask": {"open": "0.2100", "high": "0.2100", "low": "0.2100", "close": "0.2100"}}
NEW = {"end_period_ts": 1708142400, "open_interest_fp": "120.00", "volume_fp": "35.00", "price": {"close_dollars": "0.4400"}, "yes_bid": {"close_dollars": "0.4300"}, "yes_ask": {"close_dollars": "0.4500"}}


def parsed(spark, candle, source):
    rows = spark.createDataFrame([(json.dumps(candle), source)], "json string, source string")
    return candles.parse(rows, "json", "source").first()


def test_dialects(spark):
    old = parsed(spark, OLD, "historical")
    assert (old["ask_close"], old["bid_close"], old["price_close"], old["volume"]) == (0.21, 0.0, None, 0.0)
    new = parsed(spark, NEW, "live")
    assert (new["bid_close"], new["ask_close"], new["price_close"], new["volume"], new["open_interest"]) == (0.43, 0.45, 0.44, 35.0, 120.0)
    wrong = parsed(spark, NEW, "historical")
    assert wrong["bid_close"] is None and wrong["volume"] is None


def test_market_files(spark, tmp_path):
    folder = tmp_path / "candles" / "S"
    folder.mkdir(parents=True)
    later = json.loads(json.dumps(OLD))
    later["yes_ask"]["close"] = "0.3000"
    for name, rows in (("M-1__a", [OLD, OLD]), ("M-1__b", [later]), ("M-2__a", [OLD])):
        files.write_gzip_json(str(folder / f"{name}.json.gz"), {"candlesticks": rows})
    out = {r["market_ticker"]: r["ask_close"] for r in candles.read_market_candles(spark, str(tmp_path)).collect()}
    assert out == {"M-1": 0.30, "M-2": 0.21}


def test_same_value_same_bytes(tmp_path):
    for name in "ab":
        files.write_gzip_json(str(tmp_path / name), {"x": 1, "a": [None, "é"]})
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
    assert json.loads(gzip.decompress((tmp_path / "a").read_bytes())) == {"x": 1, "a": [None, "é"]}
    files.replace_json(str(tmp_path / "r.json"), {"k": 1})
    files.replace_json(str(tmp_path / "r.json"), {"k": 2})
    assert json.loads((tmp_path / "r.json").read_text()) == {"k": 2} and len(os.listdir(tmp_path)) == 3


def test_keyed_arrays_and_lists(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"q|a|b": [{"title": "t", "url": "u"}], "none": []}))
    out = files.read_keyed_arrays(spark, str(tmp_path / "k.json")).collect()
    assert [(r["key"], r["place"], r["item"]["url"]) for r in out] == [("q|a|b", 0, "u")]
    (tmp_path / "l.txt").write_text("# no\nA\n\n  B \n")
    assert sorted(r[0] for r in files.read_list(spark, str(tmp_path / "l.txt")).collect()) == ["A", "B"]


def test_manifest_and_gateway(spark, tmp_path):
    data = tmp_path / "sealed"
    spark.range(5).coalesce(1).write.parquet(str(data))
    manifest.record(spark, str(data), str(tmp_path / "m"), "test", {"k": "v"})
    entries = spark.read.schema(manifest.ENTRY).json(str(tmp_path / "m")).withColumn("seq", F.monotonically_increasing_id())
    assert {r["status"] for r in manifest.verify(entries, manifest.digests(spark, str(data))).collect()} == {"ok"}
    part = next(p for p in data.iterdir() if p.suffix == ".parquet")
    part.write_bytes(part.read_bytes() + b"x")
    (data / f".{part.name}.crc").unlink()
    found = {r["path"].rpartition("/")[2]: r["status"] for r in manifest.verify(entries, manifest.digests(spark, str(data))).collect()}
    assert found[part.name] == "mismatch"
    with pytest.raises(ValueError):
        manifest.read_sealed(spark, str(data), "short", str(tmp_path / "log"))
    for path in (data, data / "x", tmp_path / "events_index.parquet"):
        with pytest.raises(manifest.SealedError):
            manifest.guard(str(path), str(data))
    clean = tmp_path / "other"
    spark.range(3).write.parquet(str(clean))
    assert manifest.read_sealed(spark, str(clean), "to confirm the result", str(tmp_path / "log")).count() == 3
    assert json.loads((tmp_path / "log").read_text())["reason"] == "to confirm the result"


def test_quota_and_retries(tmp_path):
    day = ["2024-01-01"]
    quota = http.Quota(2, 2, str(tmp_path / "q"), lambda: day[0])
    assert [quota.take() for _ in range(4)] == [0, 1, 0, 1]
    with pytest.raises(http.QuotaExhausted):
        quota.take()
    day[0] = "2024-01-02"
    assert quota.take() == 0
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return {"ok": 1}

    assert http.with_retries(call, sleep=waits.append) == {"ok": 1} and waits == [1.0, 2.0]


def test_pages_as_a_source(spark):
    def fetch(url, params):
        n = int(params.get("cursor") or 0)
        return {"rows": [{"series": params["series"], "n": n}], "cursor": str(n + 1) if n < 2 else ""}

    out = http.read_pages(spark, fetch, "http://x", "rows", [{"series": "A"}, {"series": "B"}])
    assert out.rdd.getNumPartitions() == 2
    assert sorted((json.loads(r["item"])["series"], json.loads(r["item"])["n"]) for r in out.collect()) == [(s, n) for s in "AB" for n in range(3)]
    stopped = list(http.pages(fetch, "http://x", {"series": "A"}, "rows", stop=lambda rows: rows[0]["n"] == 1))
    assert len(stopped) == 2


def test_points_of_quotes(spark):
    rows = [(0.40, 0.42, "valid"), (0.0, 0.42, "one_sided"), (0.40, 1.0, "one_sided"), (0.45, 0.42, "crossed"), (None, 0.42, "no_quote"), (0.0, None, "no_quote")]
    out = spark.createDataFrame(rows, "bid double, ask double, want string").withColumn("got", asof.quote_state(F.col("bid"), F.col("ask")))
    assert out.filter("got <> want").count() == 0
    facts = spark.createDataFrame([("m", 100, 1.0), ("m", 200, 2.0), ("n", 50, 9.0)], "k string, ts bigint, x double")
    probes = spark.createDataFrame([("m", 99), ("m", 100), ("m", 199), ("m", 5000), ("q", 10)], "k string, at bigint")
    want = {("m", 99): None, ("m", 100): 1.0, ("m", 199): 1.0, ("m", 5000): 2.0, ("q", 10): None}
    for bucket in (None, 60, 1000):
        got = asof.asof(probes, facts, "k", "at", "ts", ["x"], bucket)
        assert {(r["k"], r["at"]): r["fact"]["x"] if r["fact"] else None for r in got.collect()} == want


def test_article_window(spark):
    events = spark.createDataFrame([("m", 100_000)], "market_ticker string, t0 bigint")
    times = {"a": -60, "b": 0, "c": 60, "d": -21_601, "e": -21_600}
    articles = spark.createDataFrame([("m", u, 100_000 + t) for u, t in times.items()], "market_ticker string, url string, ts bigint")
    out = asof.in_window(events, articles, "market_ticker", "t0", "ts", 21_600)
    assert sorted(r["url"] for r in out.collect()) == ["a", "e"]


def test_attrition_adds_up(spark, sf_dir):
    counts = {r["status"]: r["n"] for r in labels.attrition(labels.candidates(*panel(spark, sf_dir), labels.PANEL)).collect()}
    assert counts.pop("candidates") == sum(counts.values()) and counts["event"] > 0


def test_text(spark):
    row = spark.createDataFrame([("Will the Fed cut rates in 2024?", "Economics"), ("Up?", ""), (None, None)], "t string, c string")
    out = [r[0] for r in row.select(X.keywords(F.col("t"), F.col("c"))).collect()]
    assert out == [["Fed cut", "cut rates", "Economics"], [], []]
    assert X.scrub_text("KXINX-26SEP18 on 2024-05-01, March 14 1999s") == "[redacted] on [redacted], [redacted] [redacted]"
    html = spark.createDataFrame([("<p>a &amp; b<script>x</script></p><!-- c -->", "t"), ("", "<b>trail</b>")], "b string, t string")
    assert [r[0] for r in html.select(X.article_text(F.col("b"), F.col("t"))).collect()] == ["a & b", "trail"]


def test_streams(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [("m", base + timedelta(minutes=m), k, x) for m, k, x in ((0, "quote", 0.4), (30, "probe", None), (200, "probe", None), (210, "quote", 0.6), (211, "probe", None))]
    rows.append(("n", base, "probe", None))
    schema = "market_ticker string, at timestamp, kind string, mid double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = quotes.last_quotes(stream, 7200).writeStream.format("memory").queryName("last_quotes").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    got = sorted((r["market_ticker"], r["state"], r["mid"]) for r in spark.sql("select * from last_quotes").collect() if r["mid"] is not None)
    states = sorted((r["market_ticker"], r["state"]) for r in spark.sql("select * from last_quotes").collect())
    assert got == [("m", "valid", 0.4), ("m", "valid", 0.6)] and states == [("m", "stale"), ("m", "valid"), ("m", "valid"), ("n", "no_quote")]
    trades = stream.select("market_ticker", F.col("at").alias("ts"), F.lit(0.5).alias("p"))
    run = quotes.hourly_candles(trades, "1 minute").writeStream.format("memory").queryName("hours").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert spark.sql("select * from hours").count() >= 1
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).select("market_ticker", F.col("at").alias("t0"))
    news = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).select("market_ticker", F.col("at").alias("published"), F.lit("u").alias("url"))
    run = quotes.articles_before(events, news).writeStream.format("memory").queryName("before").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert spark.sql("select * from before").count() == 10
