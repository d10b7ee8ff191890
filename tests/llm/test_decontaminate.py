"""Operator 2 against brute force."""

from __future__ import annotations

import hashlib
import re

from pitpanel.llm import op2_decontaminate as op
from pitpanel.llm import queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n, known in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
                    found |= known[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, queries.op2_decontaminate_benchmark(spark, sf_dir).collect()), key=str) == brute(docs, items)


def test_edges_blocks_and_cleaning(spark, make, edges):
    long_item = " ".join(f"w{k}" for k in range(20))
    items = [(1, long_item), (1, long_item), (2, "Short ITEM"), (None, "a"), (3, None), (4, "!?")]
    docs = [*edges, (10, "x " * 400 + long_item), (11, "see the short, item here"), (12, long_item), (13, ("W0-" + long_item[3:]).upper()), (14, "w0 w1 w2")]
    table, bench = make(docs), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    for limit in (op.LIMIT_BYTES, 60):
        assert sorted(map(tuple, op.digests(op.find(table, bench, limit_bytes=limit)).collect()), key=str) == want
    a, b = (sorted(map(tuple, op.clean(table, bench, limit).collect()), key=str) for limit in (op.LIMIT_BYTES, 60))
    assert a == b
    kept = {r[0]: r[1] for r in a}
    assert 12 not in kept and 13 not in kept and kept[14] == "w0 w1 w2" and kept[10] == "x " * 400
    long_doc = make([(20, "y " * 900 + long_item + " end")])
    assert op.clean(long_doc, bench).first()["text"] == "y " * 900 + " end"
    for empty in (make([]), table):
        assert op.digests(op.find(empty, bench.limit(0))).filter("n_hit > 0").count() == 0
    assert op.find(make([]), bench).count() == 0


def test_long_items_are_dealt_in_parts(make, spark, monkeypatch):
    monkeypatch.setattr(op, "ITEM_WORDS", 7)
    items = [(1, " ".join(f"w{k}" for k in range(60))), (2, " ".join(f"v{k}" for k in range(13))), (3, "some short one")]
    docs = [(k, f"x y {' '.join(f'w{j}' for j in range(k, k + 14))} z") for k in range(50)] + [(90, items[1][1] + " some short one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert op.items_of(bench, 10**6)[0].count() > 8
    for limit in (op.LIMIT_BYTES, 100):
        assert sorted(map(tuple, op.digests(op.find(make(docs), bench, limit_bytes=limit)).collect()), key=str) == brute(docs, items)


def test_query_equals_sql(spark, duck, sf_dir):
    ours = sorted(map(repr, map(tuple, queries.op2_decontaminate_benchmark(spark, sf_dir).collect())))
    assert ours == sorted(map(repr, duck.sql(op.SQL).fetchall()))
