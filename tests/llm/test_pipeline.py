"""The pipeline's stages on a small table with planted cases."""

from __future__ import annotations

import corpus_pipeline
import pytest

from pitpanel.llm import op2_decontaminate, op4_simhash


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("planted")
    english = "the and of is that with for this are was by from in to it on be "
    german = "der die und das ist nicht mit ein von zu auf sich den im dem "
    item = " ".join(f"question{k} answer{k}" for k in range(12))
    other = lambda k: " ".join(f"{w}{'abcdefgh'[k % 8]}" for w in english.split()) + f" number {'xyz'[k % 3]}{'pqrst'[k % 5]} " + english
    rows = [(k, other(k), "en", "s", 0) for k in range(20)]
    rows += [(100 + k, german * 3 + other(k + 3), "de", "s", 0) for k in range(5)]
    rows += [(200, other(1), "en", "s", 0), (201, other(1), "en", "s", 0)]  # copies of 1
    rows += [(300, item, "en", "s", 0), (301, english * 60 + item, "en", "s", 0)]  # contaminated, and a passage
    rows += [(400, english * 2 + "write to jane.doe@mail.example.com or +1 (743) 555-3824 today", "en", "s", 0)]
    rows += [(500, None, "en", "s", 0), (501, "12345 !!", "en", "s", 0)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, planted), name)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert {500, 501}.isdisjoint(kept["language"]) and len(kept["language"]) == 30
    assert {200, 201}.isdisjoint(kept["near_duplicates"]) and 1 in kept["near_duplicates"]
    assert 300 in kept["near_duplicates"] and 300 not in kept["decontamination"]
    assert "question3" not in kept["decontamination"][301]["text"] and kept["decontamination"][301]["n_chars"] == len(kept["decontamination"][301]["text"])
    text = kept["personal_data"][400]["text"]
    assert "[EMAIL]" in text and "[PHONE]" in text and "jane" not in text
    clean = [k for k in range(20) if k in kept["personal_data"]]
    assert all(kept["personal_data"][k]["text"] == kept["language"][k]["text"] for k in clean)


def test_run(spark, planted):
    out = corpus_pipeline.run(spark, planted)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.filter("n_tokens <= 0").count() == 0


def test_empty(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, planted).count() == 0


def test_near_copies_beyond_four_bits_go(spark):
    words = [f"w{k}" for k in range(100)]
    docs = [(k, " ".join(words[:at] + ["other"] + words[at + 1 :]), "en", "s", 0) for k, at in enumerate([20, 50, 80])]
    docs += [(9, " ".join(words[:50]) + " " + " ".join(f"v{k}" for k in range(50)), "en", "s", 0)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, "").collect()) == [0, 9]


def odd_table(spark, rows):
    """Documents among columns with dots, quotes and the names that stages use inside."""
    kind = "doc_id bigint, `a.b` string, text string, `_hits` array<array<int>>, `_whole` int, all int, row int, fp bigint, lang string, digest binary, bands int, source string, n_chars bigint, c0 int, `q``x` int"
    full = [(i, "dot", t, [[1, 2]], 1, 2, 3, 4, "en", b"x", 5, "s", len(t or ""), 6, 7) for i, t in rows]
    return spark.createDataFrame(full, kind)


def test_stages_take_any_columns_nulls_repeats_and_long_texts(spark, tmp_path, monkeypatch):
    english = "the and of is that with for this are was by from in to it on be "
    item = " ".join(f"question{k} answer{k}" for k in range(12))
    long = " ".join(f"{english}{k}" for k in range(75_000))
    rows = [(1, english * 3), (1, english * 3), (2, None), (2, None), (3, ""), (None, english + "other words here are told"), (4, long), (5, item), (6, english * 90 + item)]
    spark.createDataFrame([(1, item), (2, "some other words " * 9)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_table(spark, rows)
    columns, kind = docs.columns, docs.dtypes
    assert len(long) > 5_000_000
    monkeypatch.setattr(op2_decontaminate.clean, "__defaults__", (100,))  # several blocks
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns and docs.dtypes == kind
        left[name] = sorted(str(r["doc_id"]) for r in docs.collect())
    assert left["language"] == ["1", "1", "4", "5", "6", "None"]
    assert left["near_duplicates"] == ["1", "4", "5", "6", "None"]
    assert left["decontamination"] == left["personal_data"] == ["1", "4", "6", "None"]
    assert docs.filter("doc_id = 4").select("text").first()[0] == long and docs.select("`a.b`").distinct().collect() == [("dot",)]
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).filter("n_tokens > 1000000").count() == 1


def test_a_large_group_of_near_copies_takes_no_pairs_of_parts(spark):
    """Two large groups of near copies that share their bands, and one text between them."""
    words = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join(words[:k] + ["other"] + words[k + 1 :])) for k in range(5, 150)]
    docs += [(900, " ".join(f"v{k}" for k in range(200)))]
    table = odd_table(spark, docs)
    assert sorted(r["doc_id"] for r in op4_simhash.one_of_similar(table, limit=20).collect()) == [5, 900]
