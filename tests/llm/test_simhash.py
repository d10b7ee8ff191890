"""Operator 4 against brute force."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from pitpanel.llm import op4_simhash as op
from pitpanel.llm import queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(codes):
    u = np.unique(codes)
    label = np.arange(len(u))
    for k in range(len(u)):
        near = np.flatnonzero(np.bitwise_count(u[k] ^ u) <= 4)
        for x in np.unique(label[near]):
            label[label == x] = label[near].min()
    return u, label


def brute(docs):
    codes = np.array([fingerprint(t) for _, t in docs], np.uint64)
    u, label = classes(codes)
    own = label[np.searchsorted(u, codes)]
    least = {}
    for (d, _), c in zip(docs, own.tolist()):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted(((d, f"{int(f):016x}", least.get(c)) for (d, _), f, c in zip(docs, codes, own.tolist())), key=str)


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op4_simhash_groups(spark, sf_dir).collect()), key=str) == brute(docs)


def test_edges(make, edges):
    docs = [*edges, (30, "one two three"), (31, "ONE two\tthree"), (32, "one two three four five"), (33, "x " * 5000)]
    assert sorted(map(tuple, op.near_duplicates(make(docs)).collect()), key=str) == brute(docs)
    assert op.near_duplicates(make([])).count() == 0


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"word{k % 97}" for k in range(3000))
    whole = op.fingerprint(text)
    monkeypatch.setattr(op, "PIECE", 500)
    assert op.fingerprint(text) == whole == np.uint64(fingerprint(text)).view(np.int64)


def clusters(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for base in rng.integers(0, 2**63, n, dtype=np.uint64):
        for _ in range(40):
            code = base
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                code ^= np.uint64(1) << np.uint64(k)
            out.append(code)
    return np.unique(np.array(out, np.uint64))


def test_index_finds_every_pair():
    codes = clusters(20, 1)
    q, found = op.GrayIndex(codes).search(codes, 4)
    want = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
    got = np.zeros_like(want)
    got[q, found] = True
    assert (got == want).all()


def test_large_groups_are_cut_without_losing_links(spark):
    codes = clusters(25, 2)
    u, label = classes(codes)
    want = {}
    for code, c in zip(u.view(np.int64).tolist(), label.tolist()):
        want.setdefault(c, set()).add(code)
    table = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp bigint")
    for group in (4096, 6):
        got = {}
        for fp, root in op.classes(table, group=group).collect():
            got.setdefault(root, set()).add(fp)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_plans_by_size_cover_all_links():
    assert op.plan(1000, 4) == (5, 1) and op.plan(10**9, 4)[1] >= 2 and op.plan(10**11, 4)[1] >= 3


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 99)], "u bigint, v bigint")
    assert {r[0]: r[1] for r in op.components(chain).collect()} == {k: 0 for k in range(1, 61)} | {100: 99}


def test_a_large_group_is_dealt_again(spark):
    """50,000 codes that agree on their upper 13 bits, with links planted among them."""
    rng = np.random.default_rng(7)
    codes = np.unique(rng.integers(0, 2**51, 45_000, dtype=np.uint64))
    links = [(c, c ^ np.uint64(1 << k) ^ np.uint64(1 << (k + 9))) for k, c in enumerate(codes[:40])]
    every = np.unique(np.concatenate([codes, [b for _, b in links], np.arange(5000, dtype=np.uint64) << np.uint64(30)])).view(np.int64)
    table = spark.createDataFrame([(c,) for c in every.tolist()], "fp bigint")
    largest = op.dealt_by(table, op.choices(5, 1), 4, 4096).groupBy("choice", "bits", "part", "other").count().agg({"count": "max"}).first()[0]
    assert len(every) > 49_000 and largest <= 4096
    roots = dict(op.classes(table).collect())
    assert all(roots[int(a)] == roots[int(b)] for a, b in links)


def test_blocks_of_further_bits_cover_every_small_difference():
    rng = np.random.default_rng(1)
    for mask in op.choices(5, 1) + op.choices(6, 2):
        finer = op.further(mask, 4)
        for _ in range(50):
            rest = [k for k in range(64) if not mask >> k & 1]
            apart = sum(1 << int(k) for k in rng.choice(rest, 4, replace=False))
            assert any(not apart & m for m in finer) and all(m & mask == mask for m in finer)


def jaccard(a, b, size=5):
    one, two = ({tuple(t.split()[k : k + size]) for k in range(len(t.split()) - size + 1)} for t in (a, b))
    return len(one & two) / len(one | two)


def near_copies(bases=40, seed=3):
    """Texts of 60 to 200 words and copies of them with one to four words changed, by id."""
    rng = np.random.default_rng(seed)
    docs = []
    for k in range(bases):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 200))]
        docs.append((10 * k, " ".join(words)))
        for n in range(1, 5):
            other = list(words)
            for at in rng.choice(len(words), n, replace=False):
                other[at] = f"changed{n}{at}"
            docs.append((10 * k + n, " ".join(other)))
    return docs


def least_similar(docs):
    """Ids that stay, by brute force: links at 0.8 of five-word shingles."""
    label = {d: d for d, _ in docs}
    for k, (a, x) in enumerate(docs):
        for b, y in docs[k + 1 :]:
            if a // 10 == b // 10 and jaccard(x, y) >= 0.8:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if c == old else c for d, c in label.items()}
    return sorted(set(label.values()))


def test_similar_texts_leave_one(make):
    docs = near_copies()
    want = least_similar(docs)
    assert 40 <= len(want) < 100
    for limit in (op.TEXTS, 2):
        assert sorted(r["doc_id"] for r in op.one_of_similar(make(docs), limit=limit).collect()) == want


def test_similar_edges(make, edges):
    docs = [(30, "one two three"), (31, "ONE two\tthree"), (32, "one two three four"), (None, "one two three"), *edges]
    kept = op.one_of_similar(make(docs)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "30", "32", "4", "6"] and kept[0].__fields__ == make(docs).columns
    assert op.one_of_similar(make([])).count() == 0


def test_similar_in_pieces(monkeypatch):
    text = " ".join(f"word{k % 97}" for k in range(3000))
    whole = op.shingles(text, 5)
    monkeypatch.setattr(op, "PIECE", 500)
    assert len(whole) == 2996 and (op.shingles(text, 5) == whole).all()


def test_similar_texts_are_found_by_the_index(monkeypatch):
    """Candidates are what the index returns: all pairs within WIDE bits, and no others."""
    codes = clusters(30, 5)
    want = [(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if int(codes[a] ^ codes[b]).bit_count() <= op.WIDE]
    assert [(k, x) for k, others in op.candidates(codes, op.WIDE) for x in others.tolist()] == want
    texts = [op.shingles(t, 5) for _, t in near_copies(5)]
    assert op.confirmed(texts)[0]
    monkeypatch.setattr(op.GrayIndex, "search", lambda self, queries, distance: (np.zeros(0, int), np.zeros(0, int)))
    assert op.confirmed(texts) == ([], [])


def test_similar_texts_without_a_common_band(make):
    """Two of 49 words, 0.8 alike and within four bits, that share none of the bands."""
    one = [f"w{x}" for x in np.random.default_rng(10024).integers(0, 5000, 49)]
    two = [*one[:24], "o18", *one[25:]]
    a, b = (op.shingles(" ".join(t), 5) for t in (one, two))
    assert jaccard(" ".join(one), " ".join(two)) == 0.8 and not set(op.bands(a)) & set(op.bands(b))
    docs = [(1, " ".join(one)), (2, " ".join(two)), (3, "other words that are in none of them")]
    assert sorted(r["doc_id"] for r in op.one_of_similar(make(docs)).collect()) == [1, 3]
