"""Operators 1 and 3 against the libraries."""

from __future__ import annotations

import hashlib
import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from pitpanel.llm import op1_bpe, op3_token_count, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op1_bpe.read_ranks(PATH), special_tokens={})


def noise(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("aab  \n\t'sé漢字😀1 9!?ςΣ\u0301abcabc<|endoftext|>") for _ in range(rnd.randint(0, 200))) for _ in range(n)]


def test_replay_equals_library(library):
    texts = [*noise(800, 1), "a" * 3000, "ab" * 2000, "\x00\x01", "   \n  x"]
    got = op1_bpe.encoder(PATH, P.PATTERN).encode(texts)
    assert [op1_bpe.unpack(x) for x in got] == [library.encode_ordinary(t) for t in texts]


def test_an_earlier_rank_can_appear_later():
    """A merge that makes a pair of lower rank: the rest of its word has to wait."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"cd": 300, b"bcd": 290, b"ab": 310, b"abcd": 280, b"da": 305}
    ours = op1_bpe.MergeReplay(ranks)
    known = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    rnd = random.Random(4)
    words = list({"".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 14))) for _ in range(800)})
    whole = [w for w in words if w.encode() not in ranks]
    assert [op1_bpe.unpack(x) for x in ours.replay([w.encode() for w in whole])] == [known.encode_ordinary(w) for w in whole]


def test_replay_equals_library_for_any_ranks():
    """Ranks in any order, with tokens that can be cut in several ways and overlap themselves."""
    for seed in range(25):
        rnd = random.Random(seed)
        tokens = [b"a", b"b", b"c"]
        while len(tokens) < 25:
            new = rnd.choice(tokens) + rnd.choice(tokens)
            if new not in tokens and len(new) < 9:
                tokens.append(new)
        order = list(range(300, 300 + len(tokens)))
        if seed % 2:
            rnd.shuffle(order)
        ranks = {bytes([b]): b for b in range(256)} | {t: r for t, r in zip(tokens, order) if len(t) > 1}
        known = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        words = [w for w in {"".join(rnd.choice("aabc") for _ in range(rnd.randint(1, 30))) for _ in range(300)} if w.encode() not in ranks]
        assert [op1_bpe.unpack(x) for x in op1_bpe.MergeReplay(ranks).replay([w.encode() for w in words])] == [known.encode_ordinary(w) for w in words]
    assert op1_bpe.MergeReplay(ranks).replay([b"", b"zz", b""]) == [b"", b"z\0\0\0z\0\0\0", b""] and op1_bpe.MergeReplay(ranks).replay([]) == []


def test_long_text_in_runs(library, monkeypatch):
    monkeypatch.setattr(op1_bpe, "RUN", 50)
    text = " ".join(noise(40, 2))
    assert op1_bpe.unpack(op1_bpe.encoder(PATH, P.PATTERN).encode([text])[0]) == library.encode_ordinary(text)


def test_memory_bound_does_not_alter_results(library, monkeypatch):
    monkeypatch.setattr(op1_bpe, "MEMO", 20)
    made = op1_bpe.encoder(PATH, P.PATTERN)
    for text in noise(30, 3):
        assert op1_bpe.unpack(made.encode([text])[0]) == library.encode_ordinary(text)


def test_blocks_of_places_do_not_alter_results(library, monkeypatch):
    texts = [*noise(300, 6), "a" * 3000, "ab" * 2000]
    for block in (1, 7, 1000):
        monkeypatch.setattr(op1_bpe, "BLOCK", block, raising=False)
        assert [op1_bpe.unpack(x) for x in op1_bpe.encoder(PATH, P.PATTERN).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_a_replay_takes_bounded_memory_a_byte():
    rnd = random.Random(8)
    words = [bytes(rnd.choices(b"etaoinshrdlu", k=10)) for _ in range(200_000)]
    ours = op1_bpe.replayer(PATH)
    tracemalloc.start()
    ours.replay(words)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 36 * 10 * len(words), most


def test_query_and_round_trip(spark, sf_dir, library, make, edges):
    rows = {r["doc_id"]: r for r in queries.op1_byte_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want = (r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
        assert tuple(rows[r["doc_id"]]) == want
    encoded = op1_bpe.encode(make(edges), PATH, P.PATTERN)
    back = op1_bpe.decode(encoded, PATH).select("doc_id", "decoded").collect()
    assert sorted((str(i), bytes(b).decode()) for i, b in back) == sorted((str(i), t or "") for i, t in edges)
    assert op1_bpe.encode(make([]), PATH, P.PATTERN).count() == 0


def test_splices_equal_whole_encoding():
    tok = op3_token_count.tokenizer(WORDS)
    rnd = random.Random(5)
    parts = ["a", "B", "ab ", "  ", "\n", "\t", "'s", "e\u0301", "漢", "😀", "1", "9", "!?", "Σ", "\u0301", "<|endoftext|>", "\u2028", "\u3000", "İ", "ß"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(300, 3000))) for _ in range(60)]
    texts += ["x" * 9000, "x" * 3000 + " " + "y" * 3000, "!" * 5000 + " " * 5000 + "a", " " * 9000]
    widened = 0
    for text in texts:
        for chunk, overlap in ((300, 12), (1500, 64)):
            n, k = op3_token_count.count_long(tok, text, chunk, overlap) if len(text) > chunk else (len(tok.encode(text, add_special_tokens=False).ids), 0)
            assert n == len(tok.encode(text, add_special_tokens=False).ids)
            widened += k
    assert widened


def test_long_texts_without_white_space_take_bounded_memory():
    tok = op3_token_count.tokenizer(WORDS)
    rnd = random.Random(6)
    some = [chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(500)]
    kinds = [some, ["a"], ["ab"], list("abcdefgh"), list("각난닫랄"), ["w\u00f6rd", "\u00a0"], ["a\u0301", "o", "\u0328"], ["'", "s", "!", "r", "e"], ["<|endoftext|>", "<|", "text"]]
    for parts in kinds:
        text = "".join(rnd.choice(parts) for _ in range(20_000))
        for chunk, overlap in ((4000, 300), (7001, 512)):
            n, widened = op3_token_count.count_long(tok, text, chunk, overlap)
            assert n == len(tok.encode(text, add_special_tokens=False).ids) and widened <= 3
    code = f"""
import random, resource
from pitpanel.llm import op3_token_count as op
tok, rnd = op.tokenizer({WORDS!r}), random.Random(1)
some = [chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(1000)]
text = "".join(rnd.choice(some) for _ in range(1_700_000))
op.count_long(tok, text[:200_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n, _ = op.count_long(tok, text)
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True, timeout=300)
    n, megabytes = map(float, done.stdout.split())
    assert n > 1_700_000 and megabytes < 100


def test_counts(spark, sf_dir, make, edges):
    tok = op3_token_count.tokenizer(WORDS)
    rows = {r["doc_id"]: r for r in op3_token_count.count(spark.read.parquet(f"{sf_dir}/documents.parquet"), WORDS, chunk=2000, overlap=40).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
        got = rows[r["doc_id"]]
        assert (got["n_bytes"], got["n_tokens"], got["over_limit"]) == (len((r["text"] or "").encode()), n, n > 2048)
    out = op3_token_count.count(make(edges), WORDS).collect()
    assert len(out) == len(edges) and all(r["n_tokens"] == 0 for r in out if r["n_bytes"] == 0)
    assert op3_token_count.count(make([]), WORDS).count() == 0


def test_learning_many_words_takes_bounded_memory():
    rnd = random.Random(9)
    made = op1_bpe.encoder(PATH, P.PATTERN)
    made.read(" ".join("".join(rnd.choices("etaoinshrdlu", k=10)) for _ in range(400_000)))
    tracemalloc.start()
    made.learn()
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 100_000_000, most


def test_replays_of_parts_do_not_alter_results(library, monkeypatch):
    texts = [*noise(300, 10), "a" * 3000, "ab" * 2000]
    for limit in (1, 50, 3000):
        monkeypatch.setattr(op1_bpe, "REPLAY_CHARS", limit, raising=False)
        assert [op1_bpe.unpack(x) for x in op1_bpe.encoder(PATH, P.PATTERN).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_a_worker_gives_back_what_a_task_took(tmp_path):
    """Workers stay for later tasks, and what they keep is the executor's."""
    code = f"""
import random, re
import public_tokenizers as P, pyarrow as pa
from pitpanel.llm import op1_bpe
from pitpanel.session import session
spark = session("local[1]", 1, **{{"spark.checkpoint.dir": {str(tmp_path)!r}}})
def held(batches):
    for _ in batches:
        kb = re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]
        yield pa.RecordBatch.from_arrays([pa.array([int(kb)])], names=["kb"])
def kb():
    return spark.range(1).coalesce(1).mapInArrow(held, "kb bigint").first()[0]
def docs(n, words):
    rnd = random.Random(n)
    made = [(k, " ".join("".join(rnd.choices("etaoinshrdlu", k=9)) for _ in range(words))) for k in range(n)]
    return spark.createDataFrame(made, "doc_id bigint, text string").coalesce(1)
def encode(table):
    op1_bpe.encode(table, {PATH!r}, P.PATTERN, and_decode=True).write.format("noop").mode("overwrite").save()
encode(docs(1, 10))
before = kb()
encode(docs(500, 1000))
print((kb() - before) / 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True, timeout=300)
    assert float(done.stdout.split()[-1]) < 65
