"""Operators 7 to 10."""

from __future__ import annotations

import collections
import hashlib
import zlib
from pathlib import Path

import pytest

from pitpanel.llm import op7_media, op8_url_filter, op9_langid, op10_sharding, queries


# -- media --


def test_png_round_trip():
    for raw in (b"", b"a", bytes(range(256)) * 3, b"x" * 64):
        media = op7_media.encode_png(raw)
        payload, n = op7_media.decode_png(media)
        assert n == len(raw) and payload == raw + bytes(-len(raw) % 64) or payload == bytes(64)
    with pytest.raises(ValueError):
        op7_media.decode_png(media[:-5] + b"zzzzz")


def test_media_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op7_media_columns(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64) or bytes(64)
        got = rows[r["doc_id"]]
        assert (got["n_bytes"], got["payload_bytes"]) == (len(raw), len(payload))
        assert got["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got["tail_crc32"] == zlib.crc32(payload[-64:])
        assert got["feature"] == feature(payload)


def feature(payload):
    """Sum, sum of squares, sum of steps, peak, and counts in four ranges, sample by sample."""
    total = squares = steps = peak = 0
    ranges, last = [0, 0, 0, 0], None
    for x in payload:
        total, squares, peak = total + x, squares + x * x, max(peak, x)
        steps += 0 if last is None else abs(x - last)
        ranges[x // 64] += 1
        last = x
    return "-".join(map(str, [total, squares, steps, peak, *ranges]))


def png_samples(media):
    """An independent decoder of 8-bit greyscale PNGs: all five line filters, checked chunks."""
    assert media[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, data, size, names = 8, b"", None, []
    while at < len(media):
        n = int.from_bytes(media[at : at + 4], "big")
        name, body, crc = media[at + 4 : at + 8], media[at + 8 : at + 8 + n], media[at + 8 + n : at + 12 + n]
        assert int.from_bytes(crc, "big") == zlib.crc32(name + body)
        names.append(name)
        if name == b"IHDR":
            size = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert tuple(body[8:]) == (8, 0, 0, 0, 0)
        data += body if name == b"IDAT" else b""
        at += 12 + n
    assert names[0] == b"IHDR" and names[-1] == b"IEND" and at == len(media)
    lines, out, above = zlib.decompress(data), [], [0] * size[0]
    assert len(lines) == size[1] * (size[0] + 1)
    for k in range(size[1]):
        kind, *raw = lines[k * (size[0] + 1) : (k + 1) * (size[0] + 1)]
        line = []
        for j, x in enumerate(raw):
            left, up, corner = line[j - 1] if j else 0, above[j], above[j - 1] if j else 0
            guess = left + up - corner
            nearest = min((left, up, corner), key=lambda v: abs(guess - v))
            line.append((x + [0, left, up, (left + up) // 2, nearest][kind]) % 256)
        out += line
        above = line
    return bytes(out)


def test_stored_forms_by_another_decoder(spark, make, tmp_path):
    texts = ["", "a", "é漢😀" * 100, "x" * 64, "\x00\x01", "long text " * 5000]
    folder = f"file://{tmp_path}/media"
    op7_media.write_archives(make(list(enumerate(texts))).select("doc_id", "text"), folder)
    for r in op7_media.read_archives(spark, folder).collect():
        raw = texts[r["doc_id"]].encode()
        assert png_samples(bytes(r["media"])) == (raw + bytes(-len(raw) % 64) or bytes(64))


def test_a_lost_archive_is_noticed(spark, make, tmp_path):
    folder = f"file://{tmp_path}/media"
    _, members = op7_media.write_archives(make([(k, f"text {k}" * 9) for k in range(50)]).select("doc_id", "text"), folder, archive_bytes=5000)
    assert op7_media.read_archives(spark, folder, members=str(members)).count() == 50
    (tmp_path / "media" / "_part-000000-0000-7.tar").write_bytes(b"left by an attempt that failed")
    assert op7_media.read_archives(spark, folder, members=str(members)).count() == 50
    lost = sorted((tmp_path / "media").glob("p*.tar"))[0]
    lost.rename(tmp_path / "elsewhere")
    with pytest.raises(Exception, match="members and not 50"):
        op7_media.read_archives(spark, folder, members=str(members)).count()


def test_another_attempt_leaves_what_is_there(tmp_path):
    import pyarrow as pa

    for attempt in ("1", "2"):
        writer = op7_media.ArchiveWriter(f"file://{tmp_path}/m", "part-0", attempt)
        writer.add(b"media")
        writer.close(pa.array([1]))
        made = {p.name: p.read_bytes() for p in (tmp_path / "m").iterdir()}
        assert sorted(made) == ["part-0-1.idx", "part-0-1.tar"]


def test_ranges_batches_and_archives(spark, make, edges, tmp_path):
    table = make([*edges, *((k, f"text {k} " * 50) for k in range(100, 160))]).select("doc_id", "text")
    folder = f"file://{tmp_path}/media"
    archives, members = op7_media.write_archives(table, folder, archive_bytes=20_000)
    assert archives > 3 and members == table.count()
    small = op7_media.read_archives(spark, folder, rangeBytes=3000, batchBytes=700)
    assert small.rdd.getNumPartitions() > archives
    got = sorted(hashlib.sha256(r["media"]).hexdigest() for r in small.collect())
    assert got == sorted(hashlib.sha256(op7_media.encode_png((r["text"] or "").encode())).hexdigest() for r in table.collect())
    stored = [m for p in Path(tmp_path / "media").glob("*.tar") for m in op7_media.tar_members(p.read_bytes())]
    assert sorted(hashlib.sha256(m).hexdigest() for m in stored) == got
    assert op7_media.features(small).count() == table.count()


def test_members_are_retried_alone(tmp_path):
    import pyarrow.fs as pafs

    (tmp_path / "a").write_bytes(b"0123456789")

    class Flaky:
        opened = 0

        def open_input_file(self, path):
            Flaky.opened += 1
            if Flaky.opened < 3:
                raise OSError("gone")
            return pafs.LocalFileSystem().open_input_file(path)

    reader = op7_media.MemberReader(Flaky(), str(tmp_path / "a"), 4)
    assert reader.read(2, 3, zlib.crc32(b"234")) == b"234" and Flaky.opened == 3
    with pytest.raises(OSError, match="checksum"):
        reader.read(2, 3, 1)


def test_media_edges(make, edges):
    out = op7_media.store_and_describe(make(edges)).collect()
    assert len(out) == len(edges)
    by_text = collections.defaultdict(set)
    for r in out:
        by_text[r["payload_sha256"]].add((r["media_sha256"], r["feature"], r["n_bytes"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert op7_media.store_and_describe(make([])).count() == 0


# -- urls --


def judge(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 and url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), len(h), v == "allow", h + p, v) for v, h, p in op8_url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[3] if fit else None, max(fit)[4] if fit else "allow"


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7x?q#f", "x://example.com/en/8", "a://b.org/es/", "a://org/es/1", "a://notorg/es/", "a://u@h.net:80/de/", "a://example.net/de/89", "a://xexample.net/de/8", "a://com?/en/", "a://com", "a://a..com/en/", "https://a.b.c.d.com/en/x://y"]


@pytest.mark.parametrize("blocks", [8_000_000, 1])
def test_urls(spark, blocks):
    table = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*URLS, *URLS])], "page_id bigint, url string, rule string")
    out = {r["page_id"]: tuple(r)[1:] for r in op8_url_filter.judge(table, limit_blocks=blocks).collect()}
    assert out == {k: judge(u) for k, u in enumerate([*URLS, *URLS])}
    assert op8_url_filter.judge(table.limit(0)).count() == 0


def test_listed_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.info/x/?q=1"), (2, "http://a.info/x"), (3, "http://a.info/y"), (None, "http://a.info/x"), (4, "http://s.com/en/1")], "page_id bigint, url string")
    listed = spark.createDataFrame([("https://a.info/x",), (None,), ("nothing",), ("http://s.com/en/1",)], "url string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in op8_url_filter.judge(pages, listed=listed).collect()}
    assert out == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), None: (None, "block"), 4: ("com/en/", "block")}
    assert op8_url_filter.judge(pages, rules=[], listed=listed).filter("verdict = 'block'").count() == 4


def test_url_query_equals_sql(spark, duck, sf_dir):
    ours = sorted(map(repr, map(tuple, queries.op8_url_rules(spark, sf_dir).collect())))
    assert ours == sorted(map(repr, duck.sql(op8_url_filter.SQL).fetchall()))


# -- languages --


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op9_language_id(spark, folder).collect()
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert len(rows) == len(truth) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)


def counted_grams(text):
    out = collections.Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        edged = (1, *map(ord, word), 1)
        out.update((c,) for c in edged[1:-1])
        out.update(edged[k : k + 2] for k in range(len(edged) - 1))
        out.update(edged[k : k + 3] for k in range(len(edged) - 2))
    return out


def most_frequent(counts):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[: op9_langid.SIZE]


def test_profiles_and_distances_by_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    totals = collections.defaultdict(collections.Counter)
    for i, text, lang in docs:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and text is not None:
            totals[lang].update(counted_grams(text))
    ranks = {lang: {g: k for k, g in enumerate(most_frequent(totals[lang]))} for lang in sorted(totals)}
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        own = most_frequent(counted_grams(text))
        apart = {lang: sum(abs(known[g] - k) if g in known else op9_langid.SIZE for k, g in enumerate(own)) for lang, known in ranks.items()}
        best = min(apart, key=apart.get) if own else "und"
        score = 1 - apart[best] / (op9_langid.SIZE * len(own)) if own else 0.0
        assert (got[i]["lang_pred"], got[i]["score"]) == (best, pytest.approx(score, abs=1e-12))
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_language_edges(spark, make, edges):
    learnt = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    profiles = op9_langid.learn(learnt)
    assert profiles.languages == ["de", "en"]
    out = op9_langid.predict(make([*edges, (60, "123 !?"), (61, "the dog"), (62, "und die")]), profiles).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in out}
    assert got[60] == got[1] == got[2] == got[5] == "und" and got[61] == "en" and got[62] == "de" and len(out) == len(edges) + 3
    nothing = op9_langid.learn(learnt.limit(0))
    assert {tuple(r)[1:] for r in op9_langid.predict(make(edges), nothing).collect()} == {("und", 0.0)}
    kept = op9_langid.known_language(make(edges), profiles)
    assert kept.columns == make(edges).columns and kept.count() == 4


def test_counts_of_long_texts(monkeypatch):
    text = "the quick brown fox jumps. " * 200
    whole = op9_langid.counted(text)
    monkeypatch.setattr(op9_langid, "CHUNK_CHARS", 101)
    parts = op9_langid.counted(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


# -- shards --


def shares(rows, shards=16):
    sizes = collections.Counter(r["shard"] for r in rows)
    slots = collections.defaultdict(list)
    groups = collections.defaultdict(collections.Counter)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["group"]][r["shard"]] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) <= set(range(shards))
    if len(rows) >= shards:
        assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == shards
    return [g for g in groups.values() if sum(g.values()) > 1]


def test_shards(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op10_sharding.assign(table).collect()
    linked = shares(rows)
    assert len(rows) == table.count() and sum(max(g.values()) for g in linked) >= 0.9 * sum(sum(g.values()) for g in linked)
    digest = {r["doc_id"]: r for r in queries.op10_shard_assignment(spark, sf_dir).collect()}
    for r in table.collect():
        raw = (r["text"] or "").encode()
        got = digest[r["doc_id"]]
        assert (got["size"], got["text_crc32"], got["law"], got["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_a_hot_group_is_spread_over_few_shards(make):
    rows = op10_sharding.assign(make([(k, "hot" if k % 3 == 0 else f"pair {k // 10}" if k % 5 == 0 else f"own {k}") for k in range(4800)])).collect()
    linked = shares(rows)
    hot = max(linked, key=lambda g: sum(g.values()))
    assert sum(n for _, n in hot.most_common(7)) >= 0.9 * sum(hot.values())


def test_cut_links_and_repeatability(spark, make):
    table = make([(k, "hot" if k % 3 == 0 else f"pair {k // 10}" if k % 5 == 0 else f"own {k}") for k in range(3000)] + [(None, None)] * 40 + [(7, "long " * 400_000)] * 2)
    made = op10_sharding.assign(table)
    rows = made.collect()
    groups = shares(rows)
    linked, cut = op10_sharding.cut_links(made).first()
    assert linked == sum(sum(g.values()) for g in groups) and cut == sum(sum(g.values()) - max(g.values()) for g in groups)
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r["size"], r["text_crc32"]].add(r["group"])
    assert all(len(g) == 1 for g in by_text.values()) and len(rows) == 3042
    small = [g for g in groups if sum(g.values()) < 150]
    assert sum(sum(g.values()) - max(g.values()) for g in small) <= 0.02 * sum(sum(g.values()) for g in small)


def test_labels_stand_still(spark):
    """After the last round no row asks to move to a shard with room that holds more of its group."""
    import random

    rnd = random.Random(1)
    rows = [(g, s, rnd.randint(1, 5)) for g in range(60) for s in rnd.sample(range(4), 3)]
    counts = spark.createDataFrame(rows, "g bigint, shard int, n bigint")
    total = sum(n for *_, n in rows)
    held = collections.defaultdict(dict)
    for g, s, n in op10_sharding.propagate(counts, [total] * 4).select("g", "shard", "n").collect():
        held[g][s] = n
    assert sum(sum(h.values()) for h in held.values()) == total and all(len(h) == 1 for h in held.values())


def test_shard_edges(make, edges):
    rows = op10_sharding.assign(make(edges)).collect()
    shares(rows)
    assert len(rows) == len(edges) and {r["size"] for r in rows if r["doc_id"] == 5} == {1}
    assert op10_sharding.assign(make([])).count() == 0


def test_quotas_hold():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        wanted, room = rng.integers(0, 100, (6, 6)), rng.integers(-5, 30, 6)
        granted = op10_sharding.quotas(wanted, room)
        assert (granted <= wanted + 1e-9).all() and (granted.sum(0) - granted.sum(1) <= np.maximum(room, 0) + 1).all()
