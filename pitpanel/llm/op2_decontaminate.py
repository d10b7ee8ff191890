"""Benchmark decontamination by a broadcast hash set of test n-grams.

Texts are normalised to words: A-Z in lower case, and a word is a run of digits,
letters a-z and characters outside ASCII. Every 13 consecutive words of a benchmark
item are a window (an item of fewer words is one window). The windows' hashes are
broadcast; tasks scan the windows of training texts against them, compare the words
of each hit, and mark the words of all windows found.

The benchmark's size is measured before it is broadcast, in bytes of its words; what is
broadcast is some 25 bytes a window and, at most, 100 a different word. Beyond ``LIMIT_BYTES``
it is dealt by hash into blocks of about that size, each block is broadcast in turn and
scans all documents, and the hits of a document are united: the result is the same. An
item of more than ``ITEM_WORDS`` windows is dealt in parts.

Defined results: a null or wordless document has no words, no hits and isn't
contaminated; a null or wordless item has no window; an item with null id counts
under the empty id; rows with one item id are one item; repeated documents give
repeated rows; an empty table on either side gives no hits; columns other than the
named ones are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import bound_batches, by_position, id_and_text, lean, map_texts

WINDOW = 13
#: Benchmark text that is broadcast at once.
LIMIT_BYTES = 16_000_000
#: Windows of an item that stay together; a longer item is dealt in parts, each window in one.
ITEM_WORDS = 50_000

#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter to a space.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Windows:
    """The windows of benchmark items, by their number of words.

    All items' words are one stream of numbers; a distinct window is its hash, a place in
    the stream, and the items that have it. Some twenty bytes a window, whatever its words.
    """

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.ids)}
        parts, owners, lengths = [], [], []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if words:
                parts.append(np.array(words, np.int32))
                owners.append(number[item])
                lengths.append(len(words))
        self.stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ends = np.cumsum(lengths, dtype=np.int64)
        first = ends - lengths
        sizes = np.minimum(lengths, size)
        self.tables = {}
        for n in sorted(set(sizes.tolist())):
            mine = np.flatnonzero(sizes == n)
            places = np.concatenate([np.arange(first[k], ends[k] - n + 1) for k in mine])
            owner = np.repeat(np.array(owners, np.int32)[mine], np.array(lengths)[mine] - n + 1)
            seed, table = 7, None
            while table is None:  # until no two different windows share a hash
                table = self.table(places, owner, n, seed)
                seed += 1
            self.tables[n] = table

    def hashes(self, stream: np.ndarray, places: np.ndarray, factors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for k, factor in enumerate(factors):
            out += stream[places + k].astype(np.uint64) * factor
        return out

    def table(self, places: np.ndarray, owner: np.ndarray, n: int, seed: int):
        factors = np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
        h = self.hashes(self.stream, places, factors)
        order = np.lexsort((owner, h))
        h, places, owner = h[order], places[order], owner[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        for k in range(n):
            if (self.stream[places + k] != self.stream[places[start][group] + k]).any():
                return None
        kept = new | np.concatenate([[True], owner[1:] != owner[:-1]])
        offsets = np.concatenate([np.flatnonzero(new[kept]), [kept.sum()]])
        return factors, h[start], places[start], owner[kept], offsets

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]] | None:
        """Marks of hit words, marks of those hit by whole windows, and item ids."""
        known = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        total = np.concatenate([[0], np.cumsum(known > 0)])
        hit = whole = None
        items: list[np.ndarray] = []
        for n, (factors, hashes, places, owners, offsets) in self.tables.items():
            if n > len(words):
                continue
            at = np.flatnonzero(total[n:] - total[:-n] == n)
            if not len(at):
                continue
            sums = self.hashes(known, at, factors)
            place = np.searchsorted(hashes, sums)
            place[place == len(hashes)] = 0
            near = hashes[place] == sums
            at, place = at[near], place[near]
            for k in range(n):  # the same words
                same = known[at + k] == self.stream[places[place] + k]
                at, place = at[same], place[same]
            if not len(at):
                continue
            if hit is None:
                hit, whole = np.zeros(len(words), bool), np.zeros(len(words), bool)
            for k in range(n):
                hit[at + k] = True
                if n == WINDOW:
                    whole[at + k] = True
            items += [owners[offsets[p] : offsets[p + 1]] for p in np.unique(place).tolist()]
        return None if hit is None else (hit, whole, [self.ids[k] for k in np.unique(np.concatenate(items)).tolist()])


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """Start and exclusive end of each run of true marks."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


PAIRS = pa.list_(pa.list_(pa.int32()))
FIELDS = [
    ("n_words", "bigint", pa.int64()),
    ("hits", "array<array<int>>", PAIRS),  # runs of hit words, by word number
    ("whole", "array<array<int>>", PAIRS),  # those of whole windows only
    ("items", "array<string>", pa.list_(pa.string())),
]


def scan(docs: DataFrame, windows: Windows) -> DataFrame:
    """``doc_id, n_words, hits, whole, items`` of ``doc_id, text`` under one block of windows."""
    held = docs.sparkSession.sparkContext.broadcast(windows)

    def work() -> Callable[[list[str]], list[tuple]]:
        block = held.value

        def one(text: str) -> tuple:
            words = words_of(text)
            found = block.scan(words)
            return (len(words), [], [], []) if found is None else (len(words), runs(found[0]), runs(found[1]), found[2])

        return lambda texts: [one(text) for text in texts]

    return map_texts(docs, FIELDS, work)


def united(pairs: list[list[int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, pairs)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def items_of(benchmark: DataFrame, limit_bytes: int) -> tuple[DataFrame, int, Column]:
    """Ids as text and texts of the items; how many blocks they take; the block of each."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    bound_batches(benchmark.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                for k in range(0, max(len(words) - WINDOW + 1, 1), ITEM_WORDS):
                    ids.append(item)
                    parts.append(b" ".join(words[k : k + ITEM_WORDS + WINDOW - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.string())], names=["item_id", "text"])

    items = items.mapInArrow(cut, "item_id string, text string")
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    blocks = max(1, math.ceil(size / limit_bytes))
    return items, blocks, F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))


def read(items: DataFrame) -> Windows:
    """The windows of one block of items, which is of bounded size."""
    return Windows([(r[0], r[1]) for r in items.toLocalIterator()])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, items, hits, whole, contaminated`` of each document.

    ``items`` are the sorted ids of the items of which a window occurs.
    """
    docs = id_and_text(docs, id_col, text_col)
    items, blocks, key = items_of(benchmark, limit_bytes)
    if blocks == 1:
        found = scan(docs, read(items))
    else:
        keyed = docs.withColumn("doc_id", F.struct("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5")))
        parts = [scan(keyed, read(items.filter(key == k))) for k in range(blocks)]
        some = parts[0].filter(F.size("items") > 0)
        for part in parts[1:]:
            some = some.unionByName(part.filter(F.size("items") > 0))
        gathered = some.groupBy("doc_id").agg(
            *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("hits", "whole", "items"))
        )
        all_docs = map_texts(keyed, FIELDS[:1], lambda: lambda texts: [(len(words_of(t)),) for t in texts])
        found = all_docs.join(
            gathered.withColumnsRenamed({"doc_id": "key"}),
            (F.col("doc_id.doc_id").eqNullSafe(F.col("key.doc_id"))) & (F.col("doc_id.md5") == F.col("key.md5")),
            "left",
        ).select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t, _ in FIELDS[1:]))
    # Runs of one block don't touch; those of several blocks can overlap.
    merged = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x[1] - F.greatest(x[0], a["end"]))).alias("n"), F.greatest(a["end"], x[1]).alias("end")
        ),
    )
    out = found.withColumn("n_hit", merged["n"])
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def without(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in united(spans):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, and without the words of whole windows
    in the rest; ``n_chars`` follows the text where it is cut. All columns stay.

    One pass for a benchmark of one block. For a larger one each pass marks the words that
    its block hits and hands them to the next, and the last one judges: no row meets another.
    """
    items, blocks, key = items_of(benchmark, limit_bytes)
    bound_batches(docs.sparkSession)
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    marks = pa.list_(pa.list_(pa.int32()))
    rows = by_position(docs)
    names, schema = rows.columns, rows.schema
    for k in range(blocks):
        rows = _pass(rows, read(items.filter(key == k) if blocks > 1 else items), names, k == 0, k == blocks - 1, text_at, chars_at, marks, schema)
    return rows.toDF(*docs.columns)


def _pass(rows, windows, names, first, last, text_at, chars_at, marks, schema) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[: len(names)])
            texts = columns[text_at].to_pylist()
            hits = [[], []] if first else [c.to_pylist() for c in batch.columns[len(names) :]]
            keep, new_texts, out = [], [], ([], [])
            for k, text in enumerate(texts):
                words = words_of(text)
                found = held.value.scan(words)
                both = [[] if first else list(hits[j][k]) for j in (0, 1)]
                if found is not None:
                    both = [b + [list(x) for x in runs(marked)] for b, marked in zip(both, found)]
                if last:
                    n = sum(b - a for a, b in united(both[0]))
                    keep.append(not (n and 20 * n >= len(words)))
                    new_texts.append(without(text, both[1]) if keep[-1] and both[1] else text)
                else:
                    out[0].append(both[0])
                    out[1].append(both[1])
            if not last:
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, marks) for x in out)], names=[*names, "_hits", "_whole"])
                continue
            if chars_at is not None:
                same = [n if a is b else len(b) for a, b, n in zip(texts, new_texts, columns[chars_at].to_pylist())]
                columns[chars_at] = pa.array(same, columns[chars_at].type)
            columns[text_at] = pa.array(new_texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    if last:
        return rows.mapInArrow(lean(run), schema)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(lean(run), f"{types}, _hits array<array<int>>, _whole array<array<int>>")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bn AS (SELECT item, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM bn),
known AS (SELECT n, win, list(DISTINCT item) AS items FROM bw GROUP BY ALL),
spots AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hit AS (SELECT r, spots.n, i, items FROM spots JOIN known ON known.n = spots.n AND known.win = array_to_string(w[i:i + spots.n - 1], ' ')),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, unnest(items) AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
