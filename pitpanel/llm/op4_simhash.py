"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint has a bit set where more than half of its shingles' hashes have
it. Documents link at ``DISTANCE`` or fewer differing bits; a component is what links
reach. Only distinct fingerprints are compared, so copies cost nothing.

Fingerprints within ``DISTANCE`` bits agree in at least one of ``DISTANCE`` + 1 blocks of
bits (in two of one block more, and so on). They are dealt out by such blocks; in each
group an index sorts them by Gray rank, so that neighbours differ little, and factors the
bits that eight neighbours share into a node above them, again and again. A search goes
down from the root, adds up the differences on each node's own bits, and leaves whole
subtrees as soon as the sum is too large. More fingerprints take more bits for a group,
which alters how many comparisons there are but not what is found. A group of more than
``GROUP`` fingerprints is dealt again by blocks of its other bits, ``LEVELS`` times at most;
what is still too large is cut into parts, and each pair of parts is searched by itself.

A group hands on a spanning forest of its links, fewer rows than it has fingerprints.
Components come from Spark joins (large and small stars in turn, minimum labels), and
only counts reach the driver.

Defined results: a null, empty or blank text has fingerprint zero; so have all like it,
and they link as any others. ``component_id`` is the smallest id that isn't null, or null
if there is none; repeated rows and ids give repeated rows; an empty table gives an
empty one; other columns are left out. Long texts are hashed in bounded pieces.

``one_of_similar`` is for corpora: it keeps one document of those that exact shingle
similarity links. It goes by the same fingerprints and index: ``classes`` finds what links at
``DISTANCE`` bits, and each class is a group. A similarity of 0.8 is some 10 of 64 bits on
average, which no choice of blocks of bits finds in reasonable groups; so documents that share
a band of minimum hashes are groups besides. In each group the index is searched for
fingerprints within ``WIDE`` bits, and the sets of shingles decide. A pair in a group is only
passed over when confirmed links of that group connect it already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import HOT, by_position, cut, id_and_text, lean, map_texts, meet, only, store

DISTANCE = 4
SHINGLE = 4
SEED = 42
GROUP = 4096
FAN = 8
#: Fingerprints that a group of the plan should have at most, on average.
MEAN = 1024
PIECE = 4_000_000

#: Of ``one_of_similar``: words in a shingle, and the Jaccard similarity that links.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: At a similarity of 0.8, 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9999 of pairs share a band, and
#: about one in a million differs in more than WIDE bits.
BANDS, ROWS, WIDE = 24, 5, 24
#: Texts of a group that are compared in one task; larger groups are cut into parts.
TEXTS = 2048
#: How often a group that is too large is dealt again before it is cut into parts.
LEVELS = 2


def hashes(words: list[bytes], size: int) -> list[int]:
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])]


def word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end


def shingles(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's shingles, in order; that of all words if they are fewer than ``size``."""
    data = (text or "").encode().lower()
    found, tail = [], []
    for words in word_pieces(data):
        words = tail + words
        found.append(np.array(hashes(words, size), np.uint64))
        tail = words[-(size - 1) :] if size > 1 else []
    out = np.concatenate(found) if found else np.zeros(0, np.uint64)
    if not len(out) and tail:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)
    return out


def majority(found: np.ndarray) -> np.uint64:
    """The fingerprint of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(found), 65_536):
        ones += np.unpackbits(found[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found), bitorder="little").view(np.uint64)[0]


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    ones, count, tail = np.zeros(64, np.int64), 0, []
    data = text.encode().lower()  # of bytes, so A-Z only
    for words in word_pieces(data) if len(data) > PIECE else [data.split()]:
        words = tail + words
        found = hashes(words, size)
        tail = words[-(size - 1) :] if size > 1 else []
        for k in range(0, len(found), 65_536):
            part = np.array(found[k : k + 65_536], np.uint64).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(found)
    if not count:
        if not tail:
            return 0
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(tail), SEED)).view(np.int64))
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of each document."""

    def work() -> Callable[[list[str]], list[tuple]]:
        return lambda texts: [(fingerprint(text, size),) for text in texts]

    return map_texts(id_and_text(docs, id_col, text_col), [("fp", "bigint", pa.int64())], work)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the sequence of Gray codes."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Codes in Gray order under nodes that hold what the codes below them share."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        ordered = codes[self.order]
        every, some = [ordered], [ordered]  # AND and OR of what is below
        while len(every[-1]) > FAN:
            starts = np.arange(0, len(every[-1]), FAN)
            every.append(np.bitwise_and.reduceat(every[-1], starts))
            some.append(np.bitwise_or.reduceat(some[-1], starts))
        masks = [~(a ^ b) for a, b in zip(every, some)]
        self.patterns = every[::-1]  # from the top level down to the codes
        own = [masks[-1]]
        for below, above in zip(masks[-2::-1], masks[:0:-1]):
            own.append(below & ~np.repeat(above, FAN)[: len(below)])
        self.own = own  # the bits that a node adds to those of the nodes above it

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code) within the distance, as positions."""
        query = np.repeat(np.arange(len(queries)), len(self.patterns[0]))
        node = np.tile(np.arange(len(self.patterns[0])), len(queries))
        total = np.zeros(len(query), np.uint8)
        for level, (pattern, own) in enumerate(zip(self.patterns, self.own)):
            if level:
                query, total = np.repeat(query, FAN), np.repeat(total, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).reshape(-1)
                there = node < len(pattern)
                query, node, total = query[there], node[there], total[there]
            total = total + np.bitwise_count((queries[query] ^ pattern[node]) & own[node])
            near = total <= distance
            query, node, total = query[near], node[near], total[near]
        return query, self.order[node]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the least position of its set, after uniting a[k] and b[k]."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels != labels[labels]).any():
            labels = labels[labels]


def forest(codes: np.ndarray, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever codes are linked; ``queries`` are positions to search for."""
    labels = np.arange(len(codes))
    others = np.setdiff1d(np.arange(len(codes)), queries) if len(queries) < len(codes) else queries
    index = GrayIndex(codes[others])
    step = max(1, 2_000_000 // max(len(others), 1))
    for k in range(0, len(queries), step):
        block = queries[k : k + step]
        q, found = index.search(codes[block], distance)
        labels = merge(labels, block[q], others[found])
    moved = np.flatnonzero(labels != np.arange(len(codes)))
    return moved, labels[moved]


def plan(count: int, distance: int) -> tuple[int, int]:
    """Blocks of bits and how many of them a group shares, by the number of fingerprints."""
    for shared in range(1, 5):
        blocks = distance + shared
        if count / MEAN <= 2 ** (64 * shared // blocks):
            break
    return blocks, shared


def choices(blocks: int, shared: int) -> list[int]:
    """The mask of the bits of each choice of ``shared`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, shared)]


def further(mask: int, distance: int) -> list[int]:
    """The mask with each of ``distance`` + 1 blocks of the other bits: codes that agree on the
    mask and differ in ``distance`` bits at most agree on one of these, too."""
    rest = [k for k in range(64) if not mask >> k & 1]
    blocks = [rest[len(rest) * k // (distance + 1) : len(rest) * (k + 1) // (distance + 1)] for k in range(distance + 1)]
    return [mask | sum(1 << k for k in block) for block in blocks if block]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def group_keys(fp: Column, masks: list[int], first: int = 0) -> Column:
    """For each mask: its number, counted from ``first``, and the code's bits under it."""
    return F.array(*(F.struct(F.lit(first + k).alias("choice"), fp.bitwiseAND(F.lit(signed(m)).cast("bigint")).alias("bits")) for k, m in enumerate(masks)))


def dealt_by(codes: DataFrame, masks: list[int], distance: int, group: int) -> DataFrame:
    """``fp, choice, bits, part, other``: codes in groups in which every link lies in some group.

    A group of more than ``group`` codes is dealt again by ``further`` bits, ``LEVELS`` times at
    most; what is still too large is cut into parts, of which each meets each.
    """
    keyed = codes.select("fp", F.explode(group_keys(F.col("fp"), masks)).alias("key")).select("fp", "key.choice", "key.bits")
    whole, number = None, len(masks)
    numbered = dict(enumerate(masks))
    for level in range(LEVELS + 1):
        large = cut(keyed.groupBy("choice", "bits").count().filter(F.col("count") > group))
        n = large.count()
        if not n:
            break
        # Beyond HOT groups the table is shuffled, and Spark splits skewed partitions.
        held = F.broadcast(large) if n <= HOT else large
        rest = keyed.join(held, ["choice", "bits"], "left_anti")
        whole = rest if whole is None else whole.unionByName(rest)
        keyed = keyed.join(held, ["choice", "bits"])
        if level == LEVELS:
            parts = F.ceil(F.col("count") / group).cast("int")
            part = F.pmod(F.xxhash64("fp", F.lit("part")), parts).cast("int").alias("part")
            keyed = keyed.select("fp", "choice", "bits", part, F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
            return whole.withColumns({"part": F.lit(0), "other": F.lit(0)}).unionByName(keyed)
        again = None
        for choice in sorted(r[0] for r in large.select("choice").distinct().collect()):
            masks = further(numbered[choice], distance)
            made = keyed.filter(F.col("choice") == choice).select("fp", F.explode(group_keys(F.col("fp"), masks, number)).alias("key"))
            again = made if again is None else again.unionByName(made)
            numbered |= dict(enumerate(masks, number))
            number += len(masks)
        keyed = cut(again.select("fp", "key.choice", "key.bits"))
    whole = keyed if whole is None else whole.unionByName(keyed)
    return whole.withColumns({"part": F.lit(0), "other": F.lit(0)})


def links(codes: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """``u, v`` with u > v: edges that connect linked codes; ``codes`` has distinct ``fp``."""
    keyed = dealt_by(codes, choices(*plan(codes.count(), distance)), distance, group)
    keyed = keyed.select("choice", "bits", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fp")
    dealt = keyed.repartition("choice", "bits", "a", "b").sortWithinPartitions("choice", "bits", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in _and_none(batches):
            if batch is not None:
                new = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if held is None or not len(held[0]):
                continue
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)) + 1
            ends = change.tolist() + ([len(held[0])] if batch is None else [])
            us, vs, start = [], [], 0
            for end in ends:
                if end - start > 1:
                    code = held[5][start:end].view(np.uint64)
                    side = held[4][start:end]
                    every = np.arange(end - start)
                    one = every if held[2][start] == held[3][start] else np.flatnonzero(side == held[2][start])
                    if len(one) and (len(one) < len(every) or held[2][start] == held[3][start]):
                        u, v = forest(code, one, distance)
                        us.append(held[5][start:end][u])
                        vs.append(held[5][start:end][v])
                start = end
            held = [c[start:] for c in held]
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return dealt.mapInArrow(lean(run), "u bigint, v bigint").distinct()


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of the edges ``u, v``: the root is the least node."""
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = (edges.count(), None)
    while True:
        total = 2 * state[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = meet(both, least, "u", total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = meet(large, least, "u", total)
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new


def classes(found: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """``fp, root``: each distinct fingerprint of ``found`` and the one its component is named by."""
    codes = cut(found.select("fp").distinct())
    linked = components(links(codes, distance, group))
    return codes.join(linked, codes["fp"] == linked["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each document."""
    found = cut(fingerprints(docs, size, id_col, text_col))
    least = found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    member = cut(classes(found, distance, group).join(least, "fp"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    each = meet(member, named, "root", member.count()).select("fp", "component_id", F.col("copies").alias("n"))
    out = meet(found, each, "fp", found.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes of a set of shingles; none of an empty set."""
    if not len(found):
        return []
    factors = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    times, plus = factors[0] | np.uint64(1), factors[1]
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(found), 1024):
        np.minimum(least, (found[k : k + 1024] * times + plus).min(axis=1), out=least)
    data = [least[k : k + ROWS].tobytes() for k in range(0, len(least), ROWS)]
    return [int(np.uint64(xxhash.xxh64_intdigest(d, k)).view(np.int64)) for k, d in enumerate(data)]


def candidates(codes: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each position with any, the later positions whose codes are within the distance, by the index."""
    index = GrayIndex(codes)
    step = max(1, 250_000 // len(codes))
    for start in range(0, len(codes), step):
        query, found = index.search(codes[start : start + step], distance)
        query += start
        later = found > query
        query, found = query[later], found[later]
        order = np.lexsort((found, query))
        query, found = query[order], found[order]
        edges = np.flatnonzero(np.diff(query, prepend=-1, append=-1)).tolist()
        for a, b in zip(edges, edges[1:]):
            yield int(query[a]), found[a:b]


def confirmed(found: list[np.ndarray], side: np.ndarray | None = None, similarity: float = SIMILARITY) -> tuple[list[int], list[int]]:
    """Links that connect whatever texts, given as shingle hashes, are similar enough.

    With ``side``, only pairs of different sides are compared.
    """
    codes = np.array([majority(x) for x in found], np.uint64)
    sets = [np.unique(x) for x in found]
    sizes = np.array([len(x) for x in sets])
    labels, us, vs = np.arange(len(sets)), [], []
    for k, others in candidates(codes, WIDE):
        own, size = sets[k], sizes[k]
        near = (labels[others] != labels[k]) & (np.minimum(sizes[others], size) >= similarity * np.maximum(sizes[others], size) - 1e-9)
        if side is not None:
            near &= side[others] != side[k]
        others = others[near]
        if not len(others):
            continue
        every = np.concatenate([sets[x] for x in others])
        hit = own[np.minimum(np.searchsorted(own, every), size - 1)] == every
        common = np.add.reduceat(hit, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        linked = others[common >= similarity * (size + sizes[others] - common) - 1e-9]
        us += [k] * len(linked)
        vs += linked.tolist()
        labels[np.isin(labels, labels[linked])] = labels[k]
    return us, vs


def compared(dealt: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """``u, v``: confirmed links of ``key, part, side, row`` with ``texts`` (``row, text``).

    Rows of one key and part are compared; of those with a side, pairs of two sides only.
    """
    wanted = only(texts, dealt.select("row").distinct(), "row", "left_semi")
    rows = dealt.hint("merge").join(wanted, "row").select("key", "part", "side", "row", "text")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (tuple(x.as_py() for x in row) for batch in batches for row in zip(*batch.columns))
        for _, members in groupby(each, lambda row: row[:2]):
            found, rows, side = [], [], []
            for _, _, s, row, text in members:
                found.append(shingles(text, size))
                rows.append(row)
                side.append(s)
            u, v = confirmed(found, None if side[0] is None else np.array(side), similarity)
            if u:
                at = np.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(at[u]), pa.array(at[v])], names=["u", "v"])

    return rows.mapInArrow(lean(run), "u bigint, v bigint")


def similar(members: DataFrame, groups: DataFrame, texts: DataFrame, size: int, similarity: float, limit: int) -> DataFrame:
    """``node, root``: components of the links in ``groups`` (``key, n, pivot``) of ``members`` (``key, row``).

    A group of more than ``limit`` rows is cut into parts. First each part is compared in itself
    and with the group's pivot, which joins what is like the pivot in all of them. Then the
    rows outside the group's largest component meet the other parts; pairs of one component are
    connected already, so no link is lost, and a group of near copies takes no pairs of parts.
    """
    total = members.count()
    each = meet(members, groups.withColumn("count", F.col("n")), "key", total)
    parts = F.ceil(F.col("count") / limit).cast("int")
    part = F.pmod(F.xxhash64("row"), parts).cast("int")
    each = cut(each.select("key", "row", "pivot", "count", parts.alias("parts"), part.alias("part")))
    side = F.lit(None).cast("bigint").alias("side")
    first = each.select("key", "part", side, "row")
    pivots = groups.filter(F.col("n") > limit).select("key", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / limit).cast("int") - 1)).alias("part"), side, F.col("pivot").alias("row"))
    pivots = pivots.join(each.filter("row = pivot").select("key", F.col("part").alias("own")), "key").filter("part <> own").drop("own")
    linked = cut(compared(first.unionByName(pivots), texts, size, similarity).distinct())
    found = components(linked)
    large = each.filter(F.col("count") > limit)
    if not large.limit(1).count():
        return found
    labelled = cut(large.join(found, large["row"] == found["node"], "left").select(*large.columns, F.coalesce("root", "row").alias("side")))
    most = labelled.groupBy("key", "side").count().groupBy("key").agg(F.max_by("side", F.struct("count", "side")).alias("most"), F.sum("count").alias("n"))
    outside = meet(labelled, most, "key", total).filter("side <> most").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    outside = cut(outside.filter("to <> part").select("key", F.col("to").alias("part"), "side", "row"))
    wanted = outside.select("key", "part").distinct()
    inside = labelled.join(wanted, ["key", "part"], "left_semi").select("key", "part", "side", "row")
    return components(linked.unionByName(compared(outside.unionByName(inside), texts, size, similarity)))


def one_of_similar(docs: DataFrame, similarity: float = SIMILARITY, size: int = SIMILAR_SHINGLE, limit: int = TEXTS) -> DataFrame:
    """``docs`` with one row of each component of similar texts: that of the smallest id, null last.

    Rows of one set of shingles are one node, so that copies cost nothing; of equal ids the row
    that is read first stays. Null, empty and blank texts are one node. Groups are the ``classes``
    of fingerprints and the bands; groups of the same nodes (by their number, least row and two
    mixed hashes) are compared once. All columns are kept, whatever their names. Texts are shuffled
    to the groups that they are in; ids tell which are in one and which rows go, and are sent to
    the texts as long as their number allows it.
    """

    def work() -> Callable[[list[str]], list[tuple]]:
        def one(text: str) -> tuple:
            every = shingles(text, size)
            found = np.unique(every)
            return xxhash.xxh3_128_digest(found.tobytes()), bands(found), int(majority(every).view(np.int64))

        return lambda texts: [one(text) for text in texts]

    plain = by_position(docs)
    text, doc_id = (f"c{docs.columns.index(c)}" for c in ("text", "doc_id"))
    fields = [("digest", "binary", pa.binary()), ("bands", "array<bigint>", pa.list_(pa.int64())), ("fp", "bigint", pa.int64())]
    found = map_texts(plain.select(F.struct(*plain.columns).alias("doc_id"), F.col(text).cast("string").alias("text")), fields, work)
    kept = store(found.select(F.col("doc_id").alias("all"), "digest", "bands", "fp").withColumn("row", F.monotonically_increasing_id()), "similar")
    key = F.struct(F.col(f"all.{doc_id}").isNull().alias("none"), F.col(f"all.{doc_id}").alias("doc_id"), "row", "fp").alias("key")
    nodes = cut(kept.select("digest", "bands", key).groupBy("digest").agg(F.min("key").alias("key"), F.first("bands").alias("bands")))
    nodes = nodes.select("key", F.col("key.row").alias("row"), F.col("key.fp").alias("fp"), "bands")
    close = cut(nodes.select("row", "fp").join(classes(nodes), "fp").select("row", F.col("root").alias("key")))
    members = nodes.select("row", F.explode("bands").alias("key")).unionByName(close)
    mixed = (F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"mixed{k}") for k in range(2))
    groups = members.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("pivot"), *mixed).filter("n > 1")
    groups = cut(groups.groupBy("n", "pivot", "mixed0", "mixed1").agg(F.min("key").alias("key")).select("key", "n", "pivot"))
    linked = similar(members, groups, kept.select("row", F.col(f"all.{text}").cast("string").alias("text")), size, similarity, limit)
    named = nodes.join(linked, nodes["row"] == linked["node"], "left").groupBy(F.coalesce("root", "row").alias("root"))
    chosen = named.agg(F.min("key").alias("key")).select(F.col("key.row").alias("row"))
    gone = kept.select("row").join(chosen, "row", "left_anti")
    return only(kept, gone, "row", "left_anti").select("all.*").toDF(*docs.columns)
