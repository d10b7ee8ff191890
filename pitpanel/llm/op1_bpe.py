"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The words of a corpus of documents are gathered first, each distinct word once. An inverted
index from token pair to word positions then applies the merges in rank order to all words
together: one step a pair, over all its places at once, which touches only the neighbours of
the places where the pair stands. Documents are put together from the encoded words.

Which words are gathered together does not alter the result. A corpus is what a task reads,
up to ``CORPUS_CHARS`` at a time, and words that a task has met before are not replayed; new
ones are replayed ``REPLAY_CHARS`` at a time, which bounds the memory of a replay. One
table of all words of a large input would need a second pass over the texts and a shuffle of
the words there and back, which costs more than the replay does (figures in the README).

Defined results: a null text is an empty one and has no tokens; repeated rows give
repeated rows; an empty table gives an empty one; other columns are left out; of overlapping
places of a pair the left one goes first. A text of any length is split into words lazily; a
text longer than ``CORPUS_CHARS`` is a corpus by itself.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import bound_batches, chunks, give_back, id_and_text, lean

#: Words that a task remembers; beyond it begins anew.
MEMO = 600_000
#: Text whose new words one replay takes together.
CORPUS_CHARS = 32_000_000
#: Words of documents that are put together at once.
RUN = 200_000
#: Characters of new words that one replay takes together: it needs some 36 bytes of memory a byte.
REPLAY_CHARS = 1_000_000
#: Places of a replay whose first pairs are sorted at once.
BLOCK = 500_000


class MergeReplay:
    """Token ids of words under a table of ranks (token bytes -> rank, which is its id)."""

    def __init__(self, ranks: dict[bytes, int], token: dict[int, bytes] | None = None):
        self.ranks = ranks
        self.token = token or {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.first = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        # Every way to cut a token into two: what may stand after a token, and before it.
        cuts = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        table = np.array(cuts, np.int32).reshape(-1, 3)
        self.behind, self.ahead = self._sides(table[:, [0, 1, 2]]), self._sides(table[:, [1, 0, 2]])

    def _sides(self, table: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        edges = np.searchsorted(table[:, 0], np.arange(max(self.token) + 2)).tolist()
        return edges, np.ascontiguousarray(table[:, 1]), np.ascontiguousarray(table[:, 2])

    @staticmethod
    def _joined(sides: tuple[list[int], np.ndarray, np.ndarray], token: int, others: np.ndarray) -> np.ndarray | None:
        """The ranks of a token with those on one side of it, -1 where there is none; None for none at all."""
        edges, other, rank = sides
        a, b = edges[token], edges[token + 1]
        if a == b:
            return None
        at = np.searchsorted(other[a:b], others)
        at[at == b - a] = 0
        return np.where(other[a:b][at] == others, rank[a:b][at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed as unsigned 32-bit little-endian integers.

        All places of one pair are merged at once; of overlapping ones the left goes first. A
        word in which a merge gives rise to a pair of an earlier rank, which has to go before
        its other places, is done again by itself.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        if not len(data):
            return [b""] * len(words)
        ends = np.cumsum([len(word) for word in words])
        last = np.unique(ends[ends > 0]) - 1  # the last place of each word
        places = np.arange(len(data), dtype=np.int32)
        symbol = self.single[data]  # -1 where a token begins no more
        after, before = places + 1, places - 1
        del places
        after[last] = before[0] = before[last[:-1] + 1] = -1
        pair = np.full(len(data), -1, np.int32)  # the rank of the pair that starts here, or -1
        index: dict[int, list] = {}
        for a in range(0, len(data), BLOCK):  # sorting takes several times the memory of what is sorted
            block = data[a : a + BLOCK + 1].astype(np.int32)
            here = pair[a : a + BLOCK]
            here[: len(block) - 1] = self.first[block[:-1] << 8 | block[1:]]
            here[after[a : a + BLOCK] < 0] = -1
            order = np.argsort(here, kind="stable").astype(np.int32)
            order = order[np.searchsorted(here, 0, sorter=order) :]
            ranks = here[order]
            order += a
            edges = np.append(np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])), len(ranks)).tolist() if len(ranks) else []
            for x, y in zip(edges, edges[1:]):
                index.setdefault(int(ranks[x]), []).append(order[x:y])
        del data
        heap, early = list(index), []
        heapify(heap)

        def enter(r: int, at: np.ndarray, ranks: np.ndarray | None) -> None:
            """Pairs of these ranks now start at these places."""
            pair[at] = -1 if ranks is None else ranks
            if ranks is None:
                return
            some = ranks >= 0
            at, ranks = at[some], ranks[some]
            if not len(at):
                return
            if ranks.min() < r:
                early.append(at[ranks < r])
            if len(at) > 1 and (ranks[1:] != ranks[:-1]).any():
                order = ranks.argsort(kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            else:
                cuts = [0, len(at)]
            for a, b in zip(cuts, cuts[1:]):
                new = int(ranks[a])
                if new in index:
                    index[new].append(at[a:b])
                else:
                    index[new] = [at[a:b]]
                    heappush(heap, new)

        while heap:
            r = heappop(heap)
            held = index.pop(r)
            p = held[0] if len(held) == 1 else np.concatenate(held)
            p = p[pair[p] == r]
            if len(held) > 1 and len(p) > 1:
                p = np.sort(p)
                p = p[np.append(True, p[1:] != p[:-1])]
            if not len(p):
                continue
            q = after[p]
            over = p[1:] == q[:-1]
            if over.any():  # of a run of overlapping places, each second one
                number = np.arange(len(p))
                start = np.maximum.accumulate(np.where(np.append(True, ~over), number, 0))
                p = p[(number - start) % 2 == 0]
                q = after[p]
            following, preceding = after[q], before[p]
            inner = following >= 0
            p_in, f_in = p[inner], following[inner]
            was = symbol[f_in]
            symbol[p], symbol[q], pair[q] = r, -1, -1
            after[p] = following
            before[f_in] = p_in
            pair[p] = -1
            now = symbol[f_in]
            if (was != now).any():  # next to each other: the left one has met the right one's first token
                met = self._joined(self.behind, r, was)
                if met is not None:
                    early.append(p_in[(met >= 0) & (met < r)])
            enter(r, p_in, self._joined(self.behind, r, now))
            b_in = preceding[preceding >= 0]
            enter(r, b_in, self._joined(self.ahead, r, symbol[b_in]))
        del after, before, pair
        kept = symbol >= 0
        packed = symbol[kept].astype("<u4").tobytes()
        stops = (np.append(np.int32(0), np.cumsum(kept, dtype=np.int32))[ends].astype(np.int64) * 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *stops], stops)]
        if early:
            for k in np.unique(np.searchsorted(ends, np.concatenate(early), side="right")).tolist():
                out[k] = self.alone(words[k])
        return out

    def alone(self, word: bytes) -> bytes:
        """The ids of one word: at each step the least rank, and of its places the leftmost."""
        n, rank = len(word), self.ranks.get
        symbol = [bytes([b]) for b in word]
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        pair = [rank(word[k : k + 2], -1) for k in range(n - 1)] + [-1]
        heap = [(r, p) for p, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            r, p = heappop(heap)
            if pair[p] != r:
                continue
            q = after[p]
            symbol[p] += symbol[q]
            symbol[q], pair[q] = b"", -1
            after[p] = after[q]
            if after[q] >= 0:
                before[after[q]] = p
            for at in (p, before[p]):
                if at >= 0:
                    pair[at] = rank(symbol[at] + symbol[after[at]], -1) if after[at] >= 0 else -1
                    if pair[at] >= 0:
                        heappush(heap, (pair[at], at))
        return b"".join(self.ranks[t].to_bytes(4, "little") for t in symbol if t)


class Numbered(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Encodes texts; remembers the words it has met, up to a bound.

    Texts are taken in by ``read``, which keeps the numbers of their words; ``learn`` replays
    the merges over all words that are new since it was called last.
    """

    def __init__(self, replayer: MergeReplay, pattern: str):
        self.replayer = replayer
        self.pattern = regex.compile(pattern)
        self.numbers = Numbered()
        self.encoded: list[bytes] = []

    def read(self, text: str) -> np.ndarray:
        number = self.numbers.__getitem__
        if len(text) <= 4 * RUN:
            words = self.pattern.findall(text)
            return np.fromiter(map(number, words), np.int32, len(words))
        return np.fromiter((number(m.group()) for m in self.pattern.finditer(text)), np.int32)

    def learn(self) -> None:
        ranks = self.replayer.ranks
        for part in chunks(islice(self.numbers, len(self.encoded), None), REPLAY_CHARS):
            words = [w.encode() for w in part]
            made = iter(self.replayer.replay([w for w in words if w not in ranks]))
            self.encoded += [ranks[w].to_bytes(4, "little") if w in ranks else next(made) for w in words]

    def ids(self, numbers: np.ndarray) -> bytes:
        return b"".join(map(self.encoded.__getitem__, numbers.tolist()))

    def forget(self) -> None:
        """Begin anew where too much is held; numbers given before mean nothing then."""
        if len(self.numbers) > MEMO:
            self.numbers.clear()
            self.encoded.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        self.forget()
        numbers = [self.read(text) for text in texts]
        self.learn()
        return [self.ids(n) for n in numbers]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def replayer(path: str) -> MergeReplay:
    """Ranks and what follows from them, kept by each Python worker."""
    return MergeReplay(read_ranks(path))


def encoder(path: str, pattern: str) -> Encoder:
    """One for each task: what it remembers goes when the task ends."""
    return Encoder(replayer(path), pattern)


def token_bytes(path: str) -> dict[int, bytes]:
    return replayer(path).token


def decoded_bytes(ids: bytes, token: dict[int, bytes]) -> bytes:
    return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def pieces(numbers: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Documents in order, in lists of a bounded number of words."""
    held: list[np.ndarray] = []
    size = 0
    for n in numbers:
        if held and size + len(n) > RUN:
            yield held
            held, size = [], 0
        held.append(n)
        size += len(n)
    if held:
        yield held


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", and_decode: bool = False) -> DataFrame:
    """``doc_id, ids, n_tokens``; ``ids`` packs unsigned 32-bit little-endian integers.

    ``path`` is a file of ranks that every executor can read (base64 token, rank). With
    ``and_decode`` the ids are decoded again in the same pass, to a column ``decoded``.
    """

    docs = id_and_text(docs, id_col, text_col)
    bound_batches(docs.sparkSession)
    names = ["doc_id", "ids", "decoded"][: 2 + and_decode]
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} binary" for c in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, pattern)
        token = known.replayer.token
        held: list[tuple[pa.Array, list[np.ndarray]]] = []
        size = 0

        def encoded() -> Iterator[pa.RecordBatch]:
            give_back()  # what reading took
            known.learn()
            give_back()
            for ids, numbers in held:
                at = 0
                for part in pieces(numbers):
                    made = [known.ids(n) for n in part]
                    columns = [pa.array(made, pa.binary())]
                    if and_decode:
                        columns.append(pa.array([decoded_bytes(x, token) for x in made], pa.binary()))
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), *columns], names=names)
                    at += len(part)
            held.clear()
            known.forget()

        for batch in batches:
            texts, at = batch.column(1), 0
            for part in chunks(x.as_py() for x in texts):
                # A copy: a slice would keep the batch's texts, too.
                held.append((batch.column(0).take(pa.array(range(at, at + len(part)))), [known.read(text) for text in part]))
                at += len(part)
                size += sum(map(len, part))
                if size > CORPUS_CHARS or len(known.numbers) > MEMO:
                    yield from encoded()
                    size = 0
        yield from encoded()

    out = docs.mapInArrow(lean(run), schema)
    return out.withColumn("n_tokens", F.expr("cast(length(ids) div 4 as bigint)"))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with ``decoded``: the bytes that its packed ``ids`` stand for."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in tokens.schema)}, decoded binary"
    at = tokens.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = token_bytes(path)
        for batch in batches:
            texts = [decoded_bytes(x.as_py() or b"", token) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, schema)


def unpack(ids: bytes) -> list[int]:
    out = array("I")
    out.frombytes(ids)
    return out.tolist()


def digests(tokens: DataFrame) -> DataFrame:
    """The contract's columns of encoded and decoded documents."""
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
