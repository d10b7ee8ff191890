"""Token counts with overlap resynchronisation for huge documents.

A text up to ``chunk`` characters is encoded whole. A longer one is cut into chunks that
overlap, each encoded with offsets; a chunk begins where the one before it begins a token.
Two neighbours are spliced at a token that both have at the same place, away from the ends
of the overlap: tokens before it are taken from the left chunk, it and later ones from the
right one. Where there is no such token the overlap is widened twofold, at last to the whole
rest of the text.

Why such a token is a stable boundary. *Merges*: two tokens are neighbours in an encoding if
no merge that the two of them allow reaches over their border, whatever stands further away;
so a sequence is the encoding of its text if each pair of neighbours in it is one in some
encoding. All pairs up to the common token are from the left chunk, all from it on from the
right one. *Words*: they are runs that are found from left to right without looking back, so
two scans that are inside one run, or at one border, go on alike. *Normalising* takes white
space together and composes characters; a boundary begins a token, so it isn't white space,
and stands before a character that composes with none before it. *Special strings* are
shorter than ``MARGIN``, and the left chunk, which reaches beyond, would show one here.

Memory is bounded by the chunk, whether or not a text has white space, unless no overlap
has a common token.

Defined results: a null text is an empty one with no tokens; repeated rows give
repeated rows; an empty table gives an empty one; other columns are left out. Strings
of special tokens inside a text are handled as the library does by default. Of several
common tokens the one nearest to the middle of the overlap is taken, which alters nothing.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import id_and_text, map_texts

CHUNK = 65_536
OVERLAP = 512
#: Characters between a splice and either end of the overlap.
MARGIN = 64


@lru_cache(maxsize=1)
def trailing() -> frozenset[str]:
    """Characters that can be composed with the one before them: marks, the second parts of
    canonical decompositions, and the vowels and finals of Hangul syllables."""
    out = {chr(k) for k in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for k in range(0x110000):
        c = chr(k)
        if unicodedata.combining(c):
            out.add(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """One for each Python worker, with the library's own threads off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class Chunk:
    """The tokens of text[start:end]: ids and offsets in the text."""

    def __init__(self, tok, text: str, start: int, end: int):
        made = tok.encode(text[start:end], add_special_tokens=False)
        self.start, self.end = start, end
        self.ids = np.array(made.ids, dtype=np.int64)
        offsets = np.array(made.offsets, dtype=np.int64).reshape(-1, 2) + start
        self.begins, self.ends = offsets[:, 0], offsets[:, 1]

    def token(self, k: int) -> tuple[int, ...]:
        return tuple(int(x[k]) for x in (self.ids, self.begins, self.ends) if k < len(x))

    def clean(self) -> np.ndarray:
        """Numbers of the tokens that begin where the one before has ended."""
        if not len(self.ids):
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.append(True, (self.begins[1:] >= self.ends[:-1]) & (self.begins[1:] > self.begins[:-1])))

    def start_before(self, text: str, p: int) -> int | None:
        """The last place at or before p where a token begins that a chunk may begin with."""
        clean = self.clean()
        for k in clean[: np.searchsorted(self.begins[clean], p, side="right")][::-1].tolist():
            if text[self.begins[k]] not in trailing():
                return int(self.begins[k])
        return None


def splice(text: str, left: Chunk, right: Chunk) -> tuple[int, int] | None:
    """Numbers of a common token in both chunks where they may be spliced, or None."""
    a, b = (c.clean() for c in (left, right))
    places, i, j = np.intersect1d(left.begins[a], right.begins[b], assume_unique=True, return_indices=True)
    i, j = a[i], b[j]
    same = (left.ids[i] == right.ids[j]) & (left.ends[i] == right.ends[j])
    same &= (places >= right.start + MARGIN) & (left.ends[i] <= left.end - MARGIN)
    found = np.flatnonzero(same)
    for k in found[np.argsort(np.abs(places[found] - (right.start + left.end) / 2), kind="stable")].tolist():
        if text[places[k]] not in trailing():
            return int(i[k]), int(j[k])
    return None


def count_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of a long text, and the number of times that an overlap was widened."""
    total, widened, first = 0, 0, 0  # ``first``: the left chunk's first token that isn't counted yet
    left = Chunk(tok, text, 0, min(chunk, len(text)))
    while left.end < len(text):
        reach = overlap
        while True:
            start = left.start_before(text, left.end - reach)
            right = None if start is None or start <= left.start else Chunk(tok, text, start, min(left.end + chunk, len(text)))
            met = splice(text, left, right) if right else None
            if met and met[0] >= first:
                total, first, left = total + met[0] - first, met[1], right
                break
            widened += 1
            if right is None:  # no place to splice: one chunk, twice as long
                longer = Chunk(tok, text, left.start, min(left.start + 2 * (left.end - left.start), len(text)))
                if first and longer.token(first) != left.token(first):  # all that is left: the whole
                    return len(tok.encode(text, add_special_tokens=False).ids), widened
                left = longer
                break
            reach *= 2
    return total + len(left.ids) - first, widened


def count(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, n_widened, over_limit`` of each document.

    ``path`` is a tokenizer file that every executor can read. ``n_widened`` tells how
    often an overlap had to be widened.
    """

    def work() -> Callable[[list[str]], list[tuple]]:
        tok = tokenizer(path)

        def many(texts: list[str]) -> list[tuple]:
            short = [t for t in texts if len(t) <= chunk]
            made = iter([len(e.ids) for k in range(0, len(short), 64) for e in tok.encode_batch_fast(short[k : k + 64], add_special_tokens=False)])
            return [(next(made), 0) if len(t) <= chunk else count_long(tok, t, chunk, overlap) for t in texts]

        return many

    fields = [("n_tokens", "bigint", pa.int64()), ("n_widened", "int", pa.int32())]
    texts = id_and_text(docs, id_col, text_col)
    keyed = texts.select(F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")).alias("doc_id"), "text")
    out = map_texts(keyed, fields, work)
    return out.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_widened")
