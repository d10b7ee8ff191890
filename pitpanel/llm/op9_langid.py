"""Language identification by rank-order n-gram profiles.

A profile is a language's ``size`` most frequent letter n-grams (1 to 3 letters, a
word's edge counting as a letter at either end) in order of frequency, counted over
all labelled training texts. A document's own most frequent n-grams are compared to
each profile by the out-of-place distance: how far each n-gram's rank is from its rank
there, or ``size`` where the profile lacks it. The nearest language is predicted.

Counts are gathered in each task, summed by Spark, and only the profiles (languages
times ``size`` rows) reach the driver and are sent to the tasks.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is
every text if there is nothing to learn from; a tie goes to the language that sorts
first; n-grams of equal frequency go by length, then code points; training rows with null language
or text are left out; repeated rows count as often as they stand and give repeated
rows; an empty table gives an empty one; other columns are left out. Texts are read
whole, in pieces of bounded length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.llm.common import CHUNK_CHARS, by_position, chunks, id_and_text, lean, map_texts

SIZE = 300
UNKNOWN = "und"
EDGE = 1
WORD = re.compile(r"[^\W\d_]+")
#: n-grams that a task holds before it hands their counts on.
HELD = 400_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; each run of others, and either end, is one EDGE."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    raw = np.concatenate([[EDGE], np.where(letters()[raw], raw, EDGE), [EDGE]])
    return raw[np.concatenate([[True], (raw[1:] > EDGE) | (raw[:-1] > EDGE)])]


def grams(c: np.ndarray) -> np.ndarray:
    """The n-grams of such codes, each as one integer of 21 bits a letter."""
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    return np.concatenate([c[c > EDGE], two, three[c[1:-1] > EDGE]])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text in order, and how often each stands in it."""
    if len(text) <= CHUNK_CHARS:
        return np.unique(grams(codes(text)), return_counts=True)
    total: Counter[int] = Counter()
    at = 0
    while at < len(text):  # cut between words
        end = min(at + CHUNK_CHARS, len(text))
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        found, n = np.unique(grams(codes(text[at:end])), return_counts=True)
        total.update(dict(zip(found.tolist(), n.tolist())))
        at = end
    order = sorted(total)
    return np.array(order, np.int64), np.array([total[g] for g in order], np.int64)


class Profiles:
    """Ranks of n-grams by language, in one table: a row for each n-gram of any profile."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.languages = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int32)
        place = {lang: k for k, lang in enumerate(self.languages)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), place[lang]] = rank

    def predict(self, text: str) -> tuple[str, float]:
        found, n = counted(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        if len(found) > self.size:  # only those that can be among the most frequent
            least = np.partition(n, len(n) - self.size)[len(n) - self.size]
            near = n >= least
            found, n = found[near], n[near]
        top = found[np.lexsort((found, -n))[: self.size]]
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == top, at, len(self.grams))
        ranks = self.ranks[at]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(top))[:, None]), self.size).sum(axis=0)
        best = int(apart.argmin())
        return self.languages[best], 1.0 - float(apart[best]) / (self.size * len(top))


def learn(docs: DataFrame, size: int = SIZE, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """The profiles of the languages that the rows of ``docs`` are labelled with."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found)), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"]
                    )
            held.clear()

        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            for part in chunks(x.as_py() for x in batch.column(1)):
                words: dict[str, Counter[str]] = {}
                for lang, text in zip(langs[at : at + len(part)], part):
                    words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
                at += len(part)
                for lang, found in words.items():
                    by_count: dict[int, list[str]] = {}
                    for word, n in found.items():
                        by_count.setdefault(n, []).append(word)
                    total = held.setdefault(lang, Counter())
                    for n, same in by_count.items():
                        g, k = np.unique(grams(codes(" ".join(same))), return_counts=True)
                        total.update(dict(zip(g.tolist(), (k * n).tolist())))
                if sum(map(len, held.values())) > HELD:
                    yield from out()
        yield from out()

    counts = rows.mapInArrow(lean(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size)
    return Profiles([(r[0], r[1], r[2]) for r in top.select("lang", "gram", "rank").collect()], size)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each document; only its text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def work() -> Callable[[list[str]], list[tuple]]:
        known = held.value
        return lambda texts: [known.predict(text) for text in texts]

    fields = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())]
    return map_texts(id_and_text(docs, id_col, text_col), fields, work)


def fold(id_col: str = "doc_id") -> F.Column:
    """The fixed fold of a document, 0 to 3; 2 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 4


def train_and_predict(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from the folds that aren't held out.

    A null id is in no fold: its row isn't learnt from and isn't held out.
    """
    profiles = learn(docs.filter(fold(id_col) != 2), size)
    out = predict(docs, profiles, id_col)
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` without the rows of which no language is told; all columns stay, whatever their names."""
    plain = by_position(docs)
    rows = plain.select(F.struct(*plain.columns).alias("row"), plain[docs.columns.index("text")].alias("text"))
    return predict(rows, profiles, "row").filter(F.col("lang_pred") != UNKNOWN).select("doc_id.*").toDF(*docs.columns)
