"""Personal data: base patterns, and a skip-chain conditional random field on top.

The base patterns find e-mail addresses, IP addresses, card and phone numbers. A
document's sites are its tokens with a digit or an ``@``, and tokens that are the local
part of an address found in it. Sites inside a base span have that span's label, which is
observed; the field infers the others. Neighbouring sites share a transition potential.
Distant sites with the same key (the last seven digits, the same mixed or dotted token, or
an address and its local part) share a skip potential: to observed ones directly, and
among the others through a hub variable for the key, so that a key that stands n times
costs n messages and no n * n edges. Loopy message passing makes the labels consistent
over the document; sites that get a label other than "none" with at least ``SURE`` become
further spans. Base spans always stay.

The weights are learnt by pseudo-likelihood under masking. A site in a base span is a
training row as it stands, and once more with its label hidden: its marks (those that the
base patterns look for) and neighbours are blanked, and only its plain shape and the label
of its linked mentions are left to recover it from; without those, the same shape is an
example of "none". A site that isn't in a base span but shares a key with one is no
example of "none": it is left out of training.

The training rows come from at most ``SAMPLE`` distinct texts, those of the smallest
hashes, and at most ``SITES`` sites of each (every observed site before the others, then
evenly spaced). They are made inside the executors; no text reaches the driver. So the
field is the same however the table is partitioned and however often a text is copied.

Defined results: a null text is an empty one with no spans; repeated rows give repeated
rows; an empty table gives an empty one (and a field without weights, which adds
nothing); other columns, whatever their names, are left out by ``find`` and kept by
``redact``. Equal probabilities of two labels go to the kind listed first; spans of one
place go by start, kind, end. Each text is read whole, in time linear in its length; the
field holds about 120 bytes for each site, and a text is worked on by itself where it is
longer than ``common.CHUNK_CHARS``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import by_position, bound_batches, chunks, id_and_text, lean, map_texts

KINDS = ["email", "ip", "card", "phone"]
NONE = len(KINDS)
LABELS = NONE + 1
SAMPLE = 2000
SITES = 64
SURE = 0.9
#: Rounds of message passing at most, and the change of a message that ends it.
ROUNDS, STILL = 24, 1e-4
#: Characters of a text that are split into sites at once.
PIECE = 2_000_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HINT = re.compile("[0-9@]")
SPACE = re.compile(r"\s")
TOKEN = re.compile(r"\S+")
NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start and kind."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    out.sort(key=lambda s: (s[1], s[0]))
    return out


@lru_cache(maxsize=1)
def kinds_of_character() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is white space, and whether it is a letter."""
    every = list(map(chr, range(0x110000)))
    return np.fromiter(map(str.isspace, every), bool, 0x110000), np.fromiter(map(str.isalpha, every), bool, 0x110000)


def _counts(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
    return total[ends] - total[starts]


#: Feature numbers: 0 for every site, then counts of digits, dots and letters, then marks.
DIGITS, DOTS, SOME_LETTERS, MARKS, BLANK = 1, 22, 27, 31, 40
FEATURES = BLANK + 1
AT, LEAD, BRACKET, DASH, LUHN, FOUR, PLAIN, MIXED, LOCAL_LENGTH = range(MARKS, BLANK)
#: What the base patterns look for: hidden where a label is.
HIDDEN = [AT, LEAD, BRACKET, LUHN, FOUR]
SLOTS = 4 + BLANK - MARKS
NAMED = 10**7
#: Sites whose messages are worked out at once: few enough for one thread and its cache.
BLOCK = 1 << 13


def _piece(text: str, local: set[str]) -> tuple[np.ndarray, ...]:
    """Starts, ends, features and keys of the sites of a piece that is cut between tokens.

    Here a key is the number of its last seven digits, NAMED where ``key`` has to tell it,
    or -1 for none.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space, letter = kinds_of_character()
    blank = np.concatenate([[True], space[c], [True]])
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    digit, at = (c >= 48) & (c <= 57), c == 64
    n, ats = _counts(digit, starts, ends), _counts(at, starts, ends)
    site = (n > 0) | (ats > 0)
    if local:
        found = [core(text[a:b]).lower() in local for a, b in zip(starts.tolist(), ends.tolist())]
        site |= np.array(found, bool)
    starts, ends, n, ats = starts[site], ends[site], n[site], ats[site]
    if not len(starts):
        return starts, ends, np.zeros((0, SLOTS), np.int8), starts
    dots, letters = _counts(c == 46, starts, ends), _counts(letter[c], starts, ends)
    dashes, brackets = _counts(c == 45, starts, ends), _counts(c == 40, starts, ends)
    other = ends - starts - n - dots - letters
    sum_checked = np.zeros(len(starts), bool)
    for k in np.flatnonzero((n >= 12) & (n <= 19)).tolist():
        sum_checked[k] = luhn(NOT_DIGIT.sub("", text[starts[k] : ends[k]]))
    marks = [
        ats > 0, c[starts] == 43, brackets > 0, dashes > 0, sum_checked, (dots == 3) & (letters == 0) & (n >= 4),
        (letters == 0) & (other == 0) & (dots == 0), (letters > 0) & (n > 0) & (other == 0), (n == 7) | (n == 10),
    ]
    x = np.full((len(starts), SLOTS), BLANK, np.int8)
    x[:, 0] = 0
    x[:, 1] = DIGITS + np.minimum(n, 20)
    x[:, 2] = DOTS + np.minimum(dots, 4)
    x[:, 3] = SOME_LETTERS + np.minimum(letters, 3)
    for k, mark in enumerate(marks):
        x[mark, 4 + k] = MARKS + k
    keys = np.full(len(starts), -1)
    long = np.flatnonzero(n >= 7)
    place, value = np.cumsum(digit)[ends[long] - 1], c[digit].astype(np.int64) - 48
    keys[long] = sum(value[place - 1 - k] * 10**k for k in range(7))
    # A name takes five characters at least, or four digits with two dots.
    keys[(letters > 0) | (ats > 0) | (dots >= 2)] = -1
    keys[((letters > 0) | (ats > 0) | (dots >= 2)) & (ends - starts >= 5)] = NAMED
    return starts, ends, x, keys


def sites(text: str, local: set[str] = frozenset()) -> tuple[np.ndarray, ...]:
    """Starts, ends, features and keys of tokens that hold a digit or an @, or are in ``local``."""
    if len(text) <= PIECE:
        return _piece(text, local)
    parts, at = [], 0
    while at < len(text):
        stop = SPACE.search(text, at + PIECE)
        end = stop.end() if stop else len(text)
        a, b, x, keys = _piece(text[at:end], local)
        parts.append((a + at, b + at, x, keys))
        at = end
    return tuple(map(np.concatenate, zip(*parts)))


EDGE = ".,;:!?#$%&*\"'()[]{}<>|=+"


def core(token: str) -> str:
    return token.strip(EDGE)


def key(token: str) -> str | None:
    """What mentions of one thing share; None for tokens too plain to be linked."""
    token = core(token).lower()
    if "@" in token:
        token = token.partition("@")[0]
    digits = NOT_DIGIT.sub("", token)
    if any(c.isalpha() for c in token):
        return token if len(token) >= 5 and not token.isalpha() else None
    if token.count(".") >= 2:
        return token if len(digits) >= 4 else None
    return digits[-7:] if len(digits) >= 7 else None


class Graph:
    """The sites of texts: places, features, observed labels (-1: none), links.

    ``hub`` is a number for each key of a text, -1 for sites without; ``seen`` the label that
    most observed mentions of the key have, -1 where there is none.
    """

    def __init__(self, texts: list[str], spans: list[list[Span]]):
        parts, hubs, seen, owners, at = [], [], [], [], 0
        for number, (text, found) in enumerate(zip(texts, spans)):
            names = [(key(text[a:b]), kind) for kind, a, b in found]
            starts, ends, x, keys = sites(text, {name for name, kind in names if name and kind == 0})
            labels = np.full(len(starts), -1, np.int8)
            for kind, a, b in reversed(found):
                labels[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = kind
            mine: dict[str, int] = {}

            def numbered(name: str | None, mine: dict[str, int] = mine) -> int:
                if name is None:
                    return -1
                return int(name) if name.isdigit() else NAMED + mine.setdefault(name, len(mine))

            for k in np.flatnonzero(keys == NAMED).tolist():
                keys[k] = numbered(key(text[starts[k] : ends[k]]))
            keyed = np.flatnonzero(keys >= 0)
            known, hub = np.unique(keys[keyed], return_inverse=True)
            votes = np.zeros((len(known), NONE), np.int32)
            inside = labels[keyed] >= 0
            np.add.at(votes, (hub[inside], labels[keyed][inside]), 1)
            for name, kind in names:
                code = numbered(name)
                place = int(np.searchsorted(known, code))
                if place < len(known) and known[place] == code:
                    votes[place, kind] += 1
            told = np.where(votes.any(axis=1), votes.argmax(axis=1), -1).astype(np.int8)
            hubs.append(np.full(len(starts), -1, np.int32))
            seen.append(np.full(len(starts), -1, np.int8))
            hubs[-1][keyed] = hub + at
            seen[-1][keyed] = told[hub]
            at += len(known)
            parts.append((starts, ends, x, labels))
            owners.append(np.full(len(starts), number, np.int32))
        self.starts, self.ends, self.x, self.labels = map(np.concatenate, zip(*parts))
        self.hub, self.seen, self.owner = map(np.concatenate, (hubs, seen, owners))
        # Two sites with keys are two things and not one in two tokens.
        beside = (self.starts[1:] - self.ends[:-1] <= 1) & (self.owner[1:] == self.owner[:-1])
        self.next_to = beside & ((self.hub[1:] < 0) | (self.hub[:-1] < 0))  # whether site k + 1 stands beside site k


def scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of each row's features; those of BLANK are zero."""
    out = np.zeros((len(x), LABELS), np.float32)
    table = weights.astype(np.float32)
    for k in range(0, len(x), BLOCK):
        for slot in range(x.shape[1]):
            out[k : k + BLOCK] += table[x[k : k + BLOCK, slot]]
    return out


class Field:
    """Weights of the field: by feature and label, by neighbours' labels, and for agreement."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, agree: float):
        self.weights, self.steps, self.agree = weights, steps, agree
        # Two links through a hub are to weigh as much as one direct link:
        # (x^2 + k - 1) / (2 x + k - 2) = exp(agree) for x = exp(hub).
        k, direct = LABELS, float(np.exp(agree))
        self.hub = float(np.log(direct + np.sqrt(direct**2 + direct * (k - 2) - (k - 1))))

    def infer(self, g: Graph) -> np.ndarray:
        """Probability of each label at each site, by loopy message passing."""
        own = scores(g.x, self.weights)
        free = g.labels < 0
        told = np.flatnonzero(free & (g.seen >= 0))
        own[told, g.seen[told]] += self.agree
        own -= own.max(axis=1, keepdims=True)
        np.exp(own, out=own)
        held = np.flatnonzero(~free)
        own[held] = 0
        own[held, g.labels[held]] = 1
        joined = (g.next_to & (free[1:] | free[:-1]))[:, None]
        blocks = [(k, min(k + BLOCK, len(joined))) for k in range(0, len(joined), BLOCK)]
        linked = np.flatnonzero(free & (g.hub >= 0))
        _, hub, size = np.unique(g.hub[linked], return_inverse=True, return_counts=True)
        linked, hub = linked[size[hub] > 1], hub[size[hub] > 1]
        step = np.exp(self.steps - self.steps.max()).astype(np.float32)
        apart = np.float32(np.exp(-self.hub))
        over_link = lambda x: _shared(apart * _sum(x) + (1 - apart) * x)
        # What comes to each site from the one before it and the one after it. ``own`` holds
        # what comes from the hub, too. Blocks are taken so that none sees news of its round.
        right, left = np.ones_like(own), np.ones_like(own)
        plain, down = own[linked], np.ones((len(linked), LABELS), np.float32)
        for _ in range(ROUNDS):
            change = 0.0
            for a, b in reversed(blocks):
                new = np.where(joined[a:b], _shared((own[a:b] * right[a:b]) @ step), 1)
                change = max(change, float(np.abs(new - right[a + 1 : b + 1]).max()))
                right[a + 1 : b + 1] = new
            for a, b in blocks:
                new = np.where(joined[a:b], _shared((own[a + 1 : b + 1] * left[a + 1 : b + 1]) @ step.T), 1)
                change = max(change, float(np.abs(new - left[a:b]).max()))
                left[a:b] = new
            if len(linked):
                up = np.log(over_link(plain * right[linked] * left[linked]))
                rest = np.column_stack([np.bincount(hub, up[:, k], len(size)) for k in range(LABELS)])[hub] - up
                new = over_link(np.exp(rest - rest.max(axis=1, keepdims=True)).astype(np.float32))
                change = max(change, float(np.abs(new - down).max()))
                down = new
                own[linked] = plain * down
            if change < STILL:
                break
        own *= right
        own *= left
        return _shared(own)

    def more_spans(self, texts: list[str], spans: list[list[Span]]) -> list[list[Span]]:
        """Spans that the field adds to the base spans of each text."""
        out: list[list[Span]] = [[] for _ in texts]
        g = Graph(texts, spans)
        if not (g.labels < 0).any():
            return out
        p = self.infer(g)
        best = p.argmax(axis=1)
        sure = (best != NONE) & (p.max(axis=1) >= SURE) & (g.labels < 0)
        last = -2
        for k in np.flatnonzero(sure).tolist():
            text, mine = texts[g.owner[k]], out[g.owner[k]]
            a, b = int(g.starts[k]), int(g.ends[k])
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if a == b:
                continue
            if last == k - 1 and g.next_to[last] and mine and mine[-1][0] == best[k]:
                mine[-1] = (mine[-1][0], mine[-1][1], b)
            else:
                mine.append((int(best[k]), a, b))
            last = k
        return out


def _sum(x: np.ndarray) -> np.ndarray:
    return sum(x.T)[:, None]


def _shared(x: np.ndarray) -> np.ndarray:
    x /= np.maximum(_sum(x), 1e-30)
    return x


#: A training row: its features, the labels before and after it and at its links (-1: there
#: is none, or it is hidden), and its own label.
COLUMNS = SLOTS + 4


def training_rows(text: str, most: int = SITES) -> np.ndarray:
    """The training rows of a text."""
    g = Graph([text], [base_spans(text)])
    n = len(g.labels)
    if not n:
        return np.zeros((0, COLUMNS), np.int8)
    y = np.where(g.labels < 0, NONE, g.labels).astype(np.int8)
    before, after = np.full(n, -1, np.int8), np.full(n, -1, np.int8)
    pairs = np.flatnonzero(g.next_to)
    before[pairs + 1], after[pairs] = y[pairs], y[pairs + 1]
    _, number, size = np.unique(g.hub, return_inverse=True, return_counts=True)
    several = (g.hub >= 0) & (size[number] > 1)
    link = np.where(g.seen >= 0, g.seen, np.where(several, NONE, -1)).astype(np.int8)
    observed = g.labels >= 0
    link[observed & ~several] = -1
    rest = np.flatnonzero(~observed & (g.seen < 0))  # others may be mentions: no example of "none"
    room = max(0, most - int(observed.sum()))
    if len(rest) > room:
        rest = rest[np.linspace(0, len(rest) - 1, room).astype(int)] if room else rest[:0]
    seen = np.flatnonzero(observed)[:most]
    chosen = np.sort(np.concatenate([seen, rest]))
    rows = np.column_stack([g.x, before, after, link, y])
    masked = rows[seen[g.hub[seen] >= 0]].copy()
    for mark in HIDDEN:
        masked[:, 4 + mark - MARKS] = BLANK
    masked[:, SLOTS : SLOTS + 2] = -1
    masked[:, SLOTS + 2] = masked[:, SLOTS + 3]
    alone = masked.copy()  # with nothing to recover it from, the plain shape is no personal data
    alone[:, SLOTS + 2], alone[:, SLOTS + 3] = -1, NONE
    return np.concatenate([rows[chosen], masked, alone])


def fit_rows(rows: np.ndarray, rounds: int = 1500, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Weights that maximise the pseudo-likelihood of the training rows, by Adam."""
    weights, steps, agree = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(1)
    if not len(rows):
        weights[0, NONE] = 50.0
        return Field(weights, steps, 0.0)
    rows, often = np.unique(rows, axis=0, return_counts=True)
    hot = lambda c: np.eye(LABELS + 1)[c][:, :LABELS]  # of -1: all zero
    x = np.zeros((len(rows), FEATURES))
    for slot in range(SLOTS):
        x[np.arange(len(rows)), rows[:, slot]] = 1
    x[:, BLANK] = 0
    before, after, link, y = (hot(rows[:, SLOTS + k]) for k in range(4))
    share = (often / often.sum())[:, None]
    held = [weights, steps, agree]
    mean, square = [np.zeros_like(w) for w in held], [np.zeros_like(w) for w in held]
    for t in range(1, rounds + 1):
        score = x @ weights + before @ steps + after @ steps.T + agree * link
        p = np.exp(score - score.max(axis=1, keepdims=True))
        miss = (y - p / p.sum(axis=1, keepdims=True)) * share
        slopes = [x.T @ miss, before.T @ miss + miss.T @ after, np.array([(miss * link).sum()])]
        for w, slope, m, s in zip(held, slopes, mean, square):
            slope -= decay * w
            m += 0.1 * (slope - m)
            s += 0.001 * (slope**2 - s)
            w += rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Field(weights, steps, max(float(agree[0]), 0.0))


def fit(texts: list[str]) -> Field:
    return fit_rows(np.concatenate([np.zeros((0, COLUMNS), np.int8), *map(training_rows, sorted(set(texts)))]))


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field:
    """A field from the training rows of the ``sample`` distinct texts of the smallest hashes."""
    bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    hashed = docs.select(F.xxhash64(text, F.lit("sample")).alias("h"), text.alias("text")).filter(F.col("text").rlike("[0-9@]"))
    least = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if least is None:
        return fit_rows(np.zeros((0, COLUMNS), np.int8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if h not in met:
                    met.add(h)
                    made = training_rows(text.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([made.tobytes()], pa.binary())], names=["h", "rows"])

    drawn = hashed.filter(F.col("h") <= F.lit(least)).mapInArrow(lean(run), "h bigint, rows binary")
    # One row a text: at most SAMPLE * 3 * SITES * COLUMNS bytes.
    rows = drawn.groupBy("h").agg(F.max("rows")).collect()
    return fit_rows(np.concatenate([np.frombuffer(bytes(r[1]), np.int8).reshape(-1, COLUMNS) for r in rows]))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def all_spans(texts: list[str], field: Field) -> list[list[dict]]:
    """The spans of each text, base and added."""
    out: list[list[dict]] = [[] for _ in texts]
    some = [k for k, text in enumerate(texts) if HINT.search(text)]
    if not some:
        return out
    held = [texts[k] for k in some]
    base = [base_spans(text) for text in held]
    for k, found, more in zip(some, base, field.more_spans(held, base)):
        every = sorted([(s, True) for s in found] + [(s, False) for s in more], key=lambda s: (s[0][1], s[0][0], s[0][2]))
        out[k] = [{"kind": KINDS[kind], "start": a, "end": b, "base": is_base} for (kind, a, b), is_base in every]
    return out


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: kind, start and exclusive end in code points, base or not."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def work() -> Callable[[list[str]], list[tuple]]:
        known = held.value
        return lambda texts: [(spans,) for spans in all_spans(texts, known)]

    return map_texts(id_and_text(docs, id_col, text_col), [("spans", SPANS, ARROW)], work)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[dict]) -> str:
    """The text with ``[KIND]`` in place of each span; overlapping spans become one."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with personal data masked; ``n_chars`` follows the text where it changes."""
    bound_batches(docs.sparkSession)
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(field)
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            columns = list(batch.columns)
            old, new = columns[text_at].to_pylist(), []
            for part in chunks(old):
                new += [masked(text, spans) for text, spans in zip(part, all_spans(part, known))]
            new = [None if a is None else b for a, b in zip(old, new)]
            columns[text_at] = pa.array(new, columns[text_at].type)
            if chars_at is not None:
                same = [n if a == b else len(b) for a, b, n in zip(old, new, columns[chars_at].to_pylist())]
                columns[chars_at] = pa.array(same, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    plain = by_position(docs)
    return plain.mapInArrow(lean(run), plain.schema).toDF(*names)
