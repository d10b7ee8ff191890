"""What proposes features to a search: uniform draws, an estimator, a language model.

A proposer has ``propose(history, accepted)``, which gives a spec as JSON, and ``observe(outcome)``,
which is told what became of it. Proposers run on the driver and touch no table.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from pitpanel.functions.text import scrub_text
from pitpanel.operators.inference import PLACEBO_SHARE
from pitpanel.plans import compile as language
from pitpanel.plans.space import Space
from pitpanel.plans.spec import Spec, SpecError, read


@dataclass(frozen=True)
class SearchConfig:
    budget: int = 100
    seeds: tuple[int, ...] = (0, 1, 2, 3, 4)
    alpha: float = 0.05
    placebos: int = 19
    placebo_min_shift: int = 6
    placebo_seed: int = 0
    max_depth: int = language.MAX_DEPTH
    columns: tuple[str, ...] = tuple(language.DEFAULT_COLUMNS)
    include_cross: bool = False
    min_valid: int = 100
    require_signflip: bool = False
    require_f1: bool = False
    draws: int = 2000
    classifier: dict = field(default_factory=dict)

    def __post_init__(self):
        if 0 < self.placebos < 19:
            raise ValueError("fewer than 19 placebos certify nothing: take 0 or at least 19")
        if self.budget < 1 or not self.seeds or len(set(self.seeds)) < len(self.seeds):
            raise ValueError("a budget of at least 1 and distinct seeds are needed")

    @property
    def space(self) -> Space:
        return language.space(list(self.columns), self.max_depth, self.include_cross)

    def parse(self, proposal: object) -> Spec:
        return language.parse(proposal, list(self.columns), self.max_depth, self.include_cross)


@dataclass
class Outcome:
    trial: int
    spec: object
    status: str  # accepted, rejected, failed, duplicate
    reason: str
    formula: str | None = None
    gain: float | None = None
    p_value: float | None = None
    delta_f1: float | None = None


def unseen(space: Space, rng: np.random.Generator, seen: set[str], redraws: int) -> Spec:
    """A uniform draw that isn't in ``seen``, or the last of ``redraws`` draws."""
    for _ in range(max(redraws, 1)):
        spec = space.draw(rng)
        if spec.key not in seen:
            break
    return spec


class RandomArm:
    """Draws specs without repeating one, as long as redraws find another."""

    name = "random"

    def __init__(self, seed: int, cfg: SearchConfig, redraws: int = 100):
        self.rng, self.space, self.redraws, self.seen = np.random.default_rng(seed), cfg.space, redraws, set()

    def propose(self, history: list[Outcome], accepted: list[Spec]) -> object:
        spec = unseen(self.space, self.rng, self.seen, self.redraws)
        self.seen.add(spec.key)
        return spec.to_json()

    def observe(self, outcome: Outcome) -> None:
        pass


class TpeArm:
    """Tree-structured Parzen estimator over the answers that make a spec.

    Of several candidates it proposes the one most likely under the better ``share`` of the
    trials relative to the rest; counts are smoothed by one for every answer. A trial that
    failed, repeated another or has no gain is pruned: it counts among the worse ones. If it
    comes on specs it has proposed already, it prunes them and asks itself again, ``redraws``
    times; then an unseen uniform draw is proposed. With ``restart`` an accepted feature, after
    which gains are against other features, ends what was learnt.
    """

    name = "tpe"

    def __init__(self, seed: int, cfg: SearchConfig, startup: int = 10, candidates: int = 24, share: float = 0.25, redraws: int = 10, restart: bool = False):
        self.rng, self.space = np.random.default_rng(seed), cfg.space
        self.startup, self.candidates, self.share, self.redraws, self.restart = startup, candidates, share, redraws, restart
        self.finished: list[tuple[float, dict]] = []
        self.pruned: list[dict] = []
        self.seen: set[str] = set()
        self.asked: dict | None = None

    def halves(self) -> tuple[list[dict], list[dict]]:
        ranked = [answers for _, answers in sorted(self.finished, key=lambda t: -t[0])]
        n = math.ceil(self.share * len(ranked))
        return ranked[:n], ranked[n:] + self.pruned

    def ask(self) -> dict:
        """Answers to all questions of one spec."""
        if len(self.finished) < self.startup:
            return self.space.answers(lambda _, answers: answers[int(self.rng.integers(len(answers)))])
        good, bad = ({(name, answer): n for name, answer, n in _tally(half)} for half in self.halves())
        found: list[tuple[float, int, dict]] = []
        for k in range(self.candidates):
            score = 0.0

            def settle(name: str, answers: tuple) -> object:
                nonlocal score
                g, b = (np.array([1.0 + half.get((name, a), 0) for a in answers]) for half in (good, bad))
                g, b = g / g.sum(), b / b.sum()
                at = int(self.rng.choice(len(answers), p=g))
                score += math.log(g[at] / b[at])
                return answers[at]

            made = self.space.answers(settle)
            found.append((score, -k, made))
        return max(found, key=lambda f: f[:2])[2]

    def propose(self, history: list[Outcome], accepted: list[Spec]) -> object:
        for _ in range(self.redraws + 1):
            self.asked = self.ask()
            spec = self.space.spec(self.asked)
            if spec.key not in self.seen:
                break
            self.pruned.append(self.asked)
        else:
            spec = unseen(self.space, self.rng, self.seen, 100)
            self.asked = self.space.flat(spec)
        self.seen.add(spec.key)
        return spec.to_json()

    def observe(self, outcome: Outcome) -> None:
        if self.asked is None:
            return
        if outcome.status in ("accepted", "rejected") and outcome.gain is not None:
            self.finished.append((outcome.gain, self.asked))
        else:
            self.pruned.append(self.asked)
        self.asked = None
        if self.restart and outcome.status == "accepted":
            self.finished.clear()
            self.pruned.clear()


def _tally(trials: list[dict]) -> Iterator[tuple[str, object, int]]:
    for (name, answer), n in Counter((name, answer) for t in trials for name, answer in t.items()).items():
        yield name, answer, n


# -- a language model --

RAW, REASON, RATIONALE = 120, 160, 200


def short(text: object, most: int) -> str:
    """On one line, of bounded length, without tickers and dates."""
    line = scrub_text(" ".join(str(text).split()))
    return line if len(line) <= most else line[: most - 1] + "…"


def named(o: Outcome) -> str:
    return o.formula or "unreadable: " + short(o.spec if isinstance(o.spec, str) else json.dumps(o.spec), RAW)


def number(x: float | None) -> str:
    return "-" if x is None else f"{x:.4g}"


#: What the model reads of an earlier trial in each mode: heading and value. Nothing that is
#: told in ``blind`` depends on an outcome.
TOLD: dict[str, list[tuple[str, Callable[[Outcome, str], str]]]] = {
    "full": [
        ("status", lambda o, _: o.status), ("gain", lambda o, _: number(o.gain)), ("p", lambda o, _: number(o.p_value)),
        ("formula", lambda o, _: named(o)), ("why you proposed it", lambda _, why: short(why, RATIONALE) or "-"), ("reason", lambda o, _: short(o.reason, REASON) or "-"),
    ],
    "no_history": [],
    "blind": [("formula", lambda o, _: named(o)), ("why you proposed it", lambda _, why: short(why, RATIONALE) or "-")],
}


def acceptance(cfg: SearchConfig) -> list[str]:
    """What a feature has to pass, in words, from the settings of the search."""
    out = [f"Its mean gain in balanced log loss on later data is positive with a one-sided p-value under {cfg.alpha}; related markets and neighbouring times are allowed for."]
    if cfg.placebos:
        rank = math.ceil(PLACEBO_SHARE * (cfg.placebos + 1) - 1e-9)
        out.append(f"Its gain is above the {rank}. smallest of {cfg.placebos} placebo gains, got from its own values moved by {cfg.placebo_min_shift} events of the market or more.")
    if cfg.require_signflip:
        out.append("A sign-flip permutation test agrees.")
    if cfg.require_f1:
        out.append("Macro F1 rises significantly, too.")
    out.append(f"On the training rows of each fold it has {cfg.min_valid} values or more, not all equal; else the trial is lost.")
    out.append("A feature that was proposed before isn't evaluated again, and its trial is lost.")
    return out


class ModelArm:
    """Asks a language model, given as ``ask(request) -> {"text", "usage"}``, for specs.

    ``mode`` says what a message tells of the search: ``full`` the accepted features and all
    outcomes, ``no_history`` the accepted features only, ``blind`` the arm's own proposals
    without any outcome. The system text is the same in every mode. Of a long history
    ``shown`` trials are listed: in ``full`` accepted ones before others, else the latest.

    An answer is a JSON object with ``rationale`` and ``spec``, or a spec alone. An invalid
    one is asked to be repaired, ``repairs`` times at no cost to the budget. All calls are
    kept, so that ``replay`` can stand in for ``ask``.
    """

    name = "model"

    def __init__(self, ask: Callable[[dict], dict], cfg: SearchConfig, mode: str = "full", repairs: int = 2, shown: int = 60):
        if mode not in TOLD:
            raise ValueError(f"unknown mode {mode!r}; there are {', '.join(TOLD)}")
        self.ask, self.cfg, self.mode, self.repairs, self.shown = ask, cfg, mode, repairs, shown
        self.calls: list[dict] = []
        self.rationales: dict[int, str] = {}
        self.tokens: Counter = Counter()

    def system(self) -> str:
        return "\n".join([
            "You propose features for a classifier of the next price move of prediction markets: down, flat or up. A trial is one proposal.",
            "A proposal is added to the base columns and the accepted features, and the classifier is fitted again on walk-forward folds.",
            "It is accepted if:", *(f"- {rule}" for rule in acceptance(self.cfg)),
            "", self.cfg.space.describe(),
            "", 'Answer with one JSON object: {"rationale": one sentence on why it should help, "spec": the tree}.',
        ])

    def listed(self, history: list[Outcome]) -> list[Outcome]:
        if len(history) <= self.shown:
            return history
        first = [o for o in history if o.status == "accepted"] if self.mode == "full" else []
        room = max(self.shown - len(first), 0)
        others = [o for o in history if o not in first]
        return sorted(first + (others[-room:] if room else []), key=lambda o: o.trial)

    def message(self, history: list[Outcome], accepted: list[Spec]) -> str:
        lines = [f"Trial {len(history) + 1} of {self.cfg.budget}."]
        if self.mode != "blind":
            lines.append("Features so far, besides the base columns: " + ("; ".join(s.formula() for s in accepted) or "none"))
        columns = TOLD[self.mode]
        if columns and history:
            used = Counter(n.op for o in history for n in _nodes(o.spec) if n.op)
            lines.append("Operators in your proposals: " + (", ".join(f"{op} {n}" for op, n in sorted(used.items(), key=lambda x: (-x[1], x[0]))) or "none"))
            if self.mode == "full":
                lines.append("Trials by status: " + ", ".join(f"{status} {n}" for status, n in sorted(Counter(o.status for o in history).items())))
            shown = self.listed(history)
            lines.append(f"Your proposals ({len(history) - len(shown)} of {len(history)} left out): " + " | ".join(["trial", *(heading for heading, _ in columns)]))
            lines += [" | ".join([str(o.trial + 1), *(value(o, self.rationales.get(o.trial, "")) for _, value in columns)]) for o in shown]
        return "\n".join([*lines, "Propose one feature."])

    def propose(self, history: list[Outcome], accepted: list[Spec]) -> object:
        system, faults, trial = self.system(), [], len(history)
        content = self.message(history, accepted)
        self.rationales[trial] = ""
        for attempt in range(self.repairs + 1):
            retry = [f"Your answer {short(text, 2000)} can't be used: {why}" for text, why in faults]
            request = {"system": system, "messages": [{"role": "user", "content": "\n".join([content, *retry])}]}
            answer = self.ask(request)
            self.calls.append({"trial": trial, "attempt": attempt, "request": request, "answer": answer})
            self.tokens.update({k: v for k, v in answer.get("usage", {}).items() if "tokens" in k and isinstance(v, (int, float))})
            rationale, proposal = understood(answer.get("text") or "")
            try:
                self.cfg.parse(proposal)
                self.rationales[trial] = rationale
                break
            except SpecError as e:
                faults.append((answer.get("text") or "", str(e)))
        return proposal

    def observe(self, outcome: Outcome) -> None:
        pass


def understood(text: str) -> tuple[str, object]:
    """Rationale and spec of an answer; the spec is text where it can't be read."""
    inner = text[text.find("{") : text.rfind("}") + 1]
    try:
        value = json.loads(inner)
    except (ValueError, RecursionError):
        return "", inner
    if isinstance(value, dict) and "spec" in value:
        return str(value.get("rationale", "")), value["spec"]
    return "", value


def _nodes(proposal: object) -> Iterable[Spec]:
    try:
        return [n for _, n in read(proposal).walk()]
    except SpecError:
        return []


# -- recorded calls --


class ReplayMismatch(RuntimeError):
    """A replayed conversation asks something else than was recorded."""


def write_transcript(path: str, calls: list[dict]) -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(json.dumps(call, sort_keys=True) + "\n" for call in calls)


def read_transcript(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as lines:
        return [json.loads(line) for line in lines if line.strip()]


def places(value: object, at: str = "") -> dict[str, object]:
    """The plain values inside a JSON value, by where they stand."""
    inside = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, (list, tuple)) else None
    if inside is None:
        return {at: value}
    return {k: v for name, part in inside for k, v in places(part, f"{at}/{name}").items()} or {at: type(value).__name__}


def replay(calls: list[dict]) -> Callable[[dict], dict]:
    """An ``ask`` that gives recorded answers in order, and refuses a request that differs."""
    left = iter(enumerate(calls))

    def ask(request: dict) -> dict:
        number, held = next(left, (len(calls), None))
        if held is None:
            raise ReplayMismatch(f"call {number}: only {len(calls)} calls were recorded")
        was, now = places(held["request"]), places(request)
        apart = sorted(k for k in {*was, *now} if was.get(k) != now.get(k))
        if apart:
            raise ReplayMismatch(f"call {number} (trial {held.get('trial')}, attempt {held.get('attempt')}) differs from the recorded one at {apart[0]}")
        return held["answer"]

    return ask
