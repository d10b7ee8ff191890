"""The space of specs as a tree of questions, generated from the registry.

A place in a spec is a ``Point``: a question with its answers, each of which opens further
points. Everything else is a way through them: a random answer to each is a draw, the answers
that a given spec implies are its flat form, all answers together are the flat space, and
the number of ways through is the size. So a new operator or parameter is known to all of
these once it is registered.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pitpanel.plans.registry import KINDS, OPS
from pitpanel.plans.spec import ROOT, Language, Spec, col, node

COLUMN, OPERATOR = "col", "op"


@dataclass(frozen=True)
class Point:
    """A question: its name, what may be answered, and what an answer leads to."""

    name: str
    answers: tuple
    opens: Callable[[object], list[Point]] = lambda _: []


class Space:
    """All specs of a language of bounded depth."""

    def __init__(self, language: Language):
        if not language.max_depth or language.max_depth < 1:
            raise ValueError("a space needs a depth of at least 1")
        self.language = language
        self.ops = [OPS[name] for name in language.ops]

    def place(self, at: str, left: int) -> Point:
        """What may stand ``at`` a place above which so many levels of operators are left."""

        def operator(name: object) -> list[Point]:
            op = OPS[str(name)]
            return [Point(f"{at}/{op.name}.{k}", v) for k, v in op.params.items()] + [self.place(f"{at}.{k}", left - 1) for k in range(op.arity)]

        def kind(answer: object) -> list[Point]:
            return [Point(f"{at}/col", self.language.columns) if answer == COLUMN else Point(f"{at}/op", self.language.ops, operator)]

        kinds = (OPERATOR,) if at == ROOT else (COLUMN, OPERATOR) if left else (COLUMN,)
        return Point(f"{at}/kind", kinds, kind)

    def root(self) -> Point:
        return self.place(ROOT, self.language.max_depth)

    def answers(self, ask: Callable[[str, tuple], object]) -> dict[str, object]:
        """One way through: ``ask(name, answers)`` settles each point that has several answers."""
        out: dict[str, object] = {}
        todo = [self.root()]
        while todo:
            point = todo.pop()
            answer = point.answers[0]
            if len(point.answers) > 1:
                answer = out[point.name] = ask(point.name, point.answers)
            todo += reversed(point.opens(answer))
        return out

    def spec(self, answers: dict[str, object], at: str = ROOT, left: int | None = None) -> Spec:
        """The spec that these answers give."""
        left = self.language.max_depth if left is None else left
        settled = lambda p: answers[p.name] if len(p.answers) > 1 else p.answers[0]
        kind = self.place(at, left)
        (what,) = kind.opens(settled(kind))
        name = str(settled(what))
        if settled(kind) == COLUMN:
            return col(name)
        params = {p.name.rpartition(".")[2]: settled(p) for p in what.opens(name)[: len(OPS[name].params)]}
        return node(name, *(self.spec(answers, f"{at}.{k}", left - 1) for k in range(OPS[name].arity)), **params)

    def made(self, ask: Callable[[str, tuple], object]) -> Spec:
        return self.spec(self.answers(ask))

    def draw(self, rng) -> Spec:
        """Every answer is as likely as the point's others; ``rng`` is a NumPy generator."""
        return self.made(lambda _, answers: answers[int(rng.integers(len(answers)))])

    def flat(self, spec: Spec) -> dict[str, object]:
        """The answers that give this spec."""
        nodes = dict(self.language.check(spec).walk())

        def implied(name: str, _: tuple) -> object:
            at, _, what = name.rpartition("/")
            n = nodes[at]
            plain = {"kind": OPERATOR if n.op else COLUMN, "col": n.name, "op": n.op}
            return plain[what] if what in plain else dict(n.params)[what.rpartition(".")[2]]

        return self.answers(implied)

    def points(self) -> dict[str, tuple]:
        """Every point with several answers that some spec meets."""
        out: dict[str, tuple] = {}
        seen: set[str] = set()
        todo = [self.root()]
        while todo:
            point = todo.pop()
            if point.name in seen:
                continue
            seen.add(point.name)
            if len(point.answers) > 1:
                out[point.name] = point.answers
            for answer in point.answers:
                todo += point.opens(answer)
        return out

    def size(self) -> int:
        """How many specs there are, arguments of commutative operators in either order being one."""

        def ways(left: int) -> int:
            return len(self.language.columns) + (operators(left) if left else 0)

        def operators(left: int) -> int:
            below = ways(left - 1)
            return sum(math.prod(map(len, op.params.values())) * (math.comb(below + op.arity - 1, op.arity) if op.commutative else below**op.arity) for op in self.ops)

        return operators(self.language.max_depth)

    def catalog(self) -> dict:
        rows = [{"op": o.name, "kind": o.kind, "args": o.arity, "params": {k: list(v) for k, v in o.params.items()}, "doc": o.doc} for o in self.ops]
        used = {row["kind"] for row in rows}
        return {
            "columns": list(self.language.columns), "max_depth": self.language.max_depth, "max_nodes": self.language.max_size,
            "kinds": {k: v for k, v in KINDS.items() if k in used}, "operators": rows,
        }

    def describe(self) -> str:
        """The language for a prompt."""
        c = self.catalog()
        out = [
            f"Features are JSON trees with at most {c['max_depth']} operators above one another and {c['max_nodes']} nodes in all; an operator is on top.",
            'Operators are written {"op": NAME, "args": [TREE, ...], "params": {NAME: VALUE}}, columns {"col": NAME}.',
            "Columns: " + ", ".join(c["columns"]),
        ]
        for kind, meaning in c["kinds"].items():
            out += ["", f"{kind} operators: {meaning}"]
            for row in c["operators"]:
                if row["kind"] == kind:
                    signature = ", ".join([*"xyz"[: row["args"]], *(f"{k}={'|'.join(map(str, v))}" for k, v in row["params"].items())])
                    out.append(f"  {row['op']}({signature}): {row['doc']}")
        return "\n".join(out)
