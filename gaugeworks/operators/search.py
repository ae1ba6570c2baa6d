"""Anonymous correspondence of two terminal-net graphs: net and terminal maps by turns, component maps by branch and bound.

A board is a plain object in one worker; boards are independent, a kernel for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import fixed
from gaugeworks.operators.kernels import heaviest_matching

SEEDS, SALTS, TURNS, NODES = 4, 3, 12, 200_000


@dataclass
class Part:
    name: str
    kind: str
    terminals: list[str]
    value: float | None = None
    classes: list[list[int]] = field(default_factory=list)

    def groups(self) -> list[list[int]]:
        """Classes of interchangeable terminals, the default where none are declared."""
        if self.classes:
            return [list(c) for c in self.classes]
        if len(self.terminals) == 2 and self.kind in fixed.PAIRWISE_TYPES:
            return [[0, 1]]
        return [[k] for k in range(len(self.terminals))]


@dataclass
class Board:
    parts: dict[str, Part]
    net_of: dict[str, str]


def accepts(true_kind: str, kind: str) -> bool:
    allowed = fixed.TYPE_COMPATIBILITY.get(true_kind, [true_kind])
    return allowed is None or kind in allowed


def part_score(pred: Part, true: Part) -> float | None:
    """How alike two components are, 0 to 1; None if they may not be matched. Terminals don't count here."""
    if not accepts(true.kind, pred.kind):
        return None
    if true.value is None:
        return 1.0
    if pred.value is None:
        return 0.0
    if true.value == 0:
        return float(pred.value == 0)
    return max(0.0, 1 - abs(pred.value - true.value) / abs(true.value))


class Alternation:
    """For a component map, the net map and the terminal orders that agree most, by turns from several starts."""

    def __init__(self, pred: Board, true: Board):
        self.pred, self.true = pred, true
        self.known: dict = {}

    def solve(self, phi: dict[str, str]) -> tuple[int, dict[str, str], dict[str, list]]:
        """Matched incidences, net map, terminal orders (for each predicted component, the true place of each terminal or None)."""
        best: tuple = (-1, {}, {})
        for salt in range(SALTS):
            for start in [*range(SEEDS), None]:
                order = self.orders(phi, self.alike_nets(phi, salt), salt) if start is None else self.rotated(phi, start)
                last = -1
                for _ in range(TURNS):
                    nets, hit = self.nets(phi, order, salt)
                    if hit <= last:
                        break
                    last, order = hit, self.orders(phi, nets, salt)
                nets, hit = self.nets(phi, order, salt)
                if hit > best[0]:
                    best = (hit, nets, {k: list(v) for k, v in order.items()})
        return best

    def rotated(self, phi: dict[str, str], by: int) -> dict[str, list]:
        """Terminals in their own order, those of each class moved on by a number of places."""
        out = {}
        for p, g in phi.items():
            n, m = len(self.pred.parts[p].terminals), len(self.true.parts[g].terminals)
            order: list = [k if k < m else None for k in range(n)]
            for group in self.true.parts[g].groups() if by else []:
                step = by % max(1, len(group))
                for here, there in zip(group, group[step:] + group[:step], strict=True):
                    if here < n:
                        order[here] = there
            out[p] = order
        return out

    def _matched(self, rows: list[str], columns: list[str], weights: np.ndarray, salt: int) -> dict[str, str]:
        got = heaviest_matching(weights, salt)
        return {rows[i]: columns[j] for i, j in enumerate(got.tolist()) if j >= 0}

    def nets(self, phi: dict[str, str], order: dict[str, list], salt: int) -> tuple[dict[str, str], int]:
        """The net map with the most shared incidences under these terminal orders, and their number."""
        pairs: dict[tuple[str, str], int] = {}
        for p, g in phi.items():
            for terminal, place in zip(self.pred.parts[p].terminals, order[p], strict=False):
                here = self.pred.net_of.get(terminal)
                there = None if place is None else self.true.net_of.get(self.true.parts[g].terminals[place])
                if here is not None and there is not None:
                    pairs[here, there] = pairs.get((here, there), 0) + 1
        if not pairs:
            return {}, 0
        rows, columns = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
        weights = np.zeros((len(rows), len(columns)), np.int64)
        for (a, b), n in pairs.items():
            weights[rows.index(a), columns.index(b)] = n
        found = self._matched(rows, columns, weights, salt)
        return found, sum(pairs.get(x, 0) for x in found.items())

    def alike_nets(self, phi: dict[str, str], salt: int) -> dict[str, str]:
        """A net map by what hangs on the nets: for each, how many terminals of which class of which true component."""
        signatures: tuple[dict, dict] = ({}, {})
        for p, g in phi.items():
            of = {k: n for n, group in enumerate(self.true.parts[g].groups()) for k in group}
            for side, board, part in ((0, self.pred, self.pred.parts[p]), (1, self.true, self.true.parts[g])):
                for k, terminal in enumerate(part.terminals):
                    if (net := board.net_of.get(terminal)) is not None:
                        own = signatures[side].setdefault(net, {})
                        own[g, of.get(k, k)] = own.get((g, of.get(k, k)), 0) + 1
        if not signatures[0] or not signatures[1]:
            return {}
        rows, columns = sorted(signatures[0]), sorted(signatures[1])
        weights = np.array([[sum(min(n, signatures[1][b].get(k, 0)) for k, n in signatures[0][a].items()) for b in columns] for a in rows], np.int64)
        return self._matched(rows, columns, weights, salt)

    def orders(self, phi: dict[str, str], nets: dict[str, str], salt: int) -> dict[str, list]:
        return {p: self.order(p, g, nets, salt) for p, g in phi.items()}

    def order(self, p: str, g: str, nets: dict[str, str], salt: int) -> list:
        """Of each class, the predicted terminals on the true ones that their nets lead to; those left over take what is free,
        from the class's end."""
        pred, true = self.pred.parts[p].terminals, self.true.parts[g]
        leads = tuple(nets.get(self.pred.net_of.get(t)) for t in pred)
        key = (p, g, salt, leads)
        if key not in self.known:
            out: list = [None] * len(pred)
            for group in true.groups():
                rows = [k for k in group if k < len(pred)]
                if not rows:
                    continue
                if len(group) == 1:
                    out[rows[0]] = group[0]
                    continue
                goals = [self.true.net_of.get(true.terminals[k]) for k in group]
                weights = np.array([[int(leads[k] is not None and leads[k] == goal) for goal in goals] for k in rows], np.int64)
                got = heaviest_matching(weights, salt).tolist()
                free = [k for j, k in enumerate(group) if j not in got]
                for k, j in zip(rows, got, strict=True):
                    out[k] = group[j] if j >= 0 else free.pop() if free else None
            self.known[key] = out
        return self.known[key]


@dataclass
class Match:
    score: float
    weight: float
    parts: dict[str, str]
    nets: dict[str, str]
    incidences: int
    exact: bool
    nodes: int


def common_subgraph(pred: Board, true: Board, nodes: int = NODES) -> Match:
    """The component map of the largest weight: scores of components plus matched incidences. Branch and bound over true
    components, most terminals first: a branch goes on while what it has, plus the less of what is left on either side,
    could pass the best so far. exact is False if the node budget ends the search."""
    inner = Alternation(pred, true)
    order = sorted(true.parts.values(), key=lambda x: -len(x.terminals))
    candidates = [[p.name for p in pred.parts.values() if part_score(p, g) is not None] for g in order]
    ahead = [0.0] * (len(order) + 1)
    for k in reversed(range(len(order))):
        ahead[k] = ahead[k + 1] + 1 + len(order[k].terminals)
    worth = {p.name: 1.0 + sum(t in pred.net_of for t in p.terminals) for p in pred.parts.values()}
    evaluated: dict = {}

    def value(phi: dict[str, str]) -> tuple[float, dict[str, str], int]:
        key = frozenset(phi.items())
        if key not in evaluated:
            hit, nets, _ = inner.solve(phi) if phi else (0, {}, {})
            evaluated[key] = (sum(part_score(pred.parts[p], true.parts[g]) for p, g in phi.items()) + hit, nets, hit)
        return evaluated[key]

    best, best_phi, seen, exact = -1.0, {}, 0, True
    phi: dict[str, str] = {}

    def search(k: int) -> None:
        nonlocal best, best_phi, seen, exact
        seen += 1
        if seen > nodes:
            exact = False
            return
        now = value(phi)[0]
        if k == len(order):
            if now > best:
                best, best_phi = now, dict(phi)
            return
        if now + min(ahead[k], sum(worth.values()) - sum(worth[p] for p in phi)) <= best:
            return
        for p in candidates[k]:
            if p not in phi:
                phi[p] = order[k].name
                search(k + 1)
                del phi[p]
                if not exact:
                    return
        search(k + 1)

    search(0)
    weight, nets, hit = value(best_phi)
    below = sum(len(b.parts) + len(b.net_of) for b in (pred, true)) - weight
    return Match(weight / below if below > 0 else 0.0, weight, best_phi, nets, int(hit), exact, seen)


def _boards(tables: dict[str, DataFrame]) -> DataFrame:
    """board and one struct of its parts and incidences."""
    pins = tables["terminal"].groupBy("board", "cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "tid"))), lambda t: t["tid"]).alias("terminals"))
    classes = F.col("classes") if "classes" in tables["component"].columns else F.lit(None).cast("array<array<int>>")
    rows = tables["component"].join(pins, ["board", "cid"], "left")
    parts = rows.groupBy("board").agg(F.array_sort(F.collect_list(F.struct("cid", "ctype", "value", classes.alias("classes"), F.coalesce("terminals", F.array().cast("array<string>")).alias("terminals")))).alias("parts"))
    nets = tables["incidence"].groupBy("board").agg(F.collect_list(F.struct("tid", "nid")).alias("incidences"))
    return parts.join(nets, "board", "full_outer")


def soft_common_subgraph(pred: dict[str, DataFrame], true: dict[str, DataFrame], nodes: int = NODES) -> DataFrame:
    """board, score, weight, incidences, exact, nodes of the best component map of each true board; parts come by id."""
    both = _boards(true).select("board", F.struct("parts", "incidences").alias("t")).join(_boards(pred).select("board", F.struct("parts", "incidences").alias("p")), "board", "left")

    def board(s) -> Board:
        if s is None:
            return Board({}, {})
        value = lambda v: None if v is None or v != v else float(v)
        parts = [Part(x["cid"], x["ctype"], list(x["terminals"]), value(x["value"]), [list(c) for c in (x["classes"] if x["classes"] is not None else [])]) for x in (s["parts"] if s["parts"] is not None else [])]
        return Board({x.name: x for x in parts}, {x["tid"]: x["nid"] for x in (s["incidences"] if s["incidences"] is not None else [])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, t, p in zip(pdf["board"], pdf["t"], pdf["p"], strict=True):
                m = common_subgraph(board(p), board(t), nodes)
                out.append((name, m.score, m.weight, m.incidences, m.exact, m.nodes))
            yield pd.DataFrame(out, columns=["board", "score", "weight", "incidences", "exact", "nodes"])

    return both.repartition("board").mapInPandas(run, "board string, score double, weight double, incidences long, exact boolean, nodes long")
