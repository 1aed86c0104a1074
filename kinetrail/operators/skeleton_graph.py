"""Paths through skeleton graphs. A graph is one component's branches (tens of edges); graphs are spread by component.

Edges: edge_id, n0, n1 (nodes), len, co (flat x0, y0, ... from n0 to n1). Edges that come without nodes get them by `with_nodes`.
Searches may be limited in states or paths; whether a limit was met is told by `complete`, never hidden.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Graph:
    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("edge_id", kind="stable")
        self.edges = [(int(a), int(b), float(n), np.asarray(co, float).reshape(-1, 2)) for a, b, n, co in zip(pdf["n0"], pdf["n1"], pdf["len"], pdf["co"], strict=True)]
        self.at = defaultdict(list)
        for i, (a, b, *_) in enumerate(self.edges):
            self.at[a].append(i)
            if b != a:
                self.at[b].append(i)
        self.tips = [n for n in self.at if len(self.at[n]) == 1]

    def leave(self, i: int, node: int) -> tuple[np.ndarray, int]:
        """Points of edge i from node on, and the node at its other end."""
        a, b, _, co = self.edges[i]
        return (co, b) if a == node else (co[::-1], a)


def heading(co: np.ndarray, reach: int, end: bool) -> np.ndarray:
    """Unit direction of travel at the start or the end of points."""
    a, b = (co[max(0, len(co) - 1 - reach)], co[-1]) if end else (co[0], co[min(len(co) - 1, reach)])
    d = b - a
    return d / (np.hypot(*d) + 1e-9)


def turn(u: np.ndarray, v: np.ndarray) -> float:
    return float(np.degrees(np.arccos(np.clip(u @ v, -1, 1))))


def clusters(points: np.ndarray, near: float) -> np.ndarray:
    """Number of each point's cluster: points at most `near` apart are joined, directly or through others (union-find over neighbouring squares)."""
    root = list(range(len(points)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    squares = defaultdict(list)
    for i, (x, y) in enumerate(points):
        square = int(np.floor(x / near)), int(np.floor(y / near))
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                for j in squares.get((square[0] + dx, square[1] + dy), ()):
                    if np.hypot(x - points[j][0], y - points[j][1]) <= near:
                        root[max(find(i), find(j))] = min(find(i), find(j))
        squares[square].append(i)
    return np.array([find(i) for i in range(len(points))], np.int64)


def with_nodes(edges: DataFrame, component: str = "comp_id", near: float = 5.0) -> DataFrame:
    """Edges (component, edge_id, len, co) with n0 and n1: ends of branches of one component that lie within `near` are one node."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("edge_id", kind="stable")
        co = [np.asarray(c, float).reshape(-1, 2) for c in pdf["co"]]
        ids = clusters(np.array([p for c in co for p in (c[0], c[-1])]).reshape(-1, 2), near)
        return pd.DataFrame({component: pdf[component], "edge_id": pdf["edge_id"], "n0": ids[0::2], "n1": ids[1::2], "len": pdf["len"], "co": pdf["co"]})

    kinds = dict(edges.dtypes)
    return edges.groupBy(component).applyInPandas(run, f"{component} {kinds[component]}, edge_id {kinds['edge_id']}, n0 long, n1 long, len double, co array<double>")


def trail(graph: Graph, target: float | None, most_turn: float = 80.0, states: int | None = 200_000, reach: int = 8) -> tuple[list[int], float, bool]:
    """(edges, value, complete) of the best walk that uses no edge twice and turns at most most_turn: the longest, or that of
    greatest L - |L - target| / 2; the first found of equal ones.

    Branch and bound: the value grows with the length, so a walk is given up when even all unused edges that it can
    still reach would not lift it above the best one. complete is false where `states` walks were not enough.
    """
    best: tuple[list[int], float] = ([], -1.0)
    budget = np.inf if states is None else states

    def value(length: float) -> float:
        return length if target is None else length - 0.5 * abs(length - target)

    def within_reach(node: int, used: tuple[int, ...]) -> float:
        seen, edges, open_nodes = {node}, set(used), [node]
        more = 0.0
        while open_nodes:
            for i in graph.at[open_nodes.pop()]:
                if i not in edges:
                    edges.add(i)
                    more += graph.edges[i][2]
                    new = [n for n in graph.edges[i][:2] if n not in seen]
                    seen.update(new)
                    open_nodes += new
        return more

    # of each node, its edges from the last: number, node at the other end, length, direction of walking it; what these are and the turns between them is worked out once
    steps: dict[int, list] = {n: [] for n in graph.at}
    headings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    turns: dict[tuple, float] = {}
    for n, edges in graph.at.items():
        for i in reversed(edges):
            co, other = graph.leave(i, n)
            headings[i, n] = heading(co, reach, False), heading(co, reach, True)
            steps[n].append((i, other, graph.edges[i][2], (i, n)))

    def bend(before: tuple[int, int], after: tuple[int, int]) -> float:
        if (before, after) not in turns:
            turns[before, after] = turn(headings[before][1], headings[after][0])
        return turns[before, after]

    for start in graph.tips or list(graph.at):
        stack = [(start, (), 0.0, None)]
        while stack:
            if budget <= 0:
                return (*best, False)
            budget -= 1
            node, used, length, way = stack.pop()
            if used and value(length) > best[1]:
                best = (list(used), value(length))
            if value(length + within_reach(node, used)) <= best[1]:
                continue
            for i, other, size, out in steps[node]:
                if i not in used and (way is None or bend(way, out) <= most_turn):
                    stack.append((other, (*used, i), length + size, out))
    return (*best, True)


def paths(graph: Graph, width: float, most_turn: float = 75.0, most: int = 4000) -> tuple[list[dict], bool]:
    """(candidate paths from tips, complete): edges, length, worst turn, and whether they end inside; complete is false where there are more than `most`. Edges shorter than 2.5 widths between junctions are looked through: the heading before them stays."""
    reach, found, out, complete = max(3, int(width)), {}, [], True
    for tip in graph.tips:
        stack = [(tip, (), 0.0, 0.0, None)]
        while stack:
            if len(found) >= most:
                complete = False
                break
            node, used, length, worst, way = stack.pop()
            further = False
            for i in reversed(graph.at[node]):
                if i in used:
                    continue
                co, other = graph.leave(i, node)
                inside = len(graph.at[other]) > 1
                bridge = inside and graph.edges[i][2] < 2.5 * width
                bend = 0.0
                if way is not None and not bridge:
                    bend = turn(way, heading(co, reach, False))
                    if bend > most_turn:
                        continue
                further = True
                step = ((*used, i), length + graph.edges[i][2], max(worst, bend))
                if not bridge:
                    found.setdefault(tuple(sorted(step[0])), (step, int(inside)))
                if inside:
                    stack.append((other, *step[:2], step[2], way if bridge else heading(co, reach, True)))
            if not further and used:
                found.setdefault(tuple(sorted(used)), ((used, length, worst), 1))
    for key, ((_, length, worst), inside) in found.items():
        out.append({"edges": list(key), "len": length, "turn": worst, "inside": inside})
    return out, complete


def choose(candidates: list[dict], lengths: dict[int, float], target: float, share: float = 0.4) -> list[dict]:
    """Greedy choice by turn, length and ending; a path may share at most `share` of its length with those chosen."""
    cost = lambda p: (p["turn"] + 100 * abs(np.log(p["len"] / target)) + 15 * p["inside"], p["edges"])
    taken: list[dict] = []
    used: set[int] = set()
    for p in sorted((p for p in candidates if p["len"] > 0), key=cost):
        if not taken or sum(lengths[e] for e in p["edges"] if e in used) <= share * p["len"]:
            taken.append(p)
            used.update(p["edges"])
    return taken


def longest_trails(edges: DataFrame, component: str = "comp_id", target: float | None = None, states: int | None = 200_000) -> DataFrame:
    """(component, edges, score, complete) of every component's best trail."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        used, value, complete = trail(Graph(pdf), target, states=states)
        ids = pdf.sort_values("edge_id", kind="stable")["edge_id"].tolist()
        return pd.DataFrame([{component: key[0], "edges": [int(ids[i]) for i in used], "score": value, "complete": complete}])

    return edges.groupBy(component).applyInPandas(run, f"{component} {dict(edges.dtypes)[component]}, edges array<long>, score double, complete boolean")


def split_paths(edges: DataFrame, width: float, target: float, component: str = "comp_id", low: float = 0.6, high: float = 1.3, least: int = 2, most: int = 4000) -> DataFrame:
    """Chosen paths of plausible length per component, and whether all candidates were seen; none where fewer than `least` remain."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        graph = Graph(pdf)
        ids = pdf.sort_values("edge_id", kind="stable")["edge_id"].tolist()
        candidates, complete = paths(graph, width, most=most)
        chosen = choose(candidates, {i: e[2] for i, e in enumerate(graph.edges)}, target)
        chosen = [p for p in chosen if low * target <= p["len"] <= high * target]
        rows = [{component: key[0], "path": k, "edges": [int(ids[e]) for e in p["edges"]], "len": p["len"], "turn": p["turn"], "complete": complete} for k, p in enumerate(chosen)] if len(chosen) >= least else []
        return pd.DataFrame(rows, columns=[component, "path", "edges", "len", "turn", "complete"])

    return edges.groupBy(component).applyInPandas(run, f"{component} {dict(edges.dtypes)[component]}, path int, edges array<long>, len double, turn double, complete boolean")
