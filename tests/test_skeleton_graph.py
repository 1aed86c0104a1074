"""Trails by branch and bound against enumeration, and junctions of branches that end apart."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from kinetrail.operators import skeleton_graph as sk


def web(r, nodes, edges):
    place = [(r.uniform(0, 300), r.uniform(0, 300)) for _ in range(nodes)]
    rows = []
    for i in range(edges):
        a, b = r.sample(range(nodes), 2)
        mid = (r.uniform(0, 300), r.uniform(0, 300))
        co = np.array([place[a], mid, place[b]])
        rows.append((i, a, b, float(np.hypot(*np.diff(co, axis=0).T).sum()), co.ravel().tolist()))
    return pd.DataFrame(rows, columns=["edge_id", "n0", "n1", "len", "co"])


def every_trail(graph, most_turn=80.0, reach=8):
    """All walks from tips (or from all nodes) by plain recursion."""
    out = []

    def walk(node, used, length, way):
        if used:
            out.append((length, used))
        for i in graph.at[node]:
            if i not in used:
                co, other = graph.leave(i, node)
                if way is None or sk.turn(way, sk.heading(co, reach, False)) <= most_turn:
                    walk(other, (*used, i), length + graph.edges[i][2], sk.heading(co, reach, True))

    for n in graph.tips or list(graph.at):
        walk(n, (), 0.0, None)
    return out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("target", [None, 400.0])
def test_trails_are_the_best_of_all(seed, target):
    r = random.Random(seed)
    graph = sk.Graph(web(r, r.randint(3, 6), r.randint(2, 9)))
    value = lambda x: x if target is None else x - 0.5 * abs(x - target)
    used, best, complete = sk.trail(graph, target, states=None)
    want = max(value(x) for x, _ in every_trail(graph))
    assert complete and np.isclose(best, want) and np.isclose(value(sum(graph.edges[i][2] for i in used)), want) and len(set(used)) == len(used)


def test_limits_are_told():
    graph = sk.Graph(web(random.Random(3), 5, 14))
    assert sk.trail(graph, None, states=5)[2] is False
    full = sk.Graph(web(random.Random(1), 4, 9))
    assert sk.paths(full, 4.0, most=1)[1] is (len(sk.paths(full, 4.0)[0]) < 1)


def test_clusters_join_through_others():
    r = np.random.default_rng(0)
    points = r.uniform(0, 80, (120, 2))
    got = sk.clusters(points, 5.0)
    label = list(range(120))
    for _ in range(120):
        for i, j in itertools.combinations(range(120), 2):
            if np.hypot(*(points[i] - points[j])) <= 5.0:
                label[i] = label[j] = min(label[i], label[j])
    assert [label.index(x) for x in label] == [got.tolist().index(x) for x in got]


def test_ends_of_branches_become_nodes(spark):
    rows = [(1, 0, 10.0, [0.0, 0.0, 10.0, 0.0]), (1, 1, 10.0, [13.0, 1.0, 13.0, 11.0]), (1, 2, 5.0, [16.0, 2.0, 30.0, 2.0]), (2, 0, 10.0, [13.0, 1.0, 0.0, 0.0])]
    out = sk.with_nodes(spark.createDataFrame(rows, "comp_id int, edge_id long, len double, co array<double>")).orderBy("comp_id", "edge_id").collect()
    one = [r for r in out if r["comp_id"] == 1]
    assert one[0]["n1"] == one[1]["n0"] == one[2]["n0"] and len({one[0]["n0"], one[0]["n1"], one[1]["n1"], one[2]["n1"]}) == 4
    assert {r["complete"] for r in sk.longest_trails(sk.with_nodes(spark.createDataFrame(rows, "comp_id int, edge_id long, len double, co array<double>"))).collect()} == {True}
