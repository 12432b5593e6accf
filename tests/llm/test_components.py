"""Connected components by blocks and by star steps, against union-find."""

from __future__ import annotations

import random

import pytest

from liftlens.llm import components


def _brute(edges):
    head = {x: x for e in edges for x in e}

    def top(x):
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        head[max(a, b)] = min(a, b)
    return {x: top(x) for x in head}


@pytest.mark.parametrize("block", [1 << 20, 300, 40])
def test_components_equal_union_find(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK", block)
    rnd = random.Random(block)
    edges = [(i, i + 1) for i in range(100)] + [(500 + i, 400 - i) for i in range(60)] + [(9999 - i, 2000) for i in range(150)]
    edges += [(rnd.randrange(3000, 3400), rnd.randrange(3000, 3400)) for _ in range(180)] + [(-5, 7_000_000_000)] * 3
    rnd.shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == _brute([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
