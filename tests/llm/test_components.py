from __future__ import annotations

import random

import pytest

from kinespark.llm import simhash


def made(seed):
    """Chains, stars, loops and doubled edges over signed numbers, the ends in any order."""
    rng = random.Random(seed)
    names = rng.sample(range(-(2**61), 2**61), 400)
    edges = list(zip(names[:60], names[1:61])) + [(names[100], x) for x in names[101:140]] + [(names[60], names[60])]
    edges += [tuple(rng.sample(names[150:], 2)) for _ in range(150)]
    return [e if rng.random() < 0.5 else e[::-1] for e in edges + edges[:20]]


def plain(edges):
    low = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            least = min(low[a], low[b])
            moved |= low[a] != least or low[b] != least
            low[a] = low[b] = least
    return {x: r for x, r in low.items() if x != r}


@pytest.mark.parametrize("task_edges", [0, 1 << 19])
def test_components_in_one_task_and_by_joins(spark, monkeypatch, task_edges):
    monkeypatch.setattr(simhash, "TASK_EDGES", task_edges)
    edges = made(4)
    found = simhash.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.root for r in found} == plain(edges) and len(found) == len(plain(edges))
    assert simhash.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_few_edges_take_few_jobs(spark):
    sc = spark.sparkContext
    edges = spark.createDataFrame(made(5), "src long, dst long")
    sc.setJobGroup("few-edges", "")
    try:
        simhash.components(edges).count()
        assert 0 < len(sc.statusTracker().getJobIdsForGroup("few-edges")) <= 8
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
