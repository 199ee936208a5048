import random

import pytest

from tintmill.operators import components as c


def by_hand(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("way", ["task", "rounds", "hubs"])
@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops and nulls", "none"])
def test_components(spark, monkeypatch, way, shape):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)],
        "chain": [(k + 1, k) for k in rng.sample(range(40), 40)],
        "star": [(2**60, k) for k in range(30)] + [(100, 101)],
        "loops and nulls": [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5)],
        "none": [],
    }[shape]
    monkeypatch.setattr(c, "TASK_EDGES", 100 if way == "task" else -1)
    monkeypatch.setattr(c, "HUB_EDGES", 3 if way == "hubs" else 1000)
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    rows = c.components(df).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.comp for r in rows} == by_hand(edges)


def test_ranges_of_edges_are_joined_before_any_round(spark, monkeypatch):
    edges = [(100 * p + k + 1, 100 * p + k) for p in range(4) for k in range(60)] + [(205, 120), (301, 2**60)]

    def rounds(_):
        raise AssertionError("few links are left, so there is nothing to go round for")

    monkeypatch.setattr(c, "_rounds", rounds)
    monkeypatch.setattr(c, "TASK_EDGES", 30)
    monkeypatch.setattr(c, "PART_EDGES", 25)
    rows = c.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.comp for r in rows} == by_hand(edges)
