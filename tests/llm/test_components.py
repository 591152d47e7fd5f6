"""Few edges are joined by one task, many by rounds: the same labels."""

import random

from tessella.llm import components


def test_one_task_gives_what_rounds_give(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(n, n + 1) for n in range(1000, 1040)] + [(5, 5), (None, 3)]
    edges = spark.createDataFrame(rows, "a long, b long")
    told = []
    real = components.in_one_task
    monkeypatch.setattr(components, "in_one_task", lambda e: told.append(1) or real(e))
    one, many = (sorted(map(tuple, components.connected_components(edges, few=n).collect())) for n in (1000, 0))
    assert one == many and len(told) == 1 and (1040, 1000) in one
    assert components.connected_components(edges.where("a = 5 and b = 5")).count() == 0
