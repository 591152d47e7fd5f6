import random
from heapq import heappop, heappush

import pytest

from tessella.functions.geometry import Camera
from tessella.operators import catalogs
from tessella.plans import descent

COLUMNS = "level int, cell long, child_mask long, lod_error double, " + ", ".join(f"{b} double" for b in catalogs.BOUNDS)


def octree(seed, levels=4):
    rng, cells = random.Random(seed), {}
    top = [c for c in range(3) if rng.random() < 0.8] or [0]
    for level in range(levels - 1, -1, -1):
        for c in top:
            cells[level, c] = [0, round(rng.random() * (level + 1), 3)]
            if level < levels - 1:
                cells[level + 1, c >> 3][0] |= 1 << (c & 7)
        top = [8 * c + o for c in top for o in range(8) if rng.random() < 0.4]
    return cells, levels


def by_heap(cells, levels, most, min_level, budget):
    """A priority queue over (level descending, cell), as the definition has it."""
    heap, taken = [], []
    for level, cell in cells:
        if level == levels - 1:
            heappush(heap, (-level, cell))
    while heap:
        level, cell = heappop(heap)
        level = -level
        mask, error = cells[level, cell]
        below = [(level - 1, 8 * cell + o) for o in range(8) if mask >> o & 1]
        if level <= min_level or error <= budget or not below or (most and len(taken) + len(heap) + len(below) > most):
            taken.append((level, cell))
        else:
            for lv, c in below:
                heappush(heap, (-lv, c))
    return sorted(taken, key=lambda k: (-k[0], k[1]))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("most", [None, 1, 9, 40])
def test_plan_equals_a_heap(spark, seed, most):
    cells, levels = octree(seed)
    rows = [(lv, c, m, e, *[0.0] * 6) for (lv, c), (m, e) in cells.items()]
    min_level, budget = seed % 2, 0.3
    got = descent.plan(spark.createDataFrame(rows, COLUMNS), levels, error_budget=budget, max_cells=most, min_level=min_level).collect()
    assert [(r["level"], r["cell"]) for r in got] == by_heap(cells, levels, most, min_level, budget)
    keys = {(r["level"], r["cell"]) for r in got}
    assert not any((lv + d, c >> 3 * d) in keys for lv, c in keys for d in range(1, levels))  # a cut


def test_refusals_and_precedence(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.0, *[0.0] * 6)], COLUMNS)
    owners = spark.createDataFrame([(1, 0, 0)], "object_id long, level int, cell long")
    with pytest.raises(ValueError):
        descent.plan(df, 1, max_cells=0)
    with pytest.raises(KeyError, match="8"):
        descent.plan(df, 1, objects=[1, 8], object_cells=owners)
    assert descent.plan(df, 1, objects=[], object_cells=owners).count() == 0
    two = spark.createDataFrame([(1, 0, 1, 5.0, *[0.0] * 6), (0, 0, 0, 0.0, *[0.0] * 6)], COLUMNS)
    cam = Camera((0, 0, -10), 1.0)
    assert [r["level"] for r in descent.plan(two, 2, camera=cam, error_budget=9).collect()] == [1]
    assert [r["level"] for r in descent.plan(two, 2, camera=cam, pixel_budget=0.1, error_budget=9).collect()] == [0]
    assert [r["level"] for r in descent.plan(two, 2).collect()] == [0]


def test_a_cell_whose_children_are_not_wanted_stays(spark):
    rows = [(1, 0, 3, 5.0, 0.0, 0.0, 0.0, 9.0, 9.0, 9.0), (0, 0, 0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (0, 1, 0, 0.0, 2.0, 0.0, 0.0, 3.0, 1.0, 1.0)]
    got = descent.plan(spark.createDataFrame(rows, COLUMNS), 2, box=((5, 5, 5), (6, 6, 6))).collect()
    assert [(r["level"], r["cell"]) for r in got] == [(1, 0)]
