"""What a plan may not hold at size: tables that grow with the scene are not broadcast."""

import pytest

from tessella import catalog


@pytest.mark.parametrize("name", ["edge_lengths", "degenerate_faces", "knn_faces"])
def test_vertices_are_not_broadcast(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan
