import os
from types import SimpleNamespace

import pytest

from tessella.sources import scratch


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,3000]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(session(master))
    assert scratch.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]", "local[2,3]"])
def test_one_process_may_use_its_own_folder(master):
    assert scratch.shared_dir(session(master)).startswith("file:///")


def test_tables_are_cut_and_removed(spark):
    before = scratch.held()
    one = scratch.cut(spark.range(5), "one")
    (path,) = scratch.held() - before
    two = scratch.cut(one.selectExpr("id + 1 AS id"), "two", since=before)
    assert sorted(r["id"] for r in two.collect()) == [1, 2, 3, 4, 5]
    assert path not in scratch.held() and not os.path.exists(path.removeprefix("file://")) and len(scratch.held() - before) == 1
    scratch.SCRATCH.free(since=before)
    assert scratch.held() == before
