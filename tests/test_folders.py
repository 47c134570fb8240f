import os
from types import SimpleNamespace

import pytest

from pagemill.sources.folders import scratch, scratch_path, shared_folder


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "k8s://https://host", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
        assert shared_folder(session(master, "hdfs://n/shared/")) == "hdfs://n/shared"
    for master in ("local", "local[*]", "local[8]"):
        assert shared_folder(session(master)).startswith("file://")


def test_what_is_kept_in_a_scope_is_removed(spark):
    outside = scratch_path(spark, "tables")
    with scratch(spark):
        inside = scratch_path(spark, "tables")
        for path in (inside, outside):
            spark.range(3).write.parquet(path)
        with pytest.raises(ValueError), scratch(spark):
            nested = scratch_path(spark, "tables")
            spark.range(3).write.parquet(nested)
            raise ValueError
        assert not os.path.exists(nested.removeprefix("file://")) and spark.read.parquet(inside).count() == 3
    assert not os.path.exists(inside.removeprefix("file://")) and spark.read.parquet(outside).count() == 3


def test_threads_have_scopes_of_their_own(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    both = Barrier(2)

    def one(k):
        with scratch(spark):
            path = scratch_path(spark, "tables")
            spark.range(k + 1).write.parquet(path)
            both.wait(60)
            if k:  # the other scope ends first
                both.wait(60)
                return spark.read.parquet(path).count()
        both.wait(60)
        return os.path.exists(path.removeprefix("file://"))

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(one, range(2))) == [False, 2]
