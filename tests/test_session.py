import os

import pytest

from pathweave.session import drop_intermediates, fallback_root, materialize


def test_a_cluster_without_a_shared_folder_is_refused():
    for warehouse in ("file:/tmp/warehouse", "/tmp/warehouse", ""):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            fallback_root("spark://host:7077", warehouse)
    assert fallback_root("yarn", "hdfs://nn/warehouse/") == "hdfs://nn/warehouse/_pathweave"


def test_one_machine_uses_a_temporary_folder():
    assert os.path.isdir(fallback_root("local[2]", ""))


def test_intermediates_can_be_dropped(spark):
    drop_intermediates(spark)
    out = materialize(spark.range(3).toDF("x"), "kept")
    path = out.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and drop_intermediates(spark) == 1 and not os.path.exists(path)
