"""Where intermediate tables go, case by case."""

import os
import types

import pytest

from lexmill import session


def fake(master="local[4]", named="", given=None):
    option = types.SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
    java = types.SimpleNamespace(conf=lambda: types.SimpleNamespace(get=lambda k, d: named or d), getCheckpointDir=lambda: option)
    sc = types.SimpleNamespace(master=master, applicationId=f"app-{master}", _jsc=types.SimpleNamespace(sc=lambda: java))
    return types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda k, d: d))


def test_named_folder_comes_first():
    assert session.shared_dir(fake(named="hdfs://x/shared/", given="file:/other")) == "hdfs://x/shared"


def test_checkpoint_dir_is_honoured():
    assert session.shared_dir(fake(master="spark://host:7077", given="hdfs://x/cp/1")) == "hdfs://x/cp/1"


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_cluster_without_a_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake(master=master))


def test_local_master_gets_a_folder_of_its_own():
    path = session.shared_dir(fake())
    assert path.startswith("file://") and os.path.isdir(path.removeprefix("file://")) and session.shared_dir(fake()) == path


def test_tables_are_written_and_cleaned(spark):
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    df = session.cut(spark.range(10), "t")
    assert df.count() == 10
    root = f"{session.shared_dir(spark).removeprefix('file://').removeprefix('file:')}/lexmill/{session._RUN}"
    assert os.listdir(root)
    session.clean(spark)
    assert not os.path.exists(root)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() == before.isDefined()  # reading sets nothing
