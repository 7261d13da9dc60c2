from types import SimpleNamespace

import pytest

from mooring import shared


def test_written_tables_are_given_back(spark):
    table = shared.materialise(spark.range(10), "t")
    path = table._written
    assert path.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir")) and table.count() == 10
    shared.release(table, spark.range(3))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_only_one_machine_gets_a_folder_of_its_own():
    def session(master, folder=None):
        context = SimpleNamespace(master=master, applicationId="app", getConf=lambda: {})
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=context)

    assert shared.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared.shared_dir(session(master))
    assert shared.shared_dir(session("local[4]")) == shared.shared_dir(session("local[4]"))
    shared._OWN.pop("app")
