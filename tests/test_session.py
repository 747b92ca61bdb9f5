"""Where written steps go."""

from types import SimpleNamespace

import pytest

from cairnfield.session import shared_folder


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def session(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        shared_folder(session(master))
    assert shared_folder(session(master, **{"spark.checkpoint.dir": "hdfs:///steps/"})) == "hdfs:///steps"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*, 3]"])
def test_local_mode_makes_one(master):
    spark = session(master)
    assert shared_folder(spark).startswith("file:///tmp/spark-") and shared_folder(spark) == spark.conf["spark.checkpoint.dir"]
