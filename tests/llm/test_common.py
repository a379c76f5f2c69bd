"""The shared folder."""

import pytest

from inspectra.llm.common import replaced, shared_dir, written


class Session:
    def __init__(self, **conf):
        self.conf = type("Conf", (), {"get": lambda _, k, d: conf.get(k, d), "set": lambda _, k, v: conf.update({k: v})})()


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "k8s://x", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(**{"spark.master": master}))
    assert shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    one = Session(**{"spark.master": "local[8]"})
    assert shared_dir(one) == shared_dir(one)


def test_replaced_tables_go(spark):
    a = written(spark.range(9), "a")
    b = replaced(a, written(a.where("id > 3"), "b"))
    assert b.count() == 5
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        a.collect()
