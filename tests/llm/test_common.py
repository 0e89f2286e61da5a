import pytest

from phyllon.llm.common import components, local_roots, scratch, shared_dir, written


class Session:
    """Only what shared_dir asks a session for."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": master})()
        self.conf = {}


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(Session(master))
    assert shared_dir(Session("local[2]")) == shared_dir(Session("local[2]"))


def test_scratch_keeps_what_it_is_told_to(spark):
    with scratch(spark):
        gone, kept = written(spark.range(3), "gone"), written(spark.range(3), "kept", keep=True)
        paths = [df.inputFiles()[0] for df in (gone, kept)]
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(paths[0]).count()


def test_components_of_a_hub_and_a_path(spark):
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, 5000)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(400)}, **{k: 1000 for k in range(1000, 1041)}}
    assert local_roots(4, *(__import__("numpy").array(x) for x in ([0, 2], [1, 3]))).tolist() == [0, 0, 2, 2]
