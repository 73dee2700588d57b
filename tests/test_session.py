import pytest

from reachlens import session


class Fake:
    """Stands for a session with the given master and checkpoint folder."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.master = master
        self.sparkContext = self

    def getCheckpointDir(self):
        return None


def test_the_folder_of_the_cluster_is_used():
    assert session.shared_folder(Fake("spark://host:7077", "hdfs://host/shared/")) == "hdfs://host/shared"


def test_a_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError):
        session.shared_folder(Fake("spark://host:7077"))


def test_intermediate_tables_lie_in_the_shared_folder(spark):
    frame = session.materialize(spark.range(3), "t")
    assert all(session.shared_folder(spark) in path for path in frame.inputFiles())
    assert frame.count() == 3
    assert session.scratch_path(spark, "t") != session.scratch_path(spark, "t")
