"""Where intermediate data goes."""

import pytest

from millrace.session import cut_lineage, scratch_dir, scratch_root


class Fake:
    """The parts of a session the scratch rules look at."""

    def __init__(self, master, setting=None, checkpoint=None):
        self.master, self.applicationId = master, f"app-{master}"
        self._setting, self._checkpoint = setting, checkpoint
        self.conf = self.sparkContext = self

    def get(self, _key, default):
        return self._setting or default

    def getCheckpointDir(self):
        return self._checkpoint


def test_the_session_names_the_folder():
    assert scratch_root(Fake("yarn", "hdfs://shared/cp/")) == "hdfs://shared/cp"
    assert scratch_root(Fake("yarn", checkpoint="hdfs://other")) == "hdfs://other"


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Fake("spark://host:7077"))


def test_a_local_master_gets_one_temporary_folder():
    fake = Fake("local[2]")
    assert scratch_root(fake) == scratch_root(fake)
    assert scratch_dir(fake, "x.json") != scratch_dir(fake, "x.json")
    assert scratch_dir(fake, "x.json").endswith("/x.json")


def test_cut_lineage_reads_what_was_stored(spark):
    stored = cut_lineage(spark.range(100).selectExpr("id", "id * 2 AS twice"))
    assert stored.count() == 100 and "Range" not in stored._jdf.queryExecution().logical().toString()
