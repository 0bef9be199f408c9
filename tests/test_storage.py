import pytest

from fairstream.plans import storage


class Context:
    def __init__(self, master):
        self.master, self.dirs = master, []

    def getCheckpointDir(self):
        return self.dirs[-1] if self.dirs else None

    def setCheckpointDir(self, folder):
        self.dirs.append(folder)


class Session:
    """As much of a session as the choice of the folder needs."""

    def __init__(self, master, **settings):
        self.sparkContext, self.conf = Context(master), settings


def test_the_session_names_the_folder():
    session = Session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared"})
    assert storage.shared_folder(session) == "hdfs:///shared"
    assert storage.scratch_path(session, "x").startswith("hdfs:///shared/x-")
    assert session.sparkContext.dirs == ["hdfs:///shared"]


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        storage.shared_folder(Session("yarn"))
    local = Session("local[2]")
    assert storage.shared_folder(local) == local.sparkContext.dirs[0]


def test_stored_tables_keep_their_rows(spark):
    assert sorted(r.id for r in storage.stored(spark.range(3), "x").collect()) == [0, 1, 2]


def test_scratch_paths_differ(spark):
    assert storage.scratch_path(spark, "x") != storage.scratch_path(spark, "x")


def test_cut_drops_the_lineage(spark):
    df = storage.cut(spark.range(5).selectExpr("id + 1 as id"))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in df.collect()) == [1, 2, 3, 4, 5]


def test_persisted_is_released(spark):
    with storage.persisted(spark.range(5)) as held:
        assert held.is_cached and held.count() == 5
    assert not held.is_cached
