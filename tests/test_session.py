import pytest

from boxmill import session


class Stub:
    """The parts of a session that ``shared_dir`` looks at."""

    def __init__(self, master, configured=None):
        self.conf = {session.CHECKPOINT_DIR: configured}
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"


def test_the_configured_folder_is_used(spark):
    assert session.shared_dir(Stub("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert session.shared_dir(spark) == spark.conf.get(session.CHECKPOINT_DIR)


def test_without_a_folder():
    first = session.shared_dir(Stub("local[2]"))
    assert first == session.shared_dir(Stub("local[2]"))
    with pytest.raises(RuntimeError, match="shared"):
        session.shared_dir(Stub("yarn"))


def test_small_table_limit(spark, monkeypatch):
    table, n = session.small_table(spark.range(5))
    assert n == 5 and table.count() == 5
    monkeypatch.setattr(session, "MAX_LISTED_ROWS", 4)
    table, n = session.small_table(spark.range(5))
    assert n is None and table.count() == 5
