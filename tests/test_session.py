import time
from types import SimpleNamespace

import pytest

from corpuscle import session


class Context(SimpleNamespace):
    def getConf(self):  # noqa: N802
        return {"spark.checkpoint.dir": self.named} if self.named else {}

    def getCheckpointDir(self):  # noqa: N802
        return None

    def setCheckpointDir(self, path):  # noqa: N802
        self.path = path


def test_shared_folder():
    """What the cluster names; without a name one of its own in local mode, and an error on a cluster."""
    of = lambda master, named=None: session.shared_dir(SimpleNamespace(sparkContext=Context(master=master, named=named)))
    assert of("spark://x:7077", "hdfs:///shared/") == "hdfs:///shared"
    assert all(of(m).startswith("file:///") for m in ("local", "local[4]", "local[*]", "local[2,3]"))
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            of(master)


def test_written_and_dropped(spark):
    table = session.written(spark.range(5).toDF("n"), "numbers")
    assert table.count() == 5
    session.drop(table)
    with pytest.raises(Exception, match="(?i)not.*exist|not.found"):
        spark.read.parquet(table._corpuscle_path)


def test_saving_leaves_no_shuffle_files(spark, tmp_path):
    """And the session's own setting holds again, also after a failure."""
    context = spark.sparkContext._jsc.sc()
    shuffles = lambda: context.env().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    before, setting = shuffles(), spark.conf.get(session.CLEANUP)
    session.save(spark.range(1000).repartition(3, "id"), str(tmp_path / "t"))
    for _ in range(50):  # files go in the background
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and spark.conf.get(session.CLEANUP) == setting
    with pytest.raises(Exception, match="(?i)exist"):
        session.save(spark.range(1), str(tmp_path / "t"))
    assert spark.conf.get(session.CLEANUP) == setting
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000


def test_batches_are_bounded_unless_the_session_says_so(spark):
    before = spark.conf.get(session.BATCH)
    try:
        spark.conf.set(session.BATCH, "123")
        session.ship(spark)
        assert spark.conf.get(session.BATCH) == "123"
        spark.conf.unset(session.BATCH)
        session.ship(spark)
        assert spark.conf.get(session.BATCH) == str(session.BATCH_BYTES)
    finally:
        spark.conf.set(session.BATCH, before)
