"""The folder for what operators write between steps."""

import os

import pytest

from quire.llm.common import discard, passing, shared_dir, written


class _Unset:
    """A session whose checkpoint folder is not set."""

    class _Conf:
        def get(self, key, default=None):
            return default

    class _Context:
        folder, master = None, "local[4]"

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder + "/one"

    def __init__(self):
        self.conf, self.sparkContext = self._Conf(), self._Context()


def test_unset_folder_is_made_once():
    session = _Unset()
    first = shared_dir(session)
    assert first.startswith("file:///") and shared_dir(session) == first


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://a:7077", "local-cluster[3,2,1000]"):
        session = _Unset()
        session.sparkContext.master = master
        with pytest.raises(ValueError):
            shared_dir(session)


def test_what_is_passing_is_deleted(spark):
    folder = lambda df: df.written_to.removeprefix("file:")
    with passing(spark) as keep:
        a, b = (written(spark.range(n), "t") for n in (3, 4))
        with passing(spark) as inner:
            c = written(spark.range(5), "t")
            inner.append(c)
        keep.append(b)
        assert os.path.exists(folder(a)) and os.path.exists(folder(c))
    assert not os.path.exists(folder(a)) and not os.path.exists(folder(c)) and b.count() == 4
    discard(spark, b.written_to)
    assert not os.path.exists(folder(b))


def test_set_folder_is_used(spark):
    found = spark.conf.get("spark.checkpoint.dir", None)
    assert not found or shared_dir(spark) == found.rstrip("/")
