"""The versioned store: interruptions, races and retention."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import files
from quire.streaming import store as st


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_versions_and_retention(spark, tmp_path):
    s = st.VersionedStore(spark, str(tmp_path / "s"), keep=2)
    assert s.current() is None and s.versions() == []
    for k in range(4):
        assert s.update(lambda old, k=k: spark.range(k, k + 1) if old is None else old.union(spark.range(k, k + 1))) == k + 1
    assert s.versions() == [3, 4] and ids(s.current()) == [0, 1, 2, 3] and ids(s.at(3)) == [0, 1, 2]
    assert len([n for n in files.names(spark, f"{s.folder}/rows") if n.startswith("0")]) == 2
    other = st.VersionedStore(spark, f"file://{tmp_path}/s", keep=1)  # another session's view of the same folder
    assert ids(other.current()) == [0, 1, 2, 3]
    other.publish(spark.range(0))
    assert other.versions() == [5] and other.current().count() == 0 and other.current().columns == ["id"]
    with pytest.raises(ValueError, match="one"):
        st.VersionedStore(spark, "x", keep=0)


def test_an_interrupted_update_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = st.VersionedStore(spark, str(tmp_path / "s"))
    s.publish(spark.range(3))

    @F.udf("long")
    def broken(x):
        if x == 2:
            raise ValueError("lost")
        return x

    with pytest.raises(Exception, match="lost"):
        s.update(lambda old: old.select(broken("id").alias("id")))
    assert ids(s.current()) == [0, 1, 2] and s.versions() == [1]

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # the driver goes when the rows are there and the pointer is not
        m.setattr(files, "put_new", stopped)
        with pytest.raises(KeyboardInterrupt):
            s.publish(spark.range(9))
    assert ids(s.current()) == [0, 1, 2] and len(files.names(spark, f"{s.folder}/rows")) >= 2
    s.publish(spark.range(4))
    assert ids(s.current()) == [0, 1, 2, 3]
    s.publish(spark.range(5))
    assert len(files.names(spark, f"{s.folder}/rows")) == 2  # nothing of the two that failed is left


def test_the_second_of_two_writers_begins_again(spark, tmp_path):
    s = st.VersionedStore(spark, str(tmp_path / "s"))
    s.publish(spark.range(1))
    seen = []

    def change(old):
        if not seen:  # another writer is faster once
            st.VersionedStore(spark, s.folder).publish(spark.range(10, 12))
        seen.append(ids(old))
        return old.union(spark.range(5, 6))

    assert s.update(change) == 3 and seen == [[0], [10, 11]] and ids(s.current()) == [5, 10, 11]
    with pytest.raises(st.Conflict):
        s.publish(spark.range(1), after=1)
    assert ids(s.current()) == [5, 10, 11] and len(files.names(spark, f"{s.folder}/rows")) == 2
