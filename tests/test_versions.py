"""Snapshots of sets of tables: all or nothing, one writer wins, deletes reach every table."""

from __future__ import annotations

import pytest

from tessella.sources.versions import Conflict, Versions

KEYS = {"documents": "id", "chunks": "document_id"}


def tables(spark, ids):
    docs = spark.createDataFrame([(i, f"d{i}") for i in ids], "id long, title string")
    chunks = spark.createDataFrame([(i, n, "x" * n) for i in ids for n in range(3)], "document_id long, n int, text string")
    return {"documents": docs, "chunks": chunks}


def ids(versions, version=None):
    docs = sorted(r.id for r in versions.read("documents", version).collect())
    assert sorted(r.document_id for r in versions.read("chunks", version).collect()) == sorted(3 * docs)
    return docs


def test_loads_and_cascading_deletes_are_snapshots(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"), KEYS, buckets=4)
    assert store.load(tables(spark, range(5))) == 1
    assert store.load(tables(spark, range(5, 9))) == 2
    assert store.delete(spark.createDataFrame([(1,), (6,), (None,), (99,)], "id long")) == 3
    assert ids(store) == [0, 2, 3, 4, 5, 7, 8]
    assert ids(store, 2) == list(range(9)) and ids(store, 1) == list(range(5))
    assert store.delete(spark.createDataFrame([], "id long")) == 3
    assert store.delete(store.read("documents").select("id")) == 4
    assert ids(store) == []
    with pytest.raises(KeyError):
        store.read("other")


@pytest.mark.parametrize("step", ["_write", "_buckets", "commit"])
def test_a_crash_at_any_step_keeps_the_snapshot(spark, tmp_path, monkeypatch, step):
    store = Versions(spark, str(tmp_path / "s"), KEYS)
    store.load(tables(spark, range(4)))
    for change in (lambda s: s.load(tables(spark, [7])), lambda s: s.delete(spark.createDataFrame([(2,)], "id long"))):
        with monkeypatch.context() as patch:
            real, calls = getattr(Versions, step), []

            def dies(self, *args):
                calls.append(1)
                if step == "commit" or len(calls) > 1:
                    raise OSError("died")
                return real(self, *args)

            patch.setattr(Versions, step, dies)
            with pytest.raises(OSError, match="died"):
                change(Versions(spark, store.root, KEYS))
        assert ids(Versions(spark, store.root, KEYS)) == list(range(4))
    assert store.latest() == 1
    assert store.load(tables(spark, [5])) == 2
    store.vacuum()
    assert ids(store) == [0, 1, 2, 3, 5]


def test_of_two_writers_one_wins_and_the_other_comes_after(spark, tmp_path, monkeypatch):
    one, other = (Versions(spark, str(tmp_path / "s"), KEYS) for _ in range(2))
    one.load(tables(spark, range(3)))
    assert one.commit(2, one.snapshot()) == 2
    with pytest.raises(Conflict):
        other.commit(2, other.snapshot())
    real, before = Versions.commit, []

    def slow(self, number, snapshot):
        if not before:
            before.append(1)
            one.load(tables(spark, [10]))  # another writer is first
        return real(self, number, snapshot)

    monkeypatch.setattr(Versions, "commit", slow)
    assert other.delete(spark.createDataFrame([(1,)], "id long")) == 4
    assert ids(one) == [0, 2, 10]
