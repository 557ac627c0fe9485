"""Files that are there whole or not at all."""

import threading

import pytest

from tidemark.sources.storage import Storage


def test_a_write_that_is_killed_leaves_nothing_to_see(spark, folder, monkeypatch):
    store = Storage(spark)

    def killed(name, data):
        with open(name, "wb") as f:
            f.write(data[: len(data) // 2])
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Storage, "_write_local", staticmethod(killed))
        with pytest.raises(KeyboardInterrupt):
            store.put_if_absent(f"{folder}/0.json", "whole")
    assert store.list(folder) == [] and not store.exists(f"{folder}/0.json")
    assert store.put_if_absent(f"{folder}/0.json", "whole")
    assert not store.put_if_absent(f"{folder}/0.json", "other")
    assert store.read_text(f"{folder}/0.json") == "whole"


def test_of_many_writers_one_wins(spark, folder):
    won, store = [], Storage(spark)
    go = threading.Barrier(6)

    def write(n):
        go.wait()
        if store.put_if_absent(f"{folder}/7.json", f"writer {n}" * 1000):
            won.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and store.read_text(f"{folder}/7.json") == f"writer {won[0]}" * 1000


def test_rename_without_overwriting_elsewhere(spark, folder, monkeypatch):
    """The way of file systems that are neither local disks nor object stores, here through the same disk."""
    store = Storage(spark)
    found = store._at

    class Other:
        def __init__(self, fs):
            self.fs = fs

        def getUri(self):  # noqa: N802
            uri = self.fs.getUri()

            class Uri:
                def getScheme(self):  # noqa: N802
                    return "hdfs"

                def _get_object_id(self):
                    return uri._get_object_id()

                _target_id = property(lambda self: uri._target_id)

            return Uri()

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(store, "_at", lambda path: (Other(found(path)[0]), found(path)[1]))
    assert store.put_if_absent(f"{folder}/1.json", "a")
    assert not store.put_if_absent(f"{folder}/1.json", "b")
    assert Storage(spark).read_text(f"{folder}/1.json") == "a"
    assert [p.rsplit("/", 1)[1] for p, *_ in Storage(spark).list(folder)] == ["1.json"]
