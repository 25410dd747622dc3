"""Array stores, on a mounted disk and off one."""

import numpy as np
import pyarrow.fs
import pytest
from siftline.llm import common


def test_arrays_in_one_file(tmp_path):
    store = common.Store(str(tmp_path))
    arrays = {"a": np.arange(1000, dtype="<u8"), "b": np.zeros(0, "<i4"), "c": np.arange(7, dtype="<u1"), "é": np.array([1.5, 2.5])}
    store.put_all("all", arrays)
    got = store.get_all("all")
    assert list(got) == list(arrays)
    for k, a in arrays.items():
        assert got[k].dtype == a.dtype and np.array_equal(got[k], a)


def test_stores_off_a_mounted_disk_are_told_apart(tmp_path, monkeypatch):
    """Folders that end in the same name, as all shared ones do."""

    def elsewhere(uri):
        path = uri.removeprefix("far://")
        return pyarrow.fs.SubTreeFileSystem(str(tmp_path), pyarrow.fs.LocalFileSystem()), path

    class Far(common.Store):
        def __init__(self, uri):
            self.uri = uri
            self.fs, self.path = elsewhere(uri)

    monkeypatch.setattr(common, "Store", Far)
    common._copied.cache_clear()
    one, two = Far("far://one/data"), Far("far://two/data")
    one.put("word-0", np.arange(3))
    two.put("word-0", np.arange(100, 103))
    two.put_all("words-0", {"x": np.arange(5)})
    assert one.get("word-0").tolist() == [0, 1, 2] and two.get("word-0").tolist() == [100, 101, 102]
    assert two.get_all("words-0")["x"].tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(OSError):
        one.get("words-0")
