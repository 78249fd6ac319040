"""Binary vector files: round trips, partial records, ranges and limits."""

import sys

import numpy as np
import pytest

from tessera.sources import vecs


@pytest.fixture(autouse=True)
def registered(spark):
    vecs.register(spark)


def write(path, rows, dtype):
    with open(path, "wb") as f:
        for r in rows:
            f.write(np.array([len(r)], "<i4").tobytes() + np.array(r, dtype).tobytes())


@pytest.mark.parametrize("suffix,dtype,top", [("fvecs", "<f4", 1.5), ("ivecs", "<i4", -7), ("bvecs", "u1", 255), ("ui8vecs", "u1", 200), ("ui16vecs", "<u2", 65535), ("uivecs", "<u4", 2**32 - 1), ("ulvecs", "<u8", 2**64 - 1)])
def test_round_trip(spark, tmp_path, suffix, dtype, top):
    path = str(tmp_path / f"a.{suffix}")
    rows = [[1, 2, 3], [4, 5, top]]
    write(path, rows, dtype)
    df = spark.read.format("xvecs").option("partition_bytes", "20").load(path)
    assert [list(map(float, r["embedding"])) for r in df.orderBy("vec_id").collect()] == [list(map(float, r)) for r in rows]
    out = str(tmp_path / f"b.{suffix}")
    df.orderBy("vec_id").write.format("xvecs").mode("append").save(out)
    with open(path, "rb") as a, open(out, "rb") as b:
        assert a.read() == b.read()


def test_files_on_any_file_system(spark, tmp_path):
    path = f"file://{tmp_path}/a.fvecs"
    df = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    vecs.write_vecs(df, path)
    assert [tuple(r) for r in vecs.read_vecs(spark, path).orderBy("vec_id").collect()] == [(0, [1, 2]), (1, [3, 4])]
    assert vecs.read_vecs(spark, path, limit=1).count() == 1
    with pytest.raises(Exception, match="exists"):
        vecs.write_vecs(df, path)
    vecs.write_vecs(df.limit(0), path, overwrite=True)
    assert vecs.read_vecs(spark, path).count() == 0
    with open(tmp_path / "b.fvecs", "wb") as f:
        f.write(np.array([2], "<i4").tobytes() + b"x" * 9)
    with pytest.raises(ValueError, match="whole number"):
        vecs.read_vecs(spark, f"file://{tmp_path}/b.fvecs")
    with pytest.raises(ValueError, match="fit"):
        vecs.write_vecs(spark.createDataFrame([(0, [300])], "vec_id long, embedding array<int>"), f"file://{tmp_path}/c.bvecs")


def test_partial_record_empty_file_and_limit(spark, tmp_path):
    path = str(tmp_path / "a.fvecs")
    write(path, [[1, 2], [3, 4]], "<f4")
    with open(path, "ab") as f:
        f.write(b"\x02\x00\x00\x00\x01")
    assert spark.read.format("xvecs").load(path).count() == 2
    assert spark.read.format("xvecs").option("limit", "1").load(path).count() == 1
    with pytest.raises(Exception, match="rows asked for"):
        spark.read.format("xvecs").option("limit", "3").load(path).count()
    empty = str(tmp_path / "e.ui8vecs")
    open(empty, "wb").close()
    assert spark.read.format("xvecs").load(empty).count() == 0


def test_values_that_do_not_fit(spark, tmp_path):
    df = spark.createDataFrame([(0, [300])], "vec_id long, embedding array<int>")
    with pytest.raises(Exception, match="doesn't fit"):
        df.write.format("xvecs").mode("append").save(str(tmp_path / "a.bvecs"))


def test_fbin_starts_after_its_header(spark, tmp_path):
    path = str(tmp_path / "a.fbin")
    with open(path, "wb") as f:
        f.write(np.array([2, 3], "<i4").tobytes() + np.arange(6, dtype="<f4").tobytes())
    rows = spark.read.format("fbin").load(path).orderBy("vec_id").collect()
    assert [list(r["embedding"]) for r in rows] == [[0, 1, 2], [3, 4, 5]]
    assert spark.read.format("fbin").option("limit", "1").load(path).count() == 1


STAND_IN = """
import numpy as np


class File:
    \"\"\"As much of h5py's File as is used, kept as one .npz.\"\"\"

    def __init__(self, path, mode="r"):
        self.path, self.mode = path, mode
        self.data = {} if mode == "w" else dict(np.load(open(path, "rb")))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.mode == "w":
            np.savez(open(self.path, "wb"), **self.data)

    def __getitem__(self, name):
        return self.data[name]

    def create_dataset(self, name, shape, dtype):
        self.data[name] = np.zeros(shape, dtype)
        return self.data[name]
"""


@pytest.mark.parametrize("kind,element", [("f4", "float"), ("f8", "double"), ("i4", "int"), ("u1", "smallint"), ("u4", "bigint")])
def test_hdf5_is_read_in_ranges(spark, tmp_path, monkeypatch, kind, element):
    """With a stand-in for h5py, in the driver and in the tasks, where it isn't installed."""
    try:
        import h5py
    except ImportError:
        (tmp_path / "lib").mkdir()
        (tmp_path / "lib" / "h5py.py").write_text(STAND_IN)
        monkeypatch.syspath_prepend(str(tmp_path / "lib"))
        import h5py

        # by value to the tasks
        monkeypatch.setattr(vecs, "_h5py", lambda what, text=STAND_IN: (scope := {}, exec(text, scope), type("h5py", (), {"File": scope["File"]}))[2])
    path = str(tmp_path / "a.h5")
    values = np.arange(60).reshape(20, 3).astype(kind)
    with h5py.File(path, "w") as f:
        f.create_dataset("train", shape=values.shape, dtype=kind)[:] = values
    df = vecs.read_hdf5(spark, path, "train", rows_per_task=7)
    assert df.schema["embedding"].dataType.elementType.simpleString() == element and df.rdd.getNumPartitions() == 3
    assert [(r["vec_id"], r["embedding"]) for r in df.orderBy("vec_id").collect()] == list(enumerate(values.tolist()))
    vecs.write_hdf5(df, str(tmp_path / "b.h5"), "test", block=8)
    assert vecs.read_hdf5(spark, str(tmp_path / "b.h5"), "test").orderBy("vec_id").collect() == df.orderBy("vec_id").collect()
    sys.modules.pop("h5py", None)


def test_hdf5_says_what_it_needs(spark, tmp_path):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="h5py"):
            vecs.read_hdf5(spark, str(tmp_path / "a.h5"), "train")
        return
    df = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    vecs.write_hdf5(df, str(tmp_path / "a.h5"), "train")
    assert vecs.read_hdf5(spark, str(tmp_path / "a.h5"), "train").first()["embedding"] == [1.0, 2.0]
