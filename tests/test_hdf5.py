"""The HDF5 source, with a stand-in for h5py that opens numpy archives."""

import importlib.util

import numpy as np
import pytest
from pyspark.sql import functions as F

from velograph.sources.hdf5 import ArrayFile

STAND_IN = """
import numpy
class File(dict):
    def __init__(self, path, mode):
        super().__init__(numpy.load(path))
    def __enter__(self):
        return self
    def __exit__(self, *a):
        pass
"""


@pytest.mark.skipif(importlib.util.find_spec("h5py") is not None, reason="h5py is there")
def test_array_file(spark, tmp_path, monkeypatch):
    (tmp_path / "h5py.py").write_text(STAND_IN)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    a = np.arange(2 * 3 * 4, dtype=float).reshape(2, 3, 4)
    np.savez(tmp_path / "x.npz", f=a)
    spark.dataSource.register(ArrayFile)
    read = spark.read.format("array_file").option("dataset", "f").option("names", "sp,i1,iv")
    df = read.load(str(tmp_path / "x.npz"))
    assert df.rdd.getNumPartitions() == 6
    assert {(r.sp, r.i1, r.iv): r.f for r in df.collect()} == {i: v for i, v in np.ndenumerate(a)}
    box = spark.read.format("array_file").option("dataset", "f").option("names", "sp,i1,iv").option("starts", "1,0,2").option("sizes", "1,2,2").load(str(tmp_path / "x.npz"))
    assert sorted(map(tuple, box.collect())) == sorted(map(tuple, df.where("sp = 1 AND i1 < 2 AND iv >= 2").collect()))
    assert df.agg(F.sum("f")).first()[0] == a.sum()
