"""Dense arrays of HDF5 files as rows, where h5py is installed; nothing else here needs it.

    spark.dataSource.register(ArrayFile)
    spark.read.format("array_file").option("dataset", "fdistribu").option("names", "sp,i1,i2,i3,iv,im").load(path)

A row has the indices of an element and its value `f`. Each partition is a range of the first two axes,
read as one slab when its task runs, so no process holds the array. The path must be one that every
executor can open. Ranges of indices are set with the options `starts` and `sizes` (comma-separated, one for each
axis), so that a hyperslab reads no more than itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def _open(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py, which isn't installed") from e
    return h5py.File(path, "r")


@dataclass
class Slab(InputPartition):
    starts: tuple[int, ...]
    sizes: tuple[int, ...]


class ArrayFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_file"

    def _names(self) -> list[str]:
        return [n.strip() for n in self.options["names"].split(",")]

    def schema(self) -> str:
        return ", ".join([*(f"{n} int" for n in self._names()), f"{self.options.get('value', 'f')} double"])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options, self._names(), schema)


class ArrayReader(DataSourceReader):
    def __init__(self, options, names: list[str], schema: StructType):
        self.path, self.dataset, self.names = options["path"], options["dataset"], names
        self.columns = [f.name for f in schema.fields]
        self.starts, self.sizes = ([int(x) for x in options[k].split(",")] if k in options else None for k in ("starts", "sizes"))

    def partitions(self) -> list[Slab]:
        with _open(self.path) as f:
            shape = f[self.dataset].shape
        if len(shape) != len(self.names):
            raise ValueError(f"{self.dataset} has {len(shape)} axes, but {len(self.names)} names are given")
        starts, sizes = self.starts or [0] * len(shape), self.sizes or list(shape)
        if any(a < 0 or n < 0 or a + n > s for a, n, s in zip(starts, sizes, shape, strict=True)):
            raise ValueError(f"the slab {starts}, {sizes} reaches beyond {list(shape)}")
        cut = min(2, len(shape))
        heads = [()]
        for a, n in zip(starts[:cut], sizes[:cut], strict=True):
            heads = [(*h, i) for h in heads for i in range(a, a + n)]
        return [Slab((*h, *starts[cut:]), (*[1] * cut, *sizes[cut:])) for h in heads]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as f:
            slab = np.asarray(f[self.dataset][tuple(slice(a, a + n) for a, n in zip(partition.starts, partition.sizes, strict=True))], dtype=np.float64)
        grid = np.indices(slab.shape).reshape(slab.ndim, -1) + np.array(partition.starts)[:, None]
        yield pa.RecordBatch.from_arrays([*(pa.array(g, pa.int32()) for g in grid), pa.array(slab.reshape(-1))], names=self.columns)
