"""Own diagnostics on cell blocks: functions of numpy arrays, registered with what they read and return.

    own = Diagnostics()

    @own.register("middle", reads=("f",), returns="low double, high double", rows=200)
    def middle(f):
        return np.quantile(f, [0.25, 0.75])

    own.run(distribution, ("sp", "i1", "i2", "i3"))

Spark puts each cell's values together as arrays, in the order of its other indices, with partial lists before the one
shuffle; all registered functions then run on a cell in one pass over Arrow batches. `rows` bounds a block: run() first counts
(by partial sums) whether any cell has more rows, and raises, so no task meets a block of unforeseen size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class _Diagnostic:
    name: str
    reads: tuple[str, ...]
    returns: StructType
    rows: int
    fn: Callable[..., Sequence]


class Diagnostics:
    def __init__(self):
        self._all: dict[str, _Diagnostic] = {}

    def register(self, name: str, reads: Sequence[str], returns: str, rows: int) -> Callable:
        """fn gets one array for each column of reads, and returns a value for each field of returns."""
        if name in self._all:
            raise ValueError(f"there is a diagnostic {name!r}")

        def keep(fn):
            self._all[name] = _Diagnostic(name, tuple(reads), StructType.fromDDL(returns), rows, fn)
            return fn

        return keep

    def run(self, f: DataFrame, keys: Sequence[str], order: Sequence[str] = (), only: Sequence[str] | None = None) -> DataFrame:
        """keys and, for each diagnostic, its fields as <name>_<field>; a row for each cell."""
        chosen = [self._all[n] for n in (self._all if only is None else only)]
        if not chosen:
            raise ValueError("no diagnostic is chosen")
        most = min(d.rows for d in chosen)
        over = f.groupBy(*keys).count().where(F.col("count") > most).limit(1).collect()
        if over:
            raise ValueError(f"cell {over[0][:-1]} has {over[0]['count']} rows; the diagnostics take {most}")
        reads = list(dict.fromkeys(c for d in chosen for c in d.reads))
        block = F.array_sort(F.collect_list(F.struct(*order, *[c for c in reads if c not in order])))
        one = lambda c: F.transform("x", lambda r: r[c]).alias(f"x_{c}")
        blocks = f.groupBy(*keys).agg(block.alias("x")).select(*keys, *map(one, reads))
        n_keys = len(keys)
        fields = [(f"{d.name}_{x.name}", x.dataType) for d in chosen for x in d.returns.fields]
        kinds = [to_arrow_type(kind) for _, kind in fields]
        schema = StructType(list(blocks.schema.fields[:n_keys]))
        for name, kind in fields:
            schema = schema.add(name, kind)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                arrays = {c: batch.column(n_keys + k) for k, c in enumerate(reads)}
                bounds = {c: a.offsets.to_numpy() for c, a in arrays.items()}
                flat = {c: a.values.to_numpy(zero_copy_only=False) for c, a in arrays.items()}
                found: list[list] = [[] for _ in fields]
                for i in range(batch.num_rows):
                    row: list = []
                    for d in chosen:
                        values = d.fn(*[flat[c][bounds[c][i] : bounds[c][i + 1]] for c in d.reads])
                        row += values if isinstance(values, tuple | list) else np.atleast_1d(values).tolist()
                    for k, v in enumerate(row):
                        found[k].append(v)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *[pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)]], names=[*batch.schema.names[:n_keys], *[n for n, _ in fields]])

        return blocks.mapInArrow(each, schema)
