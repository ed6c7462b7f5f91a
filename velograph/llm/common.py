"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import velograph
from velograph.sources import files

#: The white space of `[^\x20\x09-\x0D]+`; bytes.split() splits at just these.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
HELD_OUT = 2
#: The signature by which Spark knows an Arrow UDF over iterators.
ARRAY_ITERATOR = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once for each application; they need not have it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(velograph.__file__).parent
    # On the driver alone: Spark serves it to the executors for as long as the application runs.
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    packed = os.path.join(folder, "velograph.zip")
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(packed)
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of each text, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def ready_checkpoints(spark: SparkSession) -> None:
    """Keeps the session's checkpoint folder; where none is set, it is in the folder that all executors share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(files.shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """df, written to the reliable checkpoint folder, so that lost executors cost no recomputation."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, read by columns, smaller than a checkpoint. The
    table goes when the application ends."""
    path = f"{files.scratch(df.sparkSession, name)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def looked_up(rows: DataFrame, table: DataFrame, key: str, salt_by: str, most: int = 100_000, salts: int = 8, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row for each key: broadcast if it has `most` rows or fewer, else with every key
    in as many parts as salts, by hash of another column, so that a key with a third of all rows is no single task."""
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), key, how)
    (salt,) = fresh(rows, "salt")
    parts = table.withColumn(salt, F.explode(F.array(*map(F.lit, range(salts)))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).join(parts, [key, salt], how).drop(salt)


def small_or_all(table: DataFrame, most: int = 100_000) -> DataFrame:
    """table with a broadcast hint if it has `most` rows or fewer; else Spark chooses the join."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def row_udf(fn: Callable[[list[bytes | None]], pa.Array], returns: str) -> Callable[[Column], Column]:
    """An Arrow UDF over one text column; fn maps a batch of UTF-8 texts to an array of results."""

    ship(SparkSession.active())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # In parts, so that a batch isn't held once more as Python's own bytes.
            found = [fn(byte_texts(part)) for part in array_parts(batch, 8 << 20)]
            yield pa.concat_arrays(found) if len(found) > 1 else found[0] if found else fn([])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


def sliced(texts: list[bytes | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts with about `most` bytes of a text column each, one row at least."""
    run = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(run, (run[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def array_parts(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """An array of texts in parts of about `most` bytes, one text at least."""
    for part in parts(pa.RecordBatch.from_arrays([texts], ["text"]), 0, most):
        yield part.column(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores added to all as it takes for df to have none of them."""
    have, tail = {c.lower() for c in df.columns}, ""
    while any((n + tail).lower() in have for n in names):
        tail += "_"
    return [n + tail for n in names]


def as_matrix(rows: list, columns: int) -> np.ndarray:
    return np.asarray(rows, dtype=np.float64).reshape(len(rows), columns)
