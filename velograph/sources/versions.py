"""Tables with versions: each write is a folder of its own, which a small file makes current once it is whole.

    <path>/v00000001-<id>/...      the Parquet files of version 1
    <path>/_versions/00000001      the name of its folder

A version's file is created last, and only if there is none of its number; so a writer that fails leaves the table as it
was, of two writers of one number one fails, and a reader keeps the version that it began with for as long as it isn't
expired. What a failed writer leaves goes when versions of its number expire. Creation must be exclusive in the store, as in
HDFS and local folders.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOG = "_versions"
_DIGITS = 8


class Conflict(Exception):
    """Another writer has made the version."""


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    store, p = _store(spark, f"{path}/{_LOG}")
    return sorted(s.getPath().getName() for s in store.listStatus(p) if s.getPath().getName().isdigit()) if store.exists(p) else []


def history(spark: SparkSession, path: str) -> list[int]:
    """The versions that there are, oldest first."""
    return [int(n) for n in _names(spark, path)]


def folder(spark: SparkSession, path: str, version: int | None = None) -> str:
    """Where a version's files lie, by default the current one's; the path itself if it has no versions."""
    have = history(spark, path)
    if not have and version is None:
        return path
    version = have[-1] if version is None else version
    if version not in have:
        raise ValueError(f"{path} has no version {version}")
    store, p = _store(spark, f"{path}/{_LOG}/{version:0{_DIGITS}d}")
    stream = store.open(p)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def write(df: DataFrame, path: str, *partition_by: str, version: int | None = None) -> int:
    """Writes df as the next version, or as the one named, which must not exist; returns its number."""
    spark = df.sparkSession
    have = history(spark, path)
    number = (have[-1] + 1 if have else 1) if version is None else version
    if number in have:
        raise Conflict(f"{path} has version {number} already")
    name = f"v{number:0{_DIGITS}d}-{uuid.uuid4().hex[:12]}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path}/{name}")
    _publish(spark, path, number, name)
    return number


def _publish(spark: SparkSession, path: str, number: int, name: str) -> None:
    store, p = _store(spark, f"{path}/{_LOG}/{number:0{_DIGITS}d}")
    try:
        stream = store.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            store.delete(_store(spark, f"{path}/{name}")[1], True)
            raise Conflict(f"{path} got version {number} from another writer") from None
        raise
    stream.write(name.encode())
    stream.close()


def read(spark: SparkSession, path: str, version: int | None = None, schema: StructType | None = None) -> DataFrame:
    """A version as it is; later ones don't change it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(folder(spark, path, version))


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes all but the newest versions: first their files, then their folders, and those that failed writers left of
    such numbers, which no writer can make current any more."""
    have = history(spark, path)
    gone = have[:-keep]
    for number in gone:
        store, p = _store(spark, f"{path}/{_LOG}/{number:0{_DIGITS}d}")
        store.delete(p, True)
    if not gone:
        return
    store, top = _store(spark, path)
    for status in store.listStatus(top):
        name = status.getPath().getName()
        if re.fullmatch(rf"v\d{{{_DIGITS}}}-\w+", name) and int(name[1 : _DIGITS + 1]) <= gone[-1]:
            store.delete(status.getPath(), True)
