"""Stored tables: Parquet, one folder for each, with the collision policy "replace and warn". What replaces a table is its next
version: the one before is read until the new one is whole, and stays for readers that have begun with it."""

from __future__ import annotations

import itertools
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from velograph import schemas
from velograph.config import Run
from velograph.functions.numeric import decode_padded
from velograph.operators import exchange
from velograph.sources import generate, versions

log = logging.getLogger(__name__)
DISTRIBUTION, MOMENTS, TIMING, IN_SITU = "fdistribu", "fluid_moments", "cpu_time", "fluid_moments_in_situ"
TRANSPOSED, BLOCKS, FILE_NAMES = "fdistribu_transposed", "fdistribu_blocks", "file_names"
_scratch = itertools.count()


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads exists."""
    store, p = _hadoop(spark, path)
    return store.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    store, p = _hadoop(spark, path)
    store.delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """Where the driver and all executors write and read: spark.checkpoint.dir, else a folder of the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A new folder's name there; the folder goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{next(_scratch)}"
    store, p = _hadoop(spark, path)
    store.mkdirs(p)
    store.deleteOnExit(p)
    return path


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written to the shared folder and read from there: computed once, and not again for a lost executor."""
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_and_warn(df: DataFrame, path: str, *partition_by: str) -> None:
    if exists(df.sparkSession, path):
        log.warning("replacing %s", path)
    versions.write(df, path, *partition_by)
    versions.expire(df.sparkSession, path, keep=2)


def write_observed(df: DataFrame, path: str, figures: dict[str, Column], *partition_by: str) -> dict:
    """Writes df, and returns aggregates of its rows that the same job takes as it writes them."""
    seen = Observation()
    replace_and_warn(df.observe(seen, *[c.alias(name) for name, c in figures.items()]), path, *partition_by)
    return seen.get


def _table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The current version of a table; a folder of plain Parquet files as it is."""
    return versions.read(spark, path, schema=schema)


def write_distribution(f: DataFrame, run: Run, top: str, *, name: str = DISTRIBUTION, dealt: bool = False) -> None:
    """f, stored by species and tor1, which scans then prune; and the axes and extents beside it. Rows are dealt
    out by cell planes first, so a folder gets few files; where they lie so already (a mesh, a stored f), nothing is
    shuffled."""
    f = f.select(*schemas.POINT, "f")
    rows = f if dealt else f.repartition("sp", "i1", "i2")
    replace_and_warn(rows.sortWithinPartitions(*schemas.POINT), f"{top}/{name}", "sp", "i1")
    write_mesh(f.sparkSession, run, top)


def write_transposed(f: DataFrame, top: str) -> None:
    """A distribution in velocity split, stored by species and vpar."""
    replace_and_warn(f, f"{top}/{TRANSPOSED}", "sp", "iv")


def write_blocks(blocks: DataFrame, top: str) -> None:
    """A distribution in block layout, stored by species and tor1: its moments need no shuffle."""
    replace_and_warn(blocks, f"{top}/{BLOCKS}", "sp", "i1")


def write_mesh(spark: SparkSession, run: Run, top: str) -> None:
    replace_and_warn(generate.axis_table(spark, run).coalesce(1), f"{top}/axis")
    replace_and_warn(generate.breakpoint_table(spark, run).coalesce(1), f"{top}/breakpoints")
    replace_and_warn(generate.extents_table(spark, run).coalesce(1), f"{top}/extents")
    replace_and_warn(generate.species_table(spark, run).coalesce(1), f"{top}/species")
    replace_and_warn(spark.createDataFrame([("input", run.file_name)], schemas.FILE_NAMES).coalesce(1), f"{top}/{FILE_NAMES}")


def write_moments(moments: DataFrame, top: str, name: str = MOMENTS) -> None:
    replace_and_warn(moments, f"{top}/{name}")


def write_in_situ(moments: DataFrame, top: str) -> None:
    """moments with `iteration`, each iteration's folder replaced by itself."""
    moments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iteration").parquet(f"{top}/{IN_SITU}")


def write_timing(spark: SparkSession, names: list[str], seconds: list[float], top: str) -> None:
    if len(names) != len(seconds):
        raise ValueError(f"{len(names)} names for {len(seconds)} durations")
    rows = list(zip(range(len(names)), names, map(float, seconds), strict=True))
    replace_and_warn(spark.createDataFrame(rows, schemas.TIMING).coalesce(1), f"{top}/{TIMING}")


def read_file_names(spark: SparkSession, top: str) -> DataFrame:
    return _table(spark, f"{top}/{FILE_NAMES}", schemas.FILE_NAMES)


def read_species(spark: SparkSession, top: str) -> DataFrame:
    return _table(spark, f"{top}/species", schemas.SPECIES)


def read_axis(spark: SparkSession, top: str, axis: str) -> DataFrame:
    return _table(spark, f"{top}/axis", schemas.AXIS).where(F.col("axis") == axis)


def read_breakpoints(spark: SparkSession, top: str, axis: str) -> DataFrame:
    return _table(spark, f"{top}/breakpoints", schemas.BREAKPOINTS).where(F.col("axis") == axis)


def read_extents(spark: SparkSession, top: str) -> dict[str, list[int]]:
    """A handful of numbers, whatever the size of the mesh."""
    return {r["name"]: list(r["extents"]) for r in _table(spark, f"{top}/extents", schemas.EXTENTS).collect()}


def axis_size(spark: SparkSession, top: str, axis: str) -> int:
    """An axis's extent from the stored points alone."""
    return read_axis(spark, top, axis).count()


def read_distribution(spark: SparkSession, top: str, starts: dict[str, int] | None = None, sizes: dict[str, int] | None = None, name: str = DISTRIBUTION) -> DataFrame:
    """f, or a hyperslab of it: species and tor1 prune folders, the others are pushed into the scan."""
    f = _table(spark, f"{top}/{name}", schemas.DISTRIBUTION).select(*schemas.POINT, "f")
    return exchange.hyperslab(f, starts, sizes or {}) if starts else f


def read_transposed(spark: SparkSession, top: str) -> DataFrame:
    return _table(spark, f"{top}/{TRANSPOSED}", schemas.DISTRIBUTION).select(*exchange.TRANSPOSED, "f")


def read_blocks(spark: SparkSession, top: str) -> DataFrame:
    return _table(spark, f"{top}/{BLOCKS}", schemas.BLOCKS).select(*schemas.CELL, "f")


def read_moments(spark: SparkSession, top: str, name: str = MOMENTS) -> DataFrame:
    return _table(spark, f"{top}/{name}", schemas.MOMENTS)


def read_in_situ(spark: SparkSession, top: str, last: bool = False) -> DataFrame:
    """All iterations; or the last alone, with the velocity under its short name."""
    df = spark.read.schema(schemas.ITERATED_MOMENTS).parquet(f"{top}/{IN_SITU}")
    if not last:
        return df
    newest = df.agg(F.max("iteration")).first()[0]
    return df.where(F.col("iteration") == newest).withColumnRenamed("mean_velocity", "velocity")


def timing_rows(raw: DataFrame) -> DataFrame:
    """ord, name, seconds of parallel arrays `timing_names` (padded bytes or strings) and `timing_values`; cut to
    the shorter one."""
    name = F.col("name")
    kind = dict(raw.dtypes)["timing_names"]
    zipped = F.slice(F.arrays_zip(F.col("timing_names").alias("name"), F.col("timing_values").alias("seconds")), 1, F.least(F.size("timing_names"), F.size("timing_values")))
    rows = raw.select(F.posexplode(zipped).alias("ord", "r")).select("ord", F.col("r.name").alias("name"), F.col("r.seconds").alias("seconds"))
    return rows.select("ord", (decode_padded(name) if "binary" in kind else F.rtrim(name, F.lit("\0"))).alias("name"), "seconds")


def timing_table(spark: SparkSession, top: str) -> DataFrame:
    return _table(spark, f"{top}/{TIMING}", schemas.TIMING)


def read_timing(spark: SparkSession, top: str) -> str:
    """The timing table as text. No file: a failing exit; no column: a message."""
    path = f"{top}/{TIMING}"
    if not exists(spark, path):
        raise SystemExit(f"Error: {path} not found")
    try:
        df = _table(spark, path)
    except AnalysisException as e:
        raise SystemExit(f"Error reading {path}: {e}") from None
    # Title, rules and columns of the table.
    lines = ["CPU Timing Statistics", "=" * 50]
    if "name" not in df.columns:
        return "\n".join([*lines, f"Error: name not found; columns: {', '.join(df.columns)}"])
    if "seconds" not in df.columns:
        return "\n".join([*lines, "Warning: seconds not found", *(f"  {k}: {r.name}" for k, r in enumerate(df.orderBy("ord").collect()))])
    rows = df.orderBy("ord").select(F.format_string("%-20s %15.6f", "name", "seconds")).collect()
    return "\n".join([*lines, f"{'Name':<20} {'Time (s)':>15}", "-" * 50, *(r[0] for r in rows), "-" * 50])
