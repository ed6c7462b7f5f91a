"""Tables that a configuration gives: species, axes, extents, the mesh, shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph import schemas
from velograph.config import Run

#: Rows up to which a table whose size is known beforehand is broadcast.
SMALL = 100_000
#: Numbers up to which a list known beforehand stands in the plan itself.
LISTED = 1_024


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its known number of rows is small; else Spark chooses the join."""
    return F.broadcast(df) if rows <= SMALL else df


def listed(numbers: list[float], at: Column) -> Column:
    """The number of a list at a place, from 0 on: a constant of the plan, where a join would look it up."""
    return F.array(*[F.lit(float(x)) for x in numbers])[at]


def species_table(spark: SparkSession, run: Run) -> DataFrame:
    rows = [(i, s.name, *map(float, (s.charge, s.mass, s.n_maxw, s.t_maxw, s.upar_maxw))) for i, s in enumerate(run.species)]
    return spark.createDataFrame(rows, schemas.SPECIES)


def axis_table(spark: SparkSession, run: Run, *names: str) -> DataFrame:
    """axis, idx, coord, periodic of the named axes, or of all five."""
    rows = [(n, i, x, a.periodic) for n, a in run.axes.items() if not names or n in names for i, x in enumerate(a.points)]
    return spark.createDataFrame(rows, schemas.AXIS)


def breakpoint_table(spark: SparkSession, run: Run) -> DataFrame:
    rows = [(n, i, x) for n, a in run.axes.items() for i, x in enumerate(a.breakpoints)]
    return spark.createDataFrame(rows, schemas.BREAKPOINTS)


def extents_table(spark: SparkSession, run: Run) -> DataFrame:
    """The extent of species and each axis, and the four of a moment."""
    e = run.extents
    rows = [(n, [v]) for n, v in e.items()] + [("fluid_moments", [e[n] for n in ("species", "tor1", "tor2", "tor3")])]
    return spark.createDataFrame(rows, schemas.EXTENTS)


def mesh(spark: SparkSession, run: Run, partitions: int | None = None) -> DataFrame:
    """All points of species and the five axes, by their indices. Decoded from one range, so it is spread over
    tasks from the start; a task's points are whole cells, as far as they go."""
    e = list(run.extents.values())
    count = 1
    for n in e:
        count *= n
    ids = spark.range(0, count, 1, partitions) if partitions else spark.range(count)
    columns, stride = [], count
    for name, n in zip(schemas.POINT, e, strict=True):
        stride //= n
        columns.append(F.expr(f"CAST((id div {stride}L) % {n}L AS INT) AS {name}"))
    return ids.select(*columns)


def shift_table(spark: SparkSession, shifts: list[tuple[int, float, float]]) -> DataFrame:
    return spark.createDataFrame(shifts, schemas.SHIFTS)


def random_shifts(spark: SparkSession, n_iterations: int, seed: int) -> DataFrame:
    """One uniform draw from [-1, 1) for each iteration and angle, from 1 on."""
    draw = lambda s: F.rand(s) * 2 - 1
    return spark.range(1, n_iterations + 1, 1, 1).select(F.col("id").cast("int").alias("iteration"), draw(seed).alias("shift_tor2"), draw(seed + 1).alias("shift_tor3"))


def labelled(raw: DataFrame, column: str, extents: list[int], names: tuple[str, ...] = schemas.POINT, value: str = "f", keep: tuple[str, ...] = ()) -> DataFrame:
    """A flat array, last index fastest, as a row for each element with its indices; and the columns of keep, if rows are many arrays."""
    long = raw.select(*keep, F.posexplode(column).alias("pos", value))
    stride, columns = 1, []
    for name, n in reversed(list(zip(names, extents, strict=True))):
        columns.append(F.expr(f"CAST((pos div {stride}) % {n} AS INT) AS {name}"))
        stride *= n
    return long.select(*keep, *reversed(columns), value)
