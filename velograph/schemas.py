"""The explicit schemas of all stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, _KINDS[v], True) for k, v in fields.items()])


_KINDS = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "doubles": T.ArrayType(T.DoubleType(), True),
    "bigints": T.ArrayType(T.LongType(), True),
}

SPECIES = _struct(sp="int", name="string", charge="double", mass="double", n_maxw="double", t_maxw="double", upar_maxw="double")
AXIS = _struct(axis="string", idx="int", coord="double", periodic="boolean")
BREAKPOINTS = _struct(axis="string", idx="int", breakpoint="double")
DISTRIBUTION = _struct(sp="int", i1="int", i2="int", i3="int", iv="int", im="int", f="double")
BLOCKS = _struct(sp="int", i1="int", i2="int", i3="int", f="doubles")
MOMENTS = _struct(sp="int", i1="int", i2="int", i3="int", density="double", mean_velocity="double", temperature="double")
ITERATED_MOMENTS = T.StructType([T.StructField("iteration", T.IntegerType()), *MOMENTS.fields])
WEIGHTS = _struct(iv="int", im="int", vpar="double", mu="double", w="double")
SHIFTS = _struct(iteration="int", shift_tor2="double", shift_tor3="double")
EXTENTS = _struct(name="string", extents="bigints")
PARTITION_PLAN = _struct(part="int", starts="bigints", extents="bigints")
FILE_NAMES = _struct(kind="string", name="string")
TIMING = _struct(ord="int", name="string", seconds="double")

CELL = ("sp", "i1", "i2", "i3")
POINT = (*CELL, "iv", "im")
