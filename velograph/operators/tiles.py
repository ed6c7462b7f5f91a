"""Block transposition: vectors turned into dimension-major tiles, and back, with one shuffle of arrays each way.

A tile has the values of `block` neighbouring ids in `width` dimensions, dimension by dimension. What is shuffled is a
slice of a vector, not its single values, and a tile, not its rows; so a value costs its own bytes and a share of a key.
A tile has at most block x width values for each time that an id is there. Vectors that are null or of another length than
`dims` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_tiles(df: DataFrame, row_id: str, vector: str, dims: int, block: int = 1024, width: int = 16) -> DataFrame:
    """block, chunk, ids (in order), values: those of the chunk's first dimension for all ids, then of the next."""
    starts = range(0, dims, width)
    slices = F.array(*[F.struct(F.lit(k).alias("chunk"), F.slice(vector, s + 1, width).alias("v")) for k, s in enumerate(starts)])
    cut = df.where(F.size(vector) == dims).select(F.floor(F.col(row_id) / block).cast("bigint").alias("block"), F.col(row_id).alias("id"), F.explode(slices).alias("s"))
    rows = cut.groupBy("block", F.col("s.chunk").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("id", F.col("s.v").alias("v")))).alias("x"))
    columns = F.transform(F.sequence(F.lit(0), F.size(F.col("x")[0]["v"]) - 1), lambda j: F.transform("x", lambda r: F.get(r["v"], j)))
    return rows.select("block", "chunk", F.transform("x", lambda r: r["id"]).alias("ids"), F.flatten(columns).alias("values"))


def from_tiles(tiles: DataFrame, row_id: str, vector: str) -> DataFrame:
    """The vectors again: a block's tiles come together, and each id's values are picked out of them."""
    whole = tiles.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids", "values"))).alias("t"))
    whole = whole.withColumn("ids", F.col("t")[0]["ids"]).withColumn("n", F.size("ids"))
    of_tile = lambda t, k: F.transform(F.sequence(F.lit(0), (F.size(t["values"]) / F.col("n")).cast("int") - 1), lambda j: F.get(t["values"], j * F.col("n") + k))
    rows = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.get("ids", k).alias("id"), F.flatten(F.transform("t", lambda t: of_tile(t, k))).alias("v")))
    return whole.select(F.explode(rows).alias("r")).select(F.col("r.id").alias(row_id), F.col("r.v").alias(vector))


def dimensions(tiles: DataFrame, width: int = 16) -> DataFrame:
    """block, dim, ids, values: a row for each dimension of a block, without another shuffle."""
    n = F.size("ids")
    rows = F.transform(F.sequence(F.lit(0), (F.size("values") / n).cast("int") - 1), lambda j: F.struct((F.col("chunk") * width + j).alias("dim"), F.slice("values", j * n + 1, n).alias("values")))
    return tiles.select("block", "ids", F.explode(rows).alias("r")).select("block", F.col("r.dim").alias("dim"), "ids", F.col("r.values").alias("values"))
