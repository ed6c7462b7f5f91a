"""In-situ diagnostics as a stream of iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from velograph import schemas
from velograph.config import Run
from velograph.operators import distribution
from velograph.plans import simulate
from velograph.plans.events import Events
from velograph.schemas import CELL
from velograph.sources import files


def run_stream(spark: SparkSession, run: Run, shifts_path: str, top: str, checkpoint: str, events: Events | None = None) -> StreamingQuery:
    """Diagnoses the state of every row of shifts that arrives as Parquet in a folder; that of iteration 0 is state 0,
    whatever its shifts. A batch's iterations are written each to a folder of its own, so a batch
    that is run again after a failure replaces its own output."""
    events = events or Events()

    def diagnose(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        shifts = batch.select("iteration", "shift_tor2", "shift_tor3").dropDuplicates(["iteration"])
        eps = F.when(F.col("iteration") == 0, F.lit(0.0)).otherwise(F.lit(run.eps))
        f = distribution.perturb(distribution.initial(session, run), session, run, shifts, shifts.count(), eps)
        found = simulate.moments_of(f, session, run, ("iteration", *CELL))
        files.write_in_situ(found, top)
        events.publish("FluidMoments", epoch=epoch)

    arriving = spark.readStream.schema(schemas.SHIFTS).option("maxFilesPerTrigger", 1).parquet(shifts_path)
    return arriving.writeStream.foreachBatch(diagnose).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_moments(events: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Count, sum and spread of `value` by event type and window of `ts`, with late rows dropped after `delay`;
    for a stream or a table."""
    seen = events.withWatermark("ts", delay) if events.isStreaming else events
    v = F.col("value")
    sums = seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(v).alias("density"), F.avg(v).alias("mean_value"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "density", "mean_value")
