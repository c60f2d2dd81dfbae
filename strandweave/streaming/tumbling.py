"""Event-time windows over streams of readings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.runtime import shared_folder


def tumbling_means(stream: DataFrame, value: str, width: str, late: str | None = "1 day") -> DataFrame:
    """Mean and count per subject and window, for batches and streams alike.

    With `late`, windows are kept open that long for late rows and then leave the state; without,
    every window stays open, which suits bounded replays only. Null and NaN values count in no mean.
    """
    s = stream.withWatermark("ts", late) if late else stream
    v = F.when(~F.isnan(value), F.col(value))
    g = s.groupBy("subject_id", F.window("ts", width).alias("w")).agg(F.avg(v).alias("_m"), F.count(v).alias("n"))
    return g.select("subject_id", F.unix_seconds("w.start").alias("bucket"), F.round(F.col("_m") + 1e-9, 6).alias(value), "n")


def replayed_tumbling_mean(spark: SparkSession, readings: DataFrame, value: str, width: str) -> DataFrame:
    """The windows of a written table, read as a stream to its end; state and result lie in the shared folder."""
    root = f"{shared_folder(spark)}/strandweave/stream-{uuid.uuid4().hex}"
    readings.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 64).parquet(f"{root}/in")
    out = tumbling_means(stream, value, width, late=None)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out")

    query = out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def kept_windows(stream: DataFrame, value: str, width: str, late: str, path: str, checkpoint: str):  # noqa: ANN201
    """Starts a query that appends closed windows to a table; late rows beyond `late` are dropped by the watermark."""
    return tumbling_means(stream, value, width, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
