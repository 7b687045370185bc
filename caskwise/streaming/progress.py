"""Running progress of batches by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caskwise.session import shared_folder



def running_counts(stream: DataFrame) -> DataFrame:
    """Sessions, finished and failed sessions of each batch so far; sessions without a batch are left out."""
    return stream.where("batch_id is not null").groupBy("batch_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("status") != "pending").alias("done"), F.count_if(F.col("status") == "fail").alias("failed"))


def hourly(stream: DataFrame, ts: str, late: str = "2 hours") -> DataFrame:
    """Events a type and hour, with late ones up to the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def drained(spark: SparkSession, path: str, name: str, query=running_counts) -> DataFrame:  # noqa: ANN001
    """The final state after table `name` under `path` has streamed through `query`; offsets and state lie in the shared folder."""
    source = f"{path}/{name}"
    schema = spark.read.parquet(source).schema
    single = spark.read.parquet(source).inputFiles()[0].endswith(f"/{name}")  # a file, not a folder of files
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if single else "*.parquet").parquet(path if single else source)
    out = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    run = query(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/offsets").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/counts")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/counts")
