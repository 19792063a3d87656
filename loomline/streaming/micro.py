"""Score only new files, and window counts that are the same in batch and stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomline.functions.identifiers import full_name
from loomline.session import shared_folder


def score_new_files(
    spark: SparkSession, source: str, schema: StructType | str, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, per_batch: int = 64
) -> StreamingQuery:
    """Scores the parquet files of a folder that no earlier run has seen and appends the results, exactly once per file.

    Each micro-batch goes to its own folder and replaces it if repeated after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame) -> DataFrame:
    """Runs an aggregation over what a stream holds now, to its end, and returns its last result, a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/result")


def windowed_counts(df: DataFrame, time: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """``(start, keys, n)`` per window of ``width``; on a stream ``late`` says how long a window waits for late rows."""
    d = df.withWatermark(time, late) if late else df
    g = d.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), *keys, "n")


def first_deliveries(stream: DataFrame, ident: str, time: str, wait: str = "30 days", kind: str = "t1") -> DataFrame:
    """A stream of messages without repetitions that arrive within ``wait``; state older than that is given up."""
    d = stream.withColumn("__key", full_name(ident, kind)).withWatermark(time, wait)
    return d.dropDuplicatesWithinWatermark(["__key"]).drop("__key")
