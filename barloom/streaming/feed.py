"""Runs a stream over a landing folder that fills up in parts, and saves its batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from barloom.session import fresh_dir, stage, unstage
from barloom.streaming.quotes import run_to_end


def save_batches(out: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step: each batch writes its own partition, so a batch that runs again replaces itself."""
    def save(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    return save


def in_parts(rows: DataFrame, part: Column, parts: int, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Lands the rows part by part; after each the stream is started again from its checkpoint and runs to the end of what is there.

    ``start`` makes the writer from the streamed rows. So there are at least ``parts`` micro-batches with a restart between any two.
    """
    spark = rows.sparkSession
    landing, checkpoint = fresh_dir(spark, "landing"), fresh_dir(spark, "checkpoint")
    dealt = stage(rows.withColumn("_part", part), "parts")
    for i in range(parts):
        dealt.filter(F.col("_part") == i).drop("_part").write.mode("append").parquet(landing)
        run_to_end(start(spark.readStream.schema(rows.schema).parquet(landing)), checkpoint)
    unstage(dealt)
