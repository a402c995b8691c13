"""Cases that arrive and are edited over time, as Structured Streaming queries that restart from their checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def submissions(spark: SparkSession, folder: str, schema: StructType | str, files_each: int = 100) -> DataFrame:
    """Parquet files put into a folder, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def evaluate_each(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str):
    """Evaluates each micro-batch's cases and writes the result as one folder per batch, overwritten if the batch runs again, so
    that a restart gives every case once."""

    def write(batch: DataFrame, number: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest_values(stream: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """The value given last for each key so far: what edits to a case come to. Complete output; state is one row for each key."""
    return stream.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias(at), F.count(F.lit(1)).alias("edits"))


def once_each(stream: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """Requests without those that repeat one of the last `within` of event time: each page is fetched once in that time."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, as a table (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_folder(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now, written to a folder that driver and executors share and read from there. A micro-batch that runs again
    overwrites its own part; in complete mode the last batch's result counts."""
    spark, schema = stream.sparkSession, stream.schema
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")
        numbers.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    if not numbers:
        return spark.createDataFrame([], schema)
    parts = numbers[-1:] if mode == "complete" else sorted(set(numbers))
    return spark.read.schema(schema).parquet(*(f"{folder}/result/batch={n}" for n in parts))
