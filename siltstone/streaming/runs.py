"""Structured Streaming twins of the event reducers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.session import remove, shared_dir
from siltstone.sources.sinks import merged

LATENESS = "2 days"


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_batch: int = 1) -> DataFrame:
    """A table's files (one file, or a folder of them) as a stream, its time as an event time with the stated lateness."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    source = reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def distinct_events(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Events without repetitions of their keys within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def day_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def session_counts(stream: DataFrame, key: str, gap: str) -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


STATE = "user_id long, state string, n_events long"


def run_states(stream: DataFrame) -> DataFrame:
    """State machine per run: running, failed, completed; completed never reverts. State is one small row per run."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rank, n = state.get if state.exists else (0, 0)
        for pdf in batches:
            n += len(pdf)
            kinds = set(pdf["event_type"])
            rank = max(rank, 2 if "purchase" in kinds else 1 if "error" in kinds else 0)
        state.update((rank, n))
        yield pd.DataFrame([(key[0], ("running", "failed", "completed")[rank], n)], columns=["user_id", "state", "n_events"])

    return stream.groupBy("user_id").applyInPandasWithState(step, STATE, "rank int, n long", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there and return the table it wrote, in the shared folder.

    Append mode writes with Spark's exactly-once file sink; complete mode keeps the last result; update mode merges each
    batch by ``keys``, the later row winning, into a new version of the table, so that a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    atexit.register(remove, spark, base)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/table").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/table")
    versions: dict[int, str] = {}

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{base}/table-{number}"
        if mode == "update" and versions:
            old = spark.read.schema(batch.schema).parquet(versions[max(v for v in versions if v != number)])
            batch = merged(old, batch, keys or [])
        batch.write.mode("overwrite").parquet(path)
        versions[number] = path

    writer.foreachBatch(keep).start().awaitTermination()
    if not versions:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(versions[max(versions)])
