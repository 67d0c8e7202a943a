"""Starting streams over files or topics and running them to the end of what is there."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.sources import fixtures, tables

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder(spark: SparkSession) -> str:
    """A new shared folder for a stream."""
    return tables.folder(spark, "streams")


def topic(spark: SparkSession, servers: str, name: str, per_trigger: int = 1000) -> DataFrame:
    """A Kafka topic's values as strings; needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name).option("maxOffsetsPerTrigger", per_trigger).load().select(F.col("value").cast("string").alias("value"))


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int = 100, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(maxFilesPerTrigger=per_trigger, **options).format(fmt).load(path)


def event_stream(spark: SparkSession, sf_dir: str, delay: str | None = "10 minutes") -> DataFrame:
    """Sensor events of a data folder as a stream with event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = files(spark, sf_dir, schema, pathGlobFilter="events.parquet")
    events = fixtures.shaped(raw).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", delay) if delay else events


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """The state store that arbitrary stateful processing needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def drain(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, timeout_s: int = 600, observed: list[dict] | None = None) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote.

    Each trigger's observed metrics, by name, are appended to ``observed``;
    Spark remembers ``spark.sql.streaming.numRecentProgressUpdates`` triggers.

    ``append`` goes to a Parquet sink with exactly-once commits; ``complete``
    and ``update`` go through foreachBatch to a folder for each batch, and the
    result is the last batch of ``complete``, or all rows of ``update``.
    """
    spark, at = df.sparkSession, folder(df.sparkSession)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append" and each is None:
        start = writer.format("parquet").option("path", f"{at}/out").start
    else:
        last: list[int] = []

        def put(batch: DataFrame, number: int) -> None:
            (each or (lambda b, n: b.write.mode("overwrite").parquet(f"{at}/batches/n={n}")))(batch, number)
            last.append(number)

        start = writer.foreachBatch(put).start
    with rocks(spark):
        query = start()
        if not query.awaitTermination(timeout_s):
            query.stop()
            raise TimeoutError("the stream didn't end")
    if query.exception():
        raise query.exception()
    if observed is not None:
        observed.extend(p.observedMetrics for p in query.recentProgress)
    if each is not None:
        return spark.range(0)
    if mode == "append":
        return spark.read.schema(df.schema).parquet(f"{at}/out")
    return spark.read.schema(df.schema).parquet(f"{at}/batches/n={last[-1]}" if mode == "complete" else f"{at}/batches/*")


def in_turns(slices: list[DataFrame], transform: Callable[[DataFrame], DataFrame], *, pause_s: float = 0.0, rows: int = 0, timeout_s: int = 600) -> DataFrame:
    """What ``transform`` of a stream writes whose data come slice by slice, each after the one before is processed.

    The stream is stopped and started again from its checkpoint between slices, after a pause of ``pause_s``; after
    the last one it runs on until it has written ``rows`` rows, for timers.  A stream with processing time never runs out of
    triggers, so it is stopped when its progress says that it has read the slice.
    """
    spark, at = slices[0].sparkSession, folder(slices[0].sparkSession)
    schema = slices[0].schema
    with rocks(spark):
        for i, part in enumerate(slices):
            if i:
                time.sleep(pause_s)
            part.write.mode("append").parquet(f"{at}/in")
            wanted, read = part.count(), {}
            out = transform(spark.readStream.schema(schema).parquet(f"{at}/in"))
            query = out.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").format("parquet").option("path", f"{at}/out").trigger(processingTime="500 milliseconds").start()
            began = time.monotonic()
            while sum(read.values()) < wanted and query.isActive and time.monotonic() - began < timeout_s:
                time.sleep(0.2)
                read |= {p.batchId: p.numInputRows for p in query.recentProgress if p.numInputRows}
            while rows and i == len(slices) - 1 and query.isActive and time.monotonic() - began < timeout_s:
                if spark.read.schema(out.schema).parquet(f"{at}/out").count() >= rows:
                    break
                time.sleep(1)
            query.stop()
            if query.exception():
                raise query.exception()
            if sum(read.values()) < wanted:
                raise TimeoutError("the stream didn't read its slice")
    return spark.read.schema(out.schema).parquet(f"{at}/out")
