"""Structured Streaming forms of the event operators. Event time is a timestamp; rows later than the watermark are dropped."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over Parquet files of the events table: a folder, or one file (a stream source lists folders, so its folder is read for that name)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        reader, path = reader.option("pathGlobFilter", re.sub(r"([\\*?\[\]{}])", r"\\\1", place.getName())), place.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def debounced(stream: DataFrame, key: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """The first event of a key passes; later ones within the interval after it are dropped.

    State goes when the watermark is ten intervals past the last event that passed: by event time, so
    that a backfill forgets as a live stream does, and ends.
    """

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("ts")
        keep = []
        for t in rows["ts"]:
            ms = int(t.value // 1_000_000)
            ok = last is None or ms - last >= seconds * 1000
            keep.append(ok)
            last = ms if ok else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last + 10 * seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[keep][[key, "ts"]]

    kind = stream.schema[key].dataType.simpleString()
    return stream.withWatermark("ts", late).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def routed(stream: DataFrame, rules: list[tuple[str, object]], otherwise: str = "default") -> DataFrame:
    """Add `route`: the first rule (name, condition) that holds."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return stream.withColumn("route", out)


def micro_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 5):
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over all that is there now and return it as a table (tests, backfills). A query that fails raises its error here."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
