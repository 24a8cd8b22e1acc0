"""Streams: newly arrived files parsed once each, windowed counts, content versions and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..sources.pdf import ALL, parse


DISCOVERY, LOOKUPS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 32


def file_stream(spark: SparkSession, directory: str, max_file_size: int = 100 << 20, per_trigger: int = 1000) -> DataFrame:
    """path, content, size and modified_time of PDF files as they appear below a directory."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", per_trigger).load(directory)
    return s.where((F.col("length") > 0) & (F.col("length") <= max_file_size)).select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified_time"))


def page_stream(spark: SparkSession, directory: str, fields: tuple[str, ...] = ALL) -> DataFrame:
    return parse(file_stream(spark, directory), fields)


def ingest(spark: SparkSession, directory: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parses everything that is new into Parquet and stops; the checkpoint remembers what was seen.

    For each batch Spark looks its files up once more, by default with a task a file, each of which reports
    to the driver; LOOKUPS bounds these tasks, in this session too.
    """
    if int(spark.conf.get(DISCOVERY, "10000")) > LOOKUPS:
        spark.conf.set(DISCOVERY, str(LOOKUPS))
    return page_stream(spark, directory).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by kind and tumbling window; on a stream, state is dropped behind the watermark."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if events.isStreaming else e
    return e.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


VERSIONS = "path string, version long, hash string, since timestamp"
_STATE = "hash string, version long, at timestamp"


def versions(arrivals: DataFrame, keep: str = "30 days", late: str = "1 day") -> DataFrame:
    """(path, version, hash, since) for each change of a path's content, of a stream (path, hash, at).

    A path's last hash and version number are its state; the same content again is no new version, and what
    comes later than the watermark allows is dropped.  A path that nothing is heard of for
    ``keep`` loses its state and would start again at 1.  Rows of one batch count in order of time, then hash.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, version, _ = state.get if state.exists else (None, 0, None)
        rows, latest = [], None
        for frame in frames:
            rows += list(zip(frame["at"], frame["hash"], frame["until"]))
        out = []
        for at, content, until in sorted(rows, key=lambda r: (r[0], r[1] or "")):
            latest = until if latest is None else max(latest, until)
            if version == 0 or content != last:
                last, version = content, version + 1
                out.append((key[0], version, content, at))
        state.update((last, version, rows[-1][0].to_pydatetime()))
        state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "version", "hash", "since"])

    timed = arrivals.select("path", "hash", F.col("at").cast("timestamp").alias("at")).where("path is not null and at is not null").withColumn("until", F.col("at") + F.expr(f"interval {keep}"))
    return timed.withWatermark("at", late).groupBy("path").applyInPandasWithState(run, VERSIONS, _STATE, "append", "EventTimeTimeout")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", time: str = "ts") -> DataFrame:
    """(key, start, end, n): runs of events without a gap; on a stream a session comes out once no event can join it any more."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if events.isStreaming else e
    return e.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
