"""What several operators share: the shared folder, written tables, texts as bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path

_holders: dict[str, Callable[[], None]] = {}


def sole_memory(name: str, clear: Callable[[], None]) -> None:
    """Says that an operator remembers words in this worker from now on; what others remember is let go.

    Workers outlive stages, so without this the memories of all stages would add up.
    """
    others = [k for k in _holders if k != name]
    for other in others:
        _holders.pop(other)()
    _holders[name] = clear
    if others:
        let_go()  # at once: the end of a long task is too late


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches; what the task used goes back to the system at its end, as workers outlive tasks."""

    def over(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            let_go()

    return over


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so Arrow batches hold fewer rows than the default: less memory in either process.

    A number set for the session is left as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) in (None, "10000"):
        spark.conf.set(name, "1000")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def let_go() -> None:
    """Gives memory that this process no longer uses back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()  # Arrow's is none of the C library's
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that are used no more, and lets the driver let go of their shuffle files."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    let_go()
    jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo a small number; null keys count as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def row_hash(docs: DataFrame) -> Column:
    """64 bits over all columns of a row; nulls count, and maps as their text."""
    columns = [F.col(f"`{c}`").cast("string") if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])
