"""As-of join: for each row the latest row of another table with its keys, at or before its time.

Both tables are united and dealt by ranges of keys and time, so a hot key is as many tasks as its rows
are worth.  A task streams over its rows in order and holds one row of the right side.  What is
open at its beginning, rows of its first key before any right one, takes the last right row that an earlier task
ends with for that key: a row a task, carried on by a window over the tasks.

Defined cases: null keys or times match nothing, and left rows with them stay; of right rows
with equal keys and time the largest (column by column) counts; rows are kept as often as they
are there; empty tables give left rows without a match, or none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; true for the first one."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = True
    for k in keys:
        c = batch.column(k)
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return out


def _streamed(batches: Iterator[pa.RecordBatch], keys: Sequence[str], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, side, l, r) in order: left rows with the last right one; at the end a row that says what the task ends with."""
    task = TaskContext.get().partitionId()
    first, before, inside_first = None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if first is None:
            first = batch.slice(0, 1)
        given = batch.num_rows
        if before is not None:
            batch = pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
        new = _changes(batch, keys)
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        side = batch.column("side").to_numpy()
        last = np.maximum.accumulate(np.where(side == 0, np.arange(len(side)), -1))
        found = last >= start
        in_first = (np.cumsum(new) == 1) if inside_first else np.zeros(len(new), bool)
        rows = np.arange(len(side) - given, len(side))
        rows = rows[side[rows] == 1]
        match = pc.take(batch.column("r"), pa.array(last[rows], mask=~found[rows]))
        n = len(rows)
        taken = {"task": pa.array(np.full(n, task)), "kind": pa.array(np.ones(n, np.int32)), "l": batch.column("l").take(pa.array(rows)), "r": match, "met": pa.array(found[rows]), "open": pa.array(in_first[rows] & ~found[rows])}
        taken |= {k: batch.column(k).take(pa.array(rows)) for k in keys}
        taken |= {f"{k}_last": pa.nulls(n, batch.column(k).type) for k in keys}
        yield pa.RecordBatch.from_arrays([taken[c] for c in columns], columns)
        inside_first = inside_first and not (np.cumsum(new) > 1).any()
        # the last right row of the last key, or any row of it: what the next batch goes on from
        at = int(last[-1]) if found[-1] else len(side) - 1
        before = batch.slice(at, 1)
    if first is not None:
        ends = before.column("side")[0].as_py() == 0
        row = {"task": pa.array([task], pa.int64()), "kind": pa.array([0], pa.int32()), "l": pa.nulls(1, before.column("l").type), "met": pa.array([ends]), "open": pa.array([False])}
        row["r"] = before.column("r") if ends else pa.nulls(1, before.column("r").type)
        row |= {k: first.column(k) for k in keys} | {f"{k}_last": before.column(k) for k in keys}
        yield pa.RecordBatch.from_arrays([row[c] for c in columns], columns)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, prefix: str = "last_") -> DataFrame:
    """left's columns, and right's with the prefix: its latest row at or before left's time, or nulls."""
    named = lambda df: F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])
    l, r = named(left), named(right)
    kinds = {"l": left.select(l.alias("x")).dtypes[0][1], "r": right.select(r.alias("x")).dtypes[0][1]}
    ks = [f"k{i}" for i in range(len(keys))]
    on = lambda df: [F.col(f"`{k}`").alias(n) for k, n in zip(keys, ks)]
    usable = lambda df, at: reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in (*keys, at)])
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    # equal keys and time: one row is left before anything is dealt, however many there are
    latest = right.where(usable(right, right_time)).select(*on(right), F.col(f"`{right_time}`").alias("at"), r.alias("r")).groupBy(*ks, "at").agg(F.max("r").alias("r"))
    rows = latest.select(*ks, "at", F.lit(0).alias("side"), null("l"), "r")
    rows = rows.unionByName(left.where(usable(left, left_time)).select(*on(left), F.col(f"`{left_time}`").alias("at"), F.lit(1).alias("side"), l.alias("l"), null("r")))
    order = [*ks, "at", "side"]
    # a hash of the row splits left rows that are equal in keys and time
    spread = F.when(F.col("side") == 1, F.xxhash64("l")).otherwise(0)
    dealt = rows.withColumn("spread", spread).repartitionByRange(*order, "spread").sortWithinPartitions(*order)
    types = dict(rows.dtypes)
    schema = {"task": "long", "kind": "int", **{k: types[k] for k in ks}, **{f"{k}_last": types[k] for k in ks}, "l": kinds["l"], "r": kinds["r"], "met": "boolean", "open": "boolean"}
    names = list(schema)
    met, _ = written(dealt.drop("at", "spread").mapInArrow(lambda b: _streamed(b, ks, names), ", ".join(f"{c} {t}" for c, t in schema.items())), "asof")
    ends = met.where("kind = 0")  # a row a task
    told = ends.select(*[F.col(f"{k}_last").alias(k) for k in ks], "task", F.lit(1).alias("told"), F.when(F.col("met"), F.struct("r")).alias("carried"))
    asks = ends.select(*ks, "task", F.lit(0).alias("told"), F.lit(None).cast(told.select("carried").dtypes[0][1]).alias("carried"))
    before = F.last("carried", True).over(W.partitionBy(*ks).orderBy("task", "told").rowsBetween(W.unboundedPreceding, 0))
    carried = told.unionByName(asks).withColumn("carried", before).where("told = 0").select(F.col("task").alias("t"), "carried")
    out = met.where("kind = 1").join(F.broadcast(carried), F.col("task") == F.col("t"), "left")
    found = F.when(F.col("open"), F.col("carried.r")).otherwise(F.col("r"))
    lefts = [F.col(f"l.c{k}").alias(c) for k, c in enumerate(left.columns)]
    rights = [(f"c{k}", f"{prefix}{c}") for k, c in enumerate(right.columns)]
    joined = out.withColumn("found", found).select(*lefts, *[F.col(f"found.{c}").alias(n) for c, n in rights])
    alone = left.where(~usable(left, left_time)).select(*[F.col(f"`{c}`") for c in left.columns], *[F.lit(None).cast(t).alias(f"{prefix}{c}") for c, t in right.dtypes])
    return joined.unionByName(alone)
