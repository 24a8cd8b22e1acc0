"""Stateful streams over several batches: late and repeated rows, state that goes, restarts."""

import os
import time
from datetime import datetime, timedelta

import pytest

from pagewright.sources.files import listing_stream
from pagewright.streaming.ingest import sessions, versions

T = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over rows that arrive batch by batch, each run from the last one's checkpoint; gives all that came out."""

    def run(make, schema, batches):
        out = []
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            arriving = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            arriving.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
            out.append(sorted(tuple(r) for r in spark.read.schema(arriving.schema).parquet(str(tmp_path / "out")).collect()))
        return out

    return run


def test_versions_go_on_from_batch_to_batch(stream):
    day = timedelta(days=1)
    batches = [
        [("a", "h1", T), ("a", "h1", T + timedelta(hours=1)), ("a", "h2", T + timedelta(hours=2)), ("b", "x", T), (None, "x", T)],
        [("a", "h2", T + timedelta(hours=3)), ("a", "h1", T + timedelta(hours=4)), ("b", "x", T + timedelta(hours=5)), ("b", "y", T + 3 * day)],
        [("a", "late", T), ("b", "y", T + 4 * day)],  # the first is behind the watermark, three days less one
        [("b", "z", T + 30 * day)],
        [("b", "z", T + 31 * day), ("a", "h1", T + 31 * day)],  # a was not heard of for ten days: it starts again
    ]
    out = stream(lambda s: versions(s, "10 days"), "path string, hash string, at timestamp", batches)
    first = [("a", 1, "h1", T), ("a", 2, "h2", T + timedelta(hours=2)), ("b", 1, "x", T)]
    second = first + [("a", 3, "h1", T + timedelta(hours=4)), ("b", 2, "y", T + 3 * day)]
    assert out[0] == sorted(first) and out[1] == sorted(second) and out[2] == out[1]
    third = second + [("b", 3, "z", T + 30 * day)]
    assert out[3] == sorted(third)
    assert out[4] == sorted([*third, ("a", 1, "h1", T + 31 * day)])


def test_sessions_come_out_once_closed(stream):
    at = lambda m: T + timedelta(minutes=m)
    batches = [[(1, at(0)), (1, at(20)), (2, at(5))], [(1, at(40)), (1, at(40)), (2, at(200))], [(2, at(10)), (1, at(500))]]
    out = stream(lambda s: sessions(s, "30 minutes", "1 hour"), "user_id long, ts timestamp", batches)
    assert out[0] == []  # nothing is sure yet
    assert out[1] == [(1, at(0), at(70), 4), (2, at(5), at(35), 1)]  # the watermark is at 140 minutes
    assert out[2] == sorted([*out[1], (2, at(200), at(230), 1)])  # the late event is dropped


def test_sessions_of_a_table(spark):
    rows = [(1, T), (1, T + timedelta(minutes=29)), (1, T + timedelta(minutes=60))]
    found = sessions(spark.createDataFrame(rows, "user_id long, ts timestamp"))
    assert sorted((r.n, r.end - r.start) for r in found.collect()) == [(1, timedelta(minutes=30)), (2, timedelta(minutes=59))]


def test_listings_report_every_arrival_once(spark, tmp_path):
    top = tmp_path / "files"
    (top / "sub").mkdir(parents=True)
    out, seen = str(tmp_path / "listed"), []

    def arrived():
        """What another run of the stream, from its checkpoint, adds."""
        time.sleep(0.15)
        found = listing_stream(spark, str(top), settle=50)
        found.select("name", "size").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        rows = sorted((r.name, r.size) for r in spark.read.schema("name string, size long").parquet(out).collect())
        new = list(rows)
        for r in seen:
            new.remove(r)
        seen[:] = rows
        return new

    (top / "a.pdf").write_bytes(b"1")
    (top / ".hidden.pdf").write_bytes(b"12")
    (top / "sub" / "_empty.pdf").touch()
    assert arrived() == [(".hidden.pdf", 2), ("_empty.pdf", 0), ("a.pdf", 1)]
    assert arrived() == []
    (top / "a.pdf").write_bytes(b"changed")  # reported again, as it is now
    old = tmp_path / "old.pdf"
    old.write_bytes(b"123")
    os.utime(old, (0, 0))
    old.rename(top / "sub" / "old.pdf")  # a date of long ago does not hide it
    assert arrived() == [("a.pdf", 7), ("old.pdf", 3)]
    (top / "new").mkdir()
    (top / "new" / "b.txt").write_bytes(b"")
    assert arrived() == [("b.txt", 0)] and arrived() == []


def test_ingest_looks_files_up_in_few_tasks(spark, tmp_path):
    from pagewright.sources.pdf_writer import Page, write
    from pagewright.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    for k in range(70):
        (tmp_path / "in" / f"{k}.pdf").write_bytes(write([Page(f"file {k}")]))
    query = ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(job).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 32
    assert spark.read.parquet(str(tmp_path / "out")).count() == 70
