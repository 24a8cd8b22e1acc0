"""Reports as lines, and the sink that writes them."""

import os

import pytest
from pyspark.sql import functions as F

from pagewright import render
from pagewright.operators import reports
from pagewright.sources import report_sink

LINES = "path string, line int, text string"


def back(spark, path):
    return sorted((r.path, r.line, r.text) for r in report_sink.read_reports(spark, path).collect())


def test_what_is_written_reads_back(spark, tmp_path):
    rows = [(f"p{k % 7}/é {k % 7}", k // 7, t) for k, t in enumerate(["plain", "", "\ftwo feeds", "\f", "\f\f", "tab\there", "été 💡", " spaces ", "\\f", "last\r"] * 5)]
    df = spark.createDataFrame(rows, LINES).repartition(5)
    at = f"file://{tmp_path}/a"
    report_sink.write_reports(df, at)
    assert back(spark, at) == sorted(rows)
    assert "_SUCCESS" in os.listdir(tmp_path / "a") and not [n for n in os.listdir(tmp_path / "a") if n.startswith("_pending")]
    report_sink.write_reports(spark.createDataFrame([("other", 0, "x")], LINES), at)
    assert len(back(spark, at)) == len(rows) + 1
    report_sink.write_reports(spark.createDataFrame([("other", 0, "y")], LINES), at, "overwrite")
    assert back(spark, at) == [("other", 0, "y")]
    plain = str(tmp_path / "b")
    report_sink.write_reports(df.limit(0), plain)
    assert os.listdir(plain) == ["_SUCCESS"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "broken")
    rows = [(f"p{k}", 0, "text") for k in range(200)] + [("bad", 0, "two\nlines")]
    with pytest.raises(Exception, match="line end"):
        report_sink.write_reports(spark.createDataFrame(rows, LINES), at)
    assert not os.path.exists(at) or os.listdir(at) == []
    report_sink.write_reports(spark.createDataFrame([("p", 0, "kept")], LINES), at)
    with pytest.raises(Exception, match="line end"):
        report_sink.write_reports(spark.createDataFrame(rows, LINES), at, "overwrite")
    assert back(spark, at) == [("p", 0, "kept")] and not [n for n in os.listdir(at) if n.startswith("_pending")]


def test_lists_show_their_first_entries(spark):
    rows = [("many", k, f"name{k:02d}", None if k % 2 else 5.0) for k in range(25)] + [("one", 0, "only", 1.0)]
    df = spark.createDataFrame(rows, "path string, k int, name string, x double")
    got = sorted((r.path, r.line, r.text) for r in reports.list_lines(df, "Things", {"name": "", "x": "x"}, [F.desc("k")], 3).collect())
    assert got == [("many", 0, "Things: 25"), ("many", 1, "1. name24, x 5.0"), ("many", 2, "2. name23"), ("many", 3, "3. name22, x 5.0"), ("many", 4, "... and 22 more"), ("one", 0, "Things: 1"), ("one", 1, "1. only, x 1.0")]


def test_records_show_what_they_hold(spark):
    df = spark.createDataFrame([("a", "T", None, ["x", "y"], 0), ("b", "", 3, [], None)], "path string, title string, page_count int, keywords array<string>, n int")
    got = sorted((r.path, r.line, r.text) for r in reports.record_lines(df, "File", ["title", "page_count", "keywords", "n"]).collect())
    assert got == [("a", 0, "File"), ("a", 1, "Title: T"), ("a", 2, "Keywords: x, y"), ("a", 3, "N: 0"), ("b", 0, "File"), ("b", 1, "Page count: 3")]


def test_lines_go_on_from_text_to_text(spark):
    df = spark.createDataFrame([("a", 0, "x\ny"), ("a", 1, ""), ("a", 2, "\nz"), ("b", 5, "only")], LINES)
    assert sorted((r.path, r.line, r.text) for r in reports.as_lines(df).collect()) == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, ""), ("a", 3, ""), ("a", 4, "z"), ("b", 0, "only")]


def test_one_document_reads_as_on_the_driver(spark):
    df = spark.createDataFrame([("f.pdf", 2, 10, "mixed", True, 3, "one\ntwo", None), ("g.pdf", 0, 5, None, False, 0, None, "broken")], "path string, pages int, size long, content_type string, has_images boolean, image_count long, content string, error string")
    got = {}
    for r in reports.document(df).orderBy("path", "line").collect():
        got.setdefault(r.path, []).append(r.text)
    assert "\n".join(got["f.pdf"]) == render.document(df.where("path = 'f.pdf'")) and got["g.pdf"] == ["Error: broken"]
    sections = spark.createDataFrame([("limit", "dir", "/x"), ("tool", "b", ""), ("tool", "a", "does a")], "section string, key string, value string")
    assert sorted((r.path, r.line, r.text) for r in reports.server(sections).collect()) == [("limit", 0, "dir: /x"), ("tool", 0, "a: does a"), ("tool", 1, "b")]
