import pytest
from pyspark.sql import functions as F

from pagewright.config import Box, ExtractConfig, Query, Settings, TableRules, check_file_limit
from pagewright.operators import documents, elements, query, reading, search, stats, tables, validate

MIB = 1 << 20
FILES = "path string, name string, size long, is_dir boolean"


def _files(spark, rows):
    return spark.createDataFrame([(f"/d/{n}", n, s, n == "dir.pdf") for n, s in rows], FILES)


def _pages(spark, texts, path="a"):
    return spark.createDataFrame([(path, k + 1, t) for k, t in enumerate(texts)], "path string, page_number int, text string")


def test_search(spark):
    f = _files(spark, [("document1.pdf", 1024), ("research_paper.pdf", 2048), ("machine_learning.pdf", 512), ("report.txt", 9), ("empty.pdf", 0), ("large.pdf", 2 * MIB)])
    counts = {q: search.search(f, q, MIB).count() for q in ("", "machine", "research", "nonexistent")}
    assert counts == {"": 3, "machine": 1, "research": 1, "nonexistent": 0}
    g = _files(spark, [(n + ".pdf", 10) for n in ("report_2023", "report_2024", "summary_2023", "document")])
    found = {p: search.search_pattern(g, p).count() for p in ("report_*.pdf", "*_2023.pdf", "*.pdf", "nonexistent_*.pdf", "", "[")}
    assert found == {"report_*.pdf": 2, "*_2023.pdf": 2, "*.pdf": 4, "nonexistent_*.pdf": 0, "": 4, "[": 0}
    assert search.count_files(g).first().n_files == 4


def test_walk_order(spark):
    f = spark.createDataFrame([("a.pdf",), ("a/b.pdf",), ("a-/c.pdf",)], "path string")
    assert [r.path for r in search.in_walk_order(f).collect()] == ["a/b.pdf", "a-/c.pdf", "a.pdf"]


def test_directory_stats(spark):
    r = stats.directory_stats(_files(spark, [("small.pdf", 512), ("medium.pdf", 1024), ("large.pdf", 2048)])).first()
    assert (r.total_files, r.total_size, r.largest_size, r.largest_name, r.smallest_size, r.smallest_name, r.average_size) == (3, 3584, 2048, "large.pdf", 512, "small.pdf", 1194)
    tied = stats.directory_stats(_files(spark, [("b.pdf", 5), ("a.pdf", 5)])).first()
    assert tied.largest_name == tied.smallest_name == "a.pdf"
    none = stats.directory_stats(_files(spark, [])).first()
    assert (none.total_files, none.total_size, none.average_size, none.largest_name) == (0, 0, 0, None)


def test_validation_messages(spark):
    f = _files(spark, [("valid.pdf", 1024), ("large.pdf", 2 * MIB), ("empty.pdf", 0), ("document.txt", 5), ("dir.pdf", None)])
    got = {r.path.split("/")[-1]: r.message for r in validate.validate(f, None, MIB).collect()}
    assert got == {
        "valid.pdf": "", "large.pdf": f"file too large: {2 * MIB} bytes (max: {MIB} bytes)", "empty.pdf": "file is empty: /d/empty.pdf",
        "document.txt": "file is not a PDF: /d/document.txt", "dir.pdf": "path is a directory, not a file: /d/dir.pdf",
    }
    missing = spark.createDataFrame([("", None, False), ("/d/x.pdf", None, False)], "path string, size long, is_dir boolean")
    assert {r.message for r in validate.validate(missing, None, MIB).collect()} == {"path cannot be empty", "file does not exist: /d/x.pdf"}


def test_reader_gate_lets_empty_files_through(spark):
    f = _files(spark, [("a.pdf", 1024), ("b.pdf", 1025), ("c.pdf", 0)])
    assert {r.name: r.m is None for r in f.select("name", validate.reader_message(1024).alias("m")).collect()} == {"a.pdf": True, "b.pdf": False, "c.pdf": True}


def test_text_assembly(spark):
    assert reading.document_texts(_pages(spark, ["A", "B"])).first().content == "A\n\n--- Page Break ---\n\nB"
    assert reading.document_texts(_pages(spark, ["A", None])).first().content == "A\n\n--- Page Break ---\n\n"
    assert reading.document_texts(_pages(spark, ["abc", "defg", "h"]), 5).first().content == "abc\n\n--- Page Break ---\n\nde"


@pytest.mark.parametrize(("text", "images", "kind"), [
    ("x" * 49, False, "no_content"), ("x" * 49, True, "scanned_images"), ("x" * 50, False, "text"), ("x" * 50, True, "mixed"), ("é" * 25, False, "text"),
    ("\n\n--- Page Break ---\n\n", True, "scanned_images"), ("", False, "no_content"), (None, True, "scanned_images"),
])
def test_content_types(spark, text, images, kind):
    assert spark.range(1).select(reading.content_type(F.lit(text).cast("string"), F.lit(images)).alias("t")).first().t == kind


def test_lines_and_words(spark):
    pages = _pages(spark, ["a b\n\nc"])
    got = {r.element_id: r for r in elements.line_elements(pages).collect()}
    assert set(got) == {"line_1_0", "line_1_2"}
    assert (got["line_1_0"].llx, got["line_1_0"].lly, got["line_1_0"].urx, got["line_1_0"].ury) == (72, 720, 540, 732)
    assert (got["line_1_2"].lly, got["line_1_2"].ury, got["line_1_2"].confidence) == (696, 708, 0.8)
    words = {r.element_id: r for r in elements.word_elements(pages).collect()}
    assert (words["word_1_0"].llx, words["word_1_0"].urx, words["word_1_1"].llx, words["word_1_1"].urx) == (72, 306, 306, 540)
    assert (words["word_1_0"].width, words["word_1_0"].confidence, words["word_1_0"].parent_id) == (234, 0.7, "line_1_0")
    assert "word_1_2000" in words


def test_page_selection(spark):
    pages = _pages(spark, ["x", "y", "z"])
    ordered = lambda p: [r.page_number for r in elements.select_pages(pages, p).orderBy("request_idx").collect()]
    assert ordered((3, 1, 1, 9, 0)) == [3, 1, 1] and ordered(()) == [1, 2, 3]


def test_modes(spark):
    pages = _pages(spark, ["a b\nc", "  "])
    ids = lambda **o: sorted(r.element_id for r in elements.extract(pages, ExtractConfig(**o)).collect())
    assert ids(mode="raw") == ids(mode="semantic") == ["text_1_0"]
    assert ids(mode="structured", coordinates=False) == ["line_1_0", "line_1_1"]
    assert ids(mode="structured") == ["line_1_0", "line_1_1", "word_1_0", "word_1_1", "word_1_1000"]
    assert ids(mode="table", coordinates=False) == ["line_1_0", "line_1_1"] and ids(mode="table", strict=True) == ["text_1_0"]
    assert ids(text=False, vectors=True, forms=True) == []
    with pytest.raises(ValueError, match="mode"):
        ExtractConfig(mode="other")


def _elements(spark, rows):
    base = elements.no_elements(_pages(spark, ["x"]), "text")
    made = [{"path": "a", "element_id": str(k), "level": 0} | r for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(f) for f in base.columns) for r in made], ", ".join(f"{c} {t}" for c, t in base.dtypes))


def test_query(spark):
    e = _elements(spark, [
        {"type": "text", "page_number": 1, "confidence": 0.9, "llx": 0.0, "lly": 0.0, "urx": 1.0, "ury": 1.0, "text": "Hello"},
        {"type": "image", "page_number": 1, "confidence": 0.8, "llx": 3.0, "lly": 3.0, "urx": 4.0, "ury": 4.0, "text": "hello"},
        {"type": "text", "page_number": 2, "confidence": 0.7, "llx": 5.0, "lly": 5.0, "urx": 6.0, "ury": 6.0, "text": "bye"},
    ])
    ids = lambda **q: sorted(r.element_id for r in query.query(e, Query(**q)).collect())
    assert ids() == ["0", "1", "2"] and ids(text="HELLO") == ["0"] and ids(box=Box(1, 1, 2, 2)) == ["0"]
    assert ids(types=("image",)) == ["1"] and ids(pages=(2,)) == ["2"] and ids(min_confidence=0.8) == ["0", "1"]
    assert ids(types=("text",), pages=(1,), min_confidence=0.9, text="ell", box=Box(0, 0, 9, 9)) == ["0"]
    s = {(r.kind, r.key): (r.n, round(r.avg_confidence, 2)) for r in query.summary(e).collect()}
    assert s[("type", "text")][0] == 2 and s[("type", "image")][0] == 1 and s[("page", "1")][0] == 2 and s[("all", "")] == (3, 0.8)
    none = query.summary(e.where("false")).collect()
    assert [(r.kind, r.n, r.avg_confidence) for r in none] == [("all", 0, 0.0)]
    assert Query.from_json('{"types": ["text"], "min_confidence": 0.5}') == Query(types=("text",), min_confidence=0.5)
    assert Query.from_json("plain words") == Query(text="plain words")


def test_box_join_is_the_theta_join(spark):
    e = _elements(spark, [{"type": "text", "page_number": 1, "llx": float(x), "lly": float(y), "urx": float(x + w), "ury": float(y + 12)} for x in (0, 72, 250, 256) for y in (-20, 0, 250, 720) for w in (0, 6, 468)])
    boxes = [(1, 72.0, 700.0, 100.0, 732.0), (2, 0.0, 0.0, 256.0, 256.0), (3, -50.0, -50.0, 900.0, 900.0), (4, 78.0, 0.0, 78.0, 0.0)]
    b = spark.createDataFrame(boxes, "box_id int, q_llx double, q_lly double, q_urx double, q_ury double")
    got = sorted((r.box_id, r.element_id) for r in query.box_join(e, b).collect())
    rows = e.collect()
    assert got == sorted((k, r.element_id) for k, p, q, s, t in boxes for r in rows if not (r.urx < p or r.llx > s or r.ury < q or r.lly > t))


def _lines(spark, *texts):
    return elements.line_elements(_pages(spark, texts))


def test_anchored_clustering(spark):
    e = _elements(spark, [{"type": "text", "page_number": 1, "lly": y} for y in (720.0, 716.0, 712.0, 708.0)])
    assert sorted((-r.lly, r.row_index) for r in tables.anchored_rows(e).collect()) == [(-720, 0), (-716, 0), (-712, 1), (-708, 1)]


@pytest.mark.parametrize("grid", [True, False])
def test_tables(spark, grid):
    one = tables.tables(_lines(spark, "a\nb\nc\nd"), grid=grid).first()
    assert (one.n_rows, one.n_columns, one.cell_count, one.confidence) == (4, 1, 4, 1.0)
    pooled = tables.tables(_lines(spark, "a\nb\nc\nd", "e\nf\ng\nh"), grid=grid).first()
    assert (pooled.n_rows, pooled.n_columns, pooled.cell_count) == (4, 2, 8)
    by_page = tables.tables(_lines(spark, "a\nb\nc\nd", "e\nf\ng\nh"), TableRules(scope="page"), grid=grid).collect()
    assert [(r.n_rows, r.n_columns) for r in by_page] == [(4, 1), (4, 1)]
    ragged = _lines(spark, "a\nb\n\nc\nd", "e\nf\ng\n\nh")  # widths 2, 2, 1, 1, 2
    assert tables.tables(ragged, TableRules(threshold=0.7), grid=grid).count() == 0
    cells = tables.cells(_lines(spark, "a\nb\nc\nd", "e\nf\ng"), TableRules(threshold=0.7), grid=grid).collect()
    assert len(cells) == 6 and {r.table_confidence for r in cells} == {0.75} and {r.row_index for r in cells if r.is_header} == {0}
    assert tables.tables(_lines(spark, "a\nb\nc"), grid=grid).count() == 0
    low = _lines(spark, "a\nb\nc", "d\ne", "f")  # widths 3, 2, 1
    assert tables.tables(low, TableRules(threshold=0.0), grid=grid).count() == 0


def test_parents(spark):
    pages = _pages(spark, ["a b"])
    both = elements.union_elements([elements.line_elements(pages), elements.word_elements(pages)])
    assert {(r.element_id, r.parent_text) for r in elements.with_parents(both).collect()} == {("line_1_0", None), ("word_1_0", "a b"), ("word_1_1", "a b")}
    assert elements.first_elements(both, 5).count() == 1 and query.counts_by_type(both).first().text_elements == 1


@pytest.mark.parametrize(("mode", "port", "dir_", "level", "size", "ok"), [
    ("stdio", 8080, ".", "info", 1, True), ("server", 8080, ".", "info", 1, True), ("invalid", 8080, ".", "info", 1, False), ("server", 0, ".", "info", 1, False),
    ("server", 70000, ".", "info", 1, False), ("stdio", 0, ".", "info", 1, True), ("stdio", 1, "", "info", 1, False), ("stdio", 1, ".", "invalid", 1, False), ("stdio", 1, ".", "info", 0, False),
])
def test_settings(mode, port, dir_, level, size, ok):
    flags = {"mode": mode, "port": port, "dir": dir_, "log-level": level, "max-file-size": size}
    if ok:
        assert Settings.load(flags, {}).port == port
    else:
        with pytest.raises(ValueError):
            Settings.load(flags, {})


def test_settings_precedence():
    env = {"PAGEWRIGHT_PORT": "9000", "PAGEWRIGHT_HOST": "h", "PAGEWRIGHT_LOG_LEVEL": "debug"}
    s = Settings.load(["--port=9001"], env)
    assert (s.port, s.host, s.log_level, s.max_file_size) == (9001, "h", "debug", 100 * MIB)


@pytest.mark.parametrize(("size", "message"), [(0, "greater than 0"), (-1, "greater than 0"), (2 << 30, "cannot exceed 1GB")])
def test_file_limit(size, message):
    with pytest.raises(ValueError, match=message):
        check_file_limit(size)


def test_empty_parsed(spark):
    from pagewright.schema import PARSED

    none = spark.createDataFrame([], PARSED)
    for made in (documents.images(none), documents.page_info(none), documents.metadata(none), reading.read_documents(none), elements.image_elements(none), elements.annotation_elements(none)):
        assert made.count() == 0
