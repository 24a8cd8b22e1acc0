import pytest

from pagewright.api import TOOLS, Engine
from pagewright.config import Query, Settings
from pagewright.operators import query
from pagewright.sources import pdf_objects
from pagewright.sources.pdf import read_pages
from pagewright.sources.pdf_writer import Page, write
from pagewright.streaming.ingest import ingest

TEXT = "Erste Zeile (mit Klammern) \\ é\nZweite Zeile\n\nnach einer Leerzeile"
INFO = {"Title": " A title ", "Author": "Ää", "Subject": "日本", "Producer": "p", "CreationDate": "D:20260101", "Keywords": "x; y,z", "Other": "o"}
PAGES = [
    Page(TEXT, [(100, 50, "DCTDecode", "DeviceRGB", 8, b"jpeg"), (3, 2, "FlateDecode", "DeviceGray", 1, b"\x00"), (0, 5, None, "DeviceRGB", 8, b"")]),
    Page("", annotations=[("Link", "", (10, 20, 110, 40)), (None, "untyped", None), ("Text", "a note", None)], media_box=(0, 0, 200, 100), rotate=90),
    Page("last"),
]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("compress", [False, True])
def test_parser_round_trip(packed, compress):
    rows = list(read_pages(write(PAGES, INFO, compress=compress, packed=packed)))
    assert [r["error"] for r in rows] == [None] * 3 and rows[0]["n_pages"] == 3
    assert [x for x in rows[0]["text"].split("\n") if x] == [x for x in TEXT.split("\n") if x] and rows[2]["text"] == "last" and rows[1]["text"] == ""
    assert [(i["width"], i["filter"], i["bits"]) for i in rows[0]["images"]] == [(100, "DCTDecode", 8), (3, "FlateDecode", 1), (0, None, 8)]
    assert rows[0]["media_box"] == [0, 0, 612, 792] and not rows[0]["own_media_box"]
    assert rows[1]["media_box"] == [0, 0, 200, 100] and rows[1]["own_media_box"] and rows[1]["rotation"] == 90
    assert [a["subtype"] for a in rows[1]["annotations"]] == ["Link", None, "Text"]
    assert rows[0]["info"]["Subject"] == "日本" and rows[0]["info"]["Author"] == "Ää"


def test_an_object_stream_is_opened_once(monkeypatch):
    data, decoded = write([Page(f"page {k}") for k in range(50)], INFO, packed=True), []
    decode = pdf_objects.Document.decode
    monkeypatch.setattr(pdf_objects.Document, "decode", lambda self, s: decoded.append(s.dict.get("Type")) or decode(self, s))
    assert [r["text"] for r in read_pages(data)] == [f"page {k}" for k in range(50)]
    assert decoded.count("ObjStm") == 1


@pytest.mark.parametrize("data", [b"", b"This is not a PDF file", bytes(1024), b"%PDF-1.4\n", write(PAGES)[:60]])
def test_bad_files_are_rows(data):
    (row,) = read_pages(data)
    assert row["error"] and "page_number" not in row


def test_damaged_cross_references_are_rebuilt():
    data = write(PAGES, INFO)
    broken = data[: data.rindex(b"startxref")]
    assert [r["text"] for r in read_pages(broken)][2] == "last"
    assert [r["text"] for r in read_pages(data.replace(b"startxref\n", b"startxref\n9"))][2] == "last"


def test_encrypted_files_are_refused():
    data = write(PAGES).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt <</Filter /Standard>>")
    assert [r["error"] for r in read_pages(data)] == ["encrypted PDF"]


def test_filters():
    a85 = pdf_objects._ascii85(b"<~87cURD]i,\"Ebo80~>")
    assert a85 == b"Hello World!"
    assert pdf_objects._run_length(bytes([2, 97, 98, 99, 254, 120, 128])) == b"abcxxx"
    assert pdf_objects._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf_objects._unpredict(bytes([2, 1, 2, 2, 1, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3])
    lexed = pdf_objects.Lexer(rb"<</A#20b [1 0 R -2.5 (a\(b\)\101\n) <414>] /T true>>").value()
    assert lexed == {"A b": [pdf_objects.Ref(1, 0), -2.5, b"a(b)A\n", b"A@"], "T": True}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("pdfs")
    (top / "sub").mkdir()
    (top / "report_a.pdf").write_bytes(write(PAGES, INFO))
    (top / "sub" / "_Scan.PDF").write_bytes(write([Page("", [(9, 9, "DCTDecode", "DeviceRGB", 8, b"x")])]))
    (top / ".pdf").write_bytes(write([Page("a\nb\nc\nd"), Page("e\nf\ng\nh")]))
    (top / "empty.pdf").write_bytes(b"")
    (top / "fake.pdf").write_bytes(b"This is not a PDF file")
    (top / "notes.txt").write_text("x")
    return str(top)


@pytest.fixture(scope="module")
def engine(spark, folder):
    return Engine(spark, Settings(dir=folder))


def test_directories(engine, folder):
    names = [r.name for r in engine.search_directory().collect()]
    assert names == [".pdf", "fake.pdf", "report_a.pdf", "_Scan.PDF"]
    assert [r.name for r in engine.search_directory(folder, "report").collect()] == ["report_a.pdf"]
    assert [r.name for r in engine.search_pattern(folder, "*.PDF").collect()] == ["_Scan.PDF"]
    assert engine.search_pattern(folder + "/missing", "*").count() == 0
    assert engine.count_files().first().n_files == 4 and engine.stats_directory().first().total_files == 4
    with pytest.raises(FileNotFoundError, match="directory does not exist"):
        engine.search_directory(folder + "/missing")
    info = engine.server_info().collect()
    assert {r.key for r in info if r.section == "tool"} == set(TOOLS) and sum(r.section == "file" for r in info) == 4


def test_validation(engine, folder):
    got = {n: engine.validate_file(f"{folder}/{n}" if n else "").first() for n in ("report_a.pdf", "empty.pdf", "fake.pdf", "notes.txt", "gone.pdf", "sub", "")}
    assert {n: r.valid for n, r in got.items()} == {"report_a.pdf": True, "empty.pdf": False, "fake.pdf": False, "notes.txt": False, "gone.pdf": False, "sub": False, "": False}
    assert "file is empty" in got["empty.pdf"].message and "invalid PDF file" in got["fake.pdf"].message and "not a PDF" in got["notes.txt"].message
    assert "does not exist" in got["gone.pdf"].message and "directory" in got["sub"].message and got[""].message == "path cannot be empty"


def test_reading(engine, folder):
    r = engine.read_file(f"{folder}/report_a.pdf").first()
    assert r.content_type == "mixed" and r.image_count == 3 and r.pages == 3 and r.content.count("--- Page Break ---") == 2 and r.error is None
    scan = engine.read_file(f"{folder}/sub/_Scan.PDF").first()
    assert scan.content_type == "scanned_images" and scan.error == "failed to extract text content: no text content could be extracted from PDF"
    images = engine.assets_file(f"{folder}/report_a.pdf").collect()
    assert [(i.page_number, i.width, i.format, i.size) for i in images] == [(1, 100, "JPEG", 15000), (1, 3, "PNG/Deflate", 0)]
    with pytest.raises(ValueError, match="file does not exist"):
        engine.read_file(f"{folder}/gone.pdf")


def test_contents(engine, folder):
    path = f"{folder}/report_a.pdf"
    s = engine.stats_file(path).first()
    assert (s.pages, s.title, s.author) == (3, "A title", "Ää")
    m = engine.metadata(path).first()
    assert m.keywords == ["x", "y", "z"] and m.custom_properties == {"Other": "o"} and not m.encrypted
    assert [(p.number, p.width, p.height) for p in engine.page_info(path).orderBy("number").collect()] == [(1, 612, 792), (2, 200, 100), (3, 612, 792)]
    found = engine.extract_complete(path, coordinates=False).collect()
    assert sorted({r.type for r in found}) == ["annotation", "image", "text"]
    assert [(r.element_id, r.width) for r in found if r.type == "annotation"] == [("annotation_2_0", 100), ("annotation_2_1", 0)]
    assert engine.query_content(path, Query(text="NOTE")).first().element_id == "annotation_2_1"
    assert {r.kind for r in engine.query_summary(path, '{"types": ["image"]}').collect()} == {"type", "page", "all"}
    t = engine.extract_tables(f"{folder}/.pdf").first()
    assert (t.n_rows, t.n_columns, t.cell_count) == (4, 2, 8)
    assert engine.table_cells(f"{folder}/.pdf").where("is_header").count() == 2


def test_render(engine, folder):
    from pagewright import render

    assert "Content type: mixed" in render.document(engine.read_file(f"{folder}/report_a.pdf"))
    assert render.listing(engine.search_directory(), "Files", {"name": "", "size": "size"}, 2).endswith("... and 2 more")
    assert "Title: A title" in render.record(engine.metadata(f"{folder}/report_a.pdf"), "Metadata")


def test_incremental_ingest(spark, folder, tmp_path):
    target, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, folder, target, mark).awaitTermination(120)
        got = spark.read.parquet(target)
        assert got.where("page_number is not null").groupBy("path").count().count() == 1


def test_reading_parses_files_once(spark):
    from pagewright.operators import reading
    from pagewright.sources import pdf

    made = spark.createDataFrame([("a", write(PAGES)), ("b", b"cut off"), ("c", write([Page("one"), Page(""), Page("three")]))], "path string, content binary")
    read = reading.read_documents(pdf.parse(made, ("text", "images")), 10)
    assert read._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.path: r for r in read.collect()}
    assert got["a"].content == TEXT.encode()[:10].decode() and (got["a"].pages, got["a"].image_count, got["a"].error) == (3, 3, None)
    assert got["b"].error.startswith("failed to open PDF: ") and (got["b"].pages, got["b"].content, got["b"].content_type) == (0, "", "no_content")
    assert [x for x in got["c"].content.split("\n") if x] == ["one", "--- Page Break ---", "--- Page Break ---", "three"]


def test_results_as_text(engine, folder):
    from pagewright import render

    path = f"{folder}/report_a.pdf"
    assert render.validation(engine.validate_file(path)) == f"{path} is valid"
    assert render.validation(engine.validate_file(f"{folder}/fake.pdf")).startswith(f"{folder}/fake.pdf is not valid: invalid PDF file: ")
    assert render.assets(engine.assets_file(path)) == "Images: 2\n1. page 1, width 100, height 50, format JPEG, bytes 15000\n2. page 1, width 3, height 2, format PNG/Deflate, bytes 0"
    assert "Title: A title" in render.file_stats(engine.stats_file(path)) and "Total files: 4" in render.directory(engine.stats_directory())
    catalogue = render.server(engine.server_info())
    assert catalogue.startswith("tool\n  ") and "image_format\n  " in catalogue and "report_a.pdf" in catalogue
    assert render.matches(engine.query_content(path, "a note")) == "Matches: 1\n1. page 2, text: a note"
    assert "Annotation elements: 2" in render.extraction(query.counts_by_type(engine.extract_complete(path)))
    assert render.search(engine.search_directory("", "report")) == "PDF files: 1\n1. report_a.pdf"
