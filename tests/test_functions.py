import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry, text
from pagewright.functions.formats import estimated_size, image_format
from pagewright.operators.search import is_pdf, matches

NAMES = [
    ("document.pdf", True), ("DOCUMENT.PDF", True), ("Document.Pdf", True), ("file.PDF", True), (".pdf", True), ("document.txt", False),
    ("document.doc", False), ("document", False), ("pdf", False), ("", False), ("document.pdf.txt", False),
]
MATCHES = [
    ("machine_learning.pdf", "machine", True), ("Machine_Learning.pdf", "machine", True), ("RESEARCH_PAPER.pdf", "research", True),
    ("machine_learning_guide.pdf", "learning", True), ("artificial_intelligence.pdf", "intel", True), ("deep_learning_tutorial.pdf", "deep tutorial", True),
    ("machine_learning_basics.pdf", "machine basics", True), ("document.pdf", "nonexistent", False), ("research.pdf", "machine", False),
    ("anything.pdf", "", True), ("report-2023.pdf", "2023", True), ("summary (final).pdf", "final", True), ("data[backup].pdf", "backup", True), ("any.pdf", "-", True),
]
WORDS = [
    ("machine_learning", ["machine", "learning"]), ("deep-learning-guide", ["deep", "learning", "guide"]), ("AI.research.paper", ["ai", "research", "paper"]),
    ("document (final)", ["document", "final"]), ("data[backup]", ["data", "backup"]), ("simple", ["simple"]), ("", []),
]
FORMATS = [
    ("DCTDecode", "JPEG"), ("JPXDecode", "JPEG2000"), ("CCITTFaxDecode", "TIFF/Fax"), ("JBIG2Decode", "JBIG2"), ("FlateDecode", "PNG/Deflate"),
    ("LZWDecode", "LZW"), ("RunLengthDecode", "RLE"), ("UnknownFilter", "UnknownFilter"), ("", "unknown"),
]


def test_pdf_names(spark):
    got = spark.createDataFrame(NAMES, "n string, e boolean").select(is_pdf(F.col("n")).alias("g"), "e").collect()
    assert all(r.g == r.e for r in got)


def test_fuzzy_matches(spark):
    df = spark.createDataFrame(MATCHES, "n string, q string, e boolean")
    assert [(r.n, r.q) for r in df.withColumn("g", matches(F.col("n"), F.col("q"))).collect() if r.g != r.e] == []


def test_name_words(spark):
    df = spark.createDataFrame(WORDS, "n string, e array<string>")
    assert all(r.g == r.e for r in df.select(text.name_words(F.col("n")).alias("g"), "e").collect())


def test_image_formats(spark):
    df = spark.createDataFrame(FORMATS, "f string, e string")
    assert all(r.g == r.e for r in df.select(image_format(F.col("f")).alias("g"), "e").collect())


@pytest.mark.parametrize(("w", "h", "bits", "size"), [(100, 50, 8, 15000), (100, 50, 16, 30000), (100, 50, 1, 0)])
def test_image_size(spark, w, h, bits, size):
    assert spark.range(1).select(estimated_size(F.lit(w), F.lit(h), F.lit(bits)).alias("s")).first().s == size


@pytest.mark.parametrize(
    ("pattern", "name", "hit"),
    [("report_*.pdf", "report_2023.pdf", True), ("*_2023.pdf", "summary_2023.pdf", True), ("*.pdf", "a.PDF", False), ("?.pdf", "é.pdf", True), ("[a-c]x", "bx", True),
     ("[^a-c]x", "bx", False), ("[^a-c]x", "dx", True), (r"\*", "*", True), (r"\*", "a", False), ("*", "a/b", False), ("a[\\]]", "a]", True), ("a.b", "axb", False)],
)
def test_globs(spark, pattern, name, hit):
    assert spark.range(1).select(F.lit(name).rlike(text.glob_regex(pattern)).alias("g")).first().g == hit


@pytest.mark.parametrize("pattern", ["[", "[]", "[a", "[a-", "\\", "[-a]", "a["])
def test_malformed_globs(pattern):
    assert text.glob_regex(pattern) is None


def test_trim_and_cut(spark):
    r = spark.range(1).select(text.trim_unicode(F.lit("  a b \n")).alias("t"), text.cut_bytes(F.lit("aéb"), F.lit(3)).alias("c"), text.cut_bytes(F.lit("aéb"), F.lit(2)).alias("d"), text.shown(F.lit("x" * 120)).alias("s")).first()
    assert r.t == "a b" and r.c == "aé" and r.d == "a�" and r.s == "x" * 100 + "..."


def test_rectangles_and_corners(spark):
    box = spark.range(1).select(geometry.rectangle(F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(8.0)).alias("r"))
    assert tuple(box.first().r) == (1, 2, 3, 6) and tuple(box.select(geometry.corners(F.col("r")).alias("c")).first().c) == (1, 2, 4, 8)
