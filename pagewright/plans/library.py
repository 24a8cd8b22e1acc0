"""Queries over the generated library: listings, the parser, and the verbs of the engine on its files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import render
from ..api import TOOLS, Engine
from ..config import MODES, ExtractConfig, Query, Settings, TableRules
from ..functions.formats import SUPPORTED
from ..functions.text import shown, timestamp_text
from ..operators import documents, elements, query, reading, search, stats, tables, validate
from ..sources import files, pdf
from ..sources.adapters import table
from ..sources.library import library, listed, name_of, pages, parsed
from ..sources.shared import shared_path
from .registry import LINES_SQL, ROWS_SQL, _lines, _register

# --- shared SQL ---

NAME = "CASE c % 5 WHEN 0 THEN 'Report ' || c || '.pdf' WHEN 1 THEN 'summary_' || c || '.PDF' WHEN 2 THEN 'data-set_' || c || '.pdf' WHEN 3 THEN 'notes_' || c || '.txt' ELSE 'draft_' || c || '.pdf' END"
BOOKS_SQL = f"""
b0 AS (SELECT conv_id AS c, turn::INTEGER AS t, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS page_number, rtrim(coalesce(text, ''), chr(10)) AS text FROM conversations),
fs AS (SELECT c, 'f' || (c % 4) || '/' || {NAME} AS path, {NAME} AS name, count(*)::INTEGER AS pages FROM b0 GROUP BY c),
b AS (SELECT b0.*, fs.path FROM b0 JOIN fs USING (c) WHERE c % 5 < 3),
im AS (SELECT *, unnest(range(t % 3))::INTEGER AS k FROM b),
an AS (SELECT *, 0 AS k, 'Text' AS kind, 'Note ' || c || ' of ' || t AS note FROM b WHERE t % 2 = 0 UNION ALL SELECT *, 1, 'Link', '' FROM b WHERE t % 4 = 0),
li AS (SELECT c, path, page_number, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_idx FROM b),
ln AS (SELECT * FROM li WHERE regexp_matches(text, '\\S')),
wn AS (SELECT c, path, page_number, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS text FROM ln),
pg AS (SELECT * FROM b WHERE regexp_matches(text, '\\S'))"""
ONE = "c = (SELECT min(conv_id) FROM conversations WHERE conv_id % 5 = 0)"
BREAK = "chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10)"
FORMAT = "CASE t % 4 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'JPEG2000' WHEN 2 THEN 'DeviceRGB' ELSE 'TIFF/Fax' END"
READABLE = "(c % 5 < 3 OR c % 10 = 9)"


def _with(select: str) -> str:
    return f"WITH {BOOKS_SQL} {select}"


def _short(df: DataFrame, root: str) -> DataFrame:
    """Paths without the library's folder."""
    return df.withColumn("path", F.substring("path", len(root) + 2, 1 << 20))


def _engine(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    """An engine whose directory is the library, and the first report's path."""
    root = library(spark, sf_dir)
    first = table(spark, sf_dir, "conversations").filter("conv_id % 5 = 0").agg(F.min("conv_id")).first()[0]
    return Engine(spark, Settings(dir=root)), f"{root}/f{first % 4}/{name_of(first)}"


# --- listings ---


@_register("library_listing", _with("SELECT path, name, c % 10 = 4 AS empty, false AS is_dir FROM fs"))
def library_listing(spark, sf_dir):
    return _short(listed(spark, sf_dir), library(spark, sf_dir)).select("path", "name", (F.col("size") == 0).alias("empty"), "is_dir")


@_register("tool_search_directory", _with("SELECT 'REPORT' AS query, name FROM fs WHERE c % 5 = 0 UNION ALL SELECT 'set data', name FROM fs WHERE c % 5 = 2 UNION ALL SELECT 'draft', name FROM fs WHERE c % 10 = 9 UNION ALL SELECT 'notes', name FROM fs WHERE false"))
def tool_search_directory(spark, sf_dir):
    e, _ = _engine(spark, sf_dir)
    return elements.union_elements([e.search_directory("", q).select(F.lit(q).alias("query"), "name") for q in ("REPORT", "set data", "draft", "notes")])


@_register("tool_find_files", _with(f"SELECT name FROM fs WHERE {READABLE}"))
def tool_find_files(spark, sf_dir):
    return _engine(spark, sf_dir)[0].find_files().select("name")


@_register("tool_search_pattern", _with(f"SELECT '*.PDF' AS pattern, name FROM fs WHERE c % 5 = 1 UNION ALL SELECT '[Rd]*.pdf', name FROM fs WHERE {READABLE} AND c % 5 <> 1"))
def tool_search_pattern(spark, sf_dir):
    e, _ = _engine(spark, sf_dir)
    return elements.union_elements([e.search_pattern("", p).select(F.lit(p).alias("pattern"), "name") for p in ("*.PDF", "[Rd]*.pdf", "[")])


@_register("tool_stats_directory", _with(f"""
SELECT count(*) AS total_files, true AS average_fits, true AS extremes_fit, 14::BIGINT AS smallest_size, first(name ORDER BY c % 10 <> 9, string_split(path, '/')) AS smallest_name FROM fs WHERE {READABLE}"""))
def tool_stats_directory(spark, sf_dir):
    s = _engine(spark, sf_dir)[0].stats_directory()
    return s.select("total_files", (F.col("average_size") == F.floor(F.col("total_size") / F.col("total_files"))).alias("average_fits"), (F.col("largest_size") > F.col("smallest_size")).alias("extremes_fit"), "smallest_size", "smallest_name")


@_register("tool_server_info", _with(f"""
SELECT 'tool' AS section, unnest({sorted(TOOLS)}) AS key UNION ALL SELECT 'image_format', unnest({list(SUPPORTED)}) UNION ALL SELECT 'limit', unnest(['max_file_size', 'dir'])
UNION ALL SELECT 'file', name FROM (SELECT name FROM fs WHERE {READABLE} ORDER BY string_split(path, '/') LIMIT 10)"""))
def tool_server_info(spark, sf_dir):
    return _engine(spark, sf_dir)[0].server_info().select("section", "key")


# --- validation and files ---


@_register("library_validate", _with("""
SELECT path, c % 5 < 3 AS valid, CASE WHEN c % 5 = 3 THEN 'file is not a PDF' WHEN c % 10 = 4 THEN 'file is empty' WHEN c % 10 = 9 THEN 'invalid PDF file' ELSE '' END AS reason FROM fs"""))
def library_validate(spark, sf_dir):
    every = listed(spark, sf_dir)
    opened = pdf.parse(files.content_of(files.dealt(search.list_files(every))), ())
    checked = validate.validate(every, opened, search.DEFAULT_LIMIT)
    return _short(checked, library(spark, sf_dir)).select("path", "valid", F.element_at(F.split("message", ":"), 1).alias("reason"))


@_register("tool_validate_file", _with(f"SELECT path, true AS valid, '' AS message FROM fs WHERE {ONE}"))
def tool_validate_file(spark, sf_dir):
    e, path = _engine(spark, sf_dir)
    return _short(e.validate_file(path), e.settings.dir)


_FILE_STATS = "pages, 'conversation ' || c AS title, CASE WHEN c % 2 = 1 THEN 'someone' END AS author, pages || ' pages' AS subject, 'pagewright' AS producer, 'D:20240102030405Z' AS created_date"
_STATS_COLUMNS = ("pages", "title", "author", "subject", "producer", "created_date")


@_register("library_file_stats", _with(f"SELECT path, true AS size_fits, true AS dated, {_FILE_STATS} FROM fs WHERE c % 5 < 3"))
def library_file_stats(spark, sf_dir):
    chosen = search.list_files(listed(spark, sf_dir))
    contents = files.content_of(files.dealt(chosen))
    real = contents.select(F.col("path").alias("r_path"), F.octet_length("content").cast("long").alias("r_size"))
    s = stats.file_stats(chosen, pdf.parse(contents, ("info",))).join(real, F.col("path") == F.col("r_path"))
    return _short(s, library(spark, sf_dir)).select("path", (F.col("size") == F.col("r_size")).alias("size_fits"), F.col("modified_date").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$").alias("dated"), *_STATS_COLUMNS)


@_register("tool_stats_file", _with(f"SELECT path, {_FILE_STATS} FROM fs WHERE {ONE}"))
def tool_stats_file(spark, sf_dir):
    e, path = _engine(spark, sf_dir)
    return _short(e.stats_file(path), e.settings.dir).select("path", *_STATS_COLUMNS)


# --- texts ---

_READ = f"""
SELECT path, content, pages, CASE WHEN bytes >= 50 AND images > 0 THEN 'mixed' WHEN bytes >= 50 THEN 'text' WHEN images > 0 THEN 'scanned_images' ELSE 'no_content' END AS content_type, images > 0 AS has_images, images::BIGINT AS image_count
FROM (SELECT *, strlen(regexp_replace(replace(content, '--- Page Break ---', ''), '^\\s+|\\s+$', '', 'g')) AS bytes
      FROM (SELECT c, path, string_agg(text, {BREAK} ORDER BY page_number) AS content, count(*) AS pages, sum(t % 3) AS images FROM b GROUP BY c, path))"""
_READ_COLUMNS = ("path", "content", "pages", "content_type", "has_images", "image_count")


@_register("library_pages", _with("SELECT path, page_number, pages AS n_pages, b.text FROM b JOIN fs USING (path)"))
def library_pages(spark, sf_dir):
    pages = parsed(spark, sf_dir, ("text",)).where("page_number is not null")
    return _short(pages, library(spark, sf_dir)).select("path", "page_number", "n_pages", F.regexp_replace("text", r"\n+$", "").alias("text"))


@_register("library_read", _with(_READ))
def library_read(spark, sf_dir):
    read = reading.read_documents(parsed(spark, sf_dir, ("text", "images")))
    return _short(read.where("error is null"), library(spark, sf_dir)).select(*_READ_COLUMNS)


@_register("tool_read_file", _with(f"{_READ} WHERE {ONE}"))
def tool_read_file(spark, sf_dir):
    e, path = _engine(spark, sf_dir)
    return _short(e.read_file(path), e.settings.dir).select(*_READ_COLUMNS)


@_register("text_preview", r"""SELECT doc_id, CASE WHEN strlen(t) > 100 THEN left(t, 100) || '...' ELSE t END AS preview FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x01-\x7f]', '', 'g') AS t FROM documents)""")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", shown(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x01-\x7f]", "")).alias("preview"))


# --- images, notes, boxes, information ---

_ASSETS = f"SELECT path, page_number, t + 1 AS width, 2 AS height, {FORMAT} AS format, CASE WHEN t % 2 = 0 THEN (t + 1) * 6 ELSE 0 END::BIGINT AS size FROM im WHERE k = 0"
_ASSET_COLUMNS = ("path", "page_number", "width", "height", "format", "size")


@_register("library_images", _with(_ASSETS))
def library_images(spark, sf_dir):
    return _short(documents.images(parsed(spark, sf_dir, ("images",))), library(spark, sf_dir)).select(*_ASSET_COLUMNS)


@_register("tool_assets_file", _with(f"{_ASSETS} AND {ONE}"))
def tool_assets_file(spark, sf_dir):
    e, path = _engine(spark, sf_dir)
    return _short(e.assets_file(path), e.settings.dir).select(*_ASSET_COLUMNS)


@_register("image_counts", _with("SELECT path, sum(t % 3)::BIGINT AS image_count FROM b GROUP BY path"))
def image_counts(spark, sf_dir):
    opened = parsed(spark, sf_dir, ("images",)).where("page_number is not null")
    return _short(reading.image_counts(opened), library(spark, sf_dir))


@_register("image_elements", _with(f"""
SELECT path, 'image_' || page_number || '_' || k AS element_id, 0.0::DOUBLE AS llx, CASE WHEN k = 0 THEN t + 1 ELSE 0 END::DOUBLE AS urx, 2.0::DOUBLE AS ury, 1.0::DOUBLE AS confidence,
       CASE WHEN k = 0 THEN {FORMAT} ELSE 'DeviceRGB' END AS format, 'DeviceRGB' AS color_space, 8::INTEGER AS bits_per_component, sha256(repeat('x', t + 1)) AS hash, (t + 1)::BIGINT AS size FROM im"""))
def image_elements(spark, sf_dir):
    found = elements.image_elements(parsed(spark, sf_dir, ("images",)))
    detail = F.from_json("detail", "format string, color_space string, bits_per_component int, hash string, size long")
    return _short(found, library(spark, sf_dir)).select("path", "element_id", "llx", "urx", "ury", "confidence", detail.alias("d")).select("path", "element_id", "llx", "urx", "ury", "confidence", "d.*")


@_register("annotation_elements", _with("""
SELECT path, 'annotation_' || page_number || '_' || k AS element_id, kind AS detail, note AS text, CASE WHEN k = 0 THEN 10 ELSE 0 END::DOUBLE AS llx, CASE WHEN k = 0 THEN 45 ELSE 0 END::DOUBLE AS ury, CASE WHEN k = 0 THEN 25 ELSE 0 END::DOUBLE AS height FROM an"""))
def annotation_elements(spark, sf_dir):
    found = elements.annotation_elements(parsed(spark, sf_dir, ("annotations",)))
    return _short(found, library(spark, sf_dir)).select("path", "element_id", "detail", "text", "llx", "ury", "height")


_PAGE_SIZE = "CASE WHEN c % 2 = 0 THEN 600 + t ELSE 612 END::DOUBLE AS width, CASE WHEN c % 2 = 0 THEN 800 ELSE 792 END::DOUBLE AS height"


@_register("library_page_info", _with(f"SELECT path, page_number AS number, {_PAGE_SIZE}, 90 * (t % 4) AS rotation FROM b"))
def library_page_info(spark, sf_dir):
    return _short(documents.page_info(parsed(spark, sf_dir, ())), library(spark, sf_dir)).select("path", "number", "width", "height", "rotation")


@_register("page_info_strict", _with(f"""
SELECT path, page_number AS number, {_PAGE_SIZE}, NULL AS error FROM b WHERE c % 2 = 0
UNION ALL SELECT path, 1, NULL, NULL, 'failed to get info for page 1: invalid MediaBox' FROM b WHERE c % 2 = 1 AND page_number = 1"""))
def page_info_strict(spark, sf_dir):
    return _short(documents.page_info(parsed(spark, sf_dir, ()), inherit=False), library(spark, sf_dir)).select("path", "number", "width", "height", "error")


@_register("tool_get_page_info", _with(f"SELECT path, page_number AS number, {_PAGE_SIZE} FROM b WHERE {ONE}"))
def tool_get_page_info(spark, sf_dir):
    e, path = _engine(spark, sf_dir)
    return _short(e.page_info(path), e.settings.dir).select("path", "number", "width", "height")


_META = "'conversation ' || c AS title, CASE WHEN c % 2 = 1 THEN 'someone' END AS author, 'a|b|c' AS keywords, pages, CASE WHEN c % 2 = 1 THEN '1.5' ELSE '1.4' END AS version, false AS encrypted, (c % 4)::VARCHAR AS shelf"


def _meta(df: DataFrame) -> DataFrame:
    return df.select("path", "title", "author", F.array_join("keywords", "|").alias("keywords"), "pages", "version", "encrypted", F.col("custom_properties")["Shelf"].alias("shelf"))


@_register("library_metadata", _with(f"SELECT path, {_META} FROM fs WHERE c % 5 < 3"))
def library_metadata(spark, sf_dir):
    good = parsed(spark, sf_dir, ("info",)).where("page_number is not null")
    return _meta(_short(documents.metadata(good), library(spark, sf_dir)))


@_register("tool_get_metadata", _with(f"SELECT path, {_META} FROM fs WHERE {ONE}"))
def tool_get_metadata(spark, sf_dir):
    e, path = _engine(spark, sf_dir)
    return _meta(_short(e.metadata(path), e.settings.dir))


# --- extraction ---

_COUNT = {
    "line": "SELECT 'text' AS type, 0 AS level, count(*) AS n FROM ln {0}", "word": "SELECT 'text', 1, count(*) FROM wn {0}", "page": "SELECT 'text' AS type, 0 AS level, count(*) AS n FROM pg {0}",
    "image": "SELECT 'image' AS type, 0 AS level, count(*) AS n FROM im {0}", "annotation": "SELECT 'annotation' AS type, 0 AS level, count(*) AS n FROM an {0}",
}
_BY_LINE, _BY_PAGE = ("line", "word", "image", "annotation"), ("page", "image", "annotation")


def _counts(kinds, where: str = "") -> str:
    return "SELECT type, level::INTEGER AS level, n FROM (" + " UNION ALL ".join(_COUNT[k].format(where) for k in kinds) + ") WHERE n > 0"


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("type", "level").agg(F.count(F.lit(1)).alias("n"))


@_register("extract_modes", _with(" UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM ({_counts(_BY_LINE if m in ('structured', 'complete', 'table') else _BY_PAGE)})" for m in MODES)))
def extract_modes(spark, sf_dir):
    every = pages(spark, sf_dir)
    return elements.union_elements([_counted(elements.extract(every, ExtractConfig(mode=m))).select(F.lit(m).alias("mode"), "type", "level", "n") for m in MODES])


_SWITCHES = {
    "text": ({"images": False, "annotations": False}, ("line", "word")), "lines only": ({"images": False, "annotations": False, "coordinates": False}, ("line",)), "images": ({"text": False, "annotations": False}, ("image",)),
    "annotations": ({"text": False, "images": False}, ("annotation",)), "strict table": ({"mode": "table", "strict": True}, _BY_PAGE),
}


@_register("extract_switches", _with(" UNION ALL ".join(f"SELECT '{name}' AS switch, * FROM ({_counts(kinds)})" for name, (_, kinds) in _SWITCHES.items())))
def extract_switches(spark, sf_dir):
    every = pages(spark, sf_dir)
    parts = [_counted(elements.extract(every, ExtractConfig(**given))).select(F.lit(name).alias("switch"), "type", "level", "n") for name, (given, _) in _SWITCHES.items()]
    return elements.union_elements(parts)


@_register("vectors_and_forms", "SELECT 0::BIGINT AS n, 0::BIGINT AS vectors, 0::BIGINT AS forms")
def vectors_and_forms(spark, sf_dir):
    config = ExtractConfig(text=False, images=False, annotations=False, vectors=True, forms=True)
    found = elements.extract(pages(spark, sf_dir), config)
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "vector").alias("vectors"), F.count_if(F.col("type") == "form").alias("forms"))


@_register("type_filter", _with("SELECT 'image' AS type, path, count(*) AS n FROM im GROUP BY path UNION ALL SELECT 'annotation', path, count(*) FROM an GROUP BY path"))
def type_filter(spark, sf_dir):
    found = elements.extract(pages(spark, sf_dir))
    both = elements.union_elements([query.of_type(found, k) for k in ("image", "annotation", "form")])
    return _short(both, library(spark, sf_dir)).groupBy("type", "path").agg(F.count(F.lit(1)).alias("n"))


def _verb(name: str, kinds, call) -> None:
    @_register(name, _with(_counts(kinds, f"WHERE {ONE}")))
    def run(spark, sf_dir):
        e, path = _engine(spark, sf_dir)
        return _counted(call(e, path))


_verb("tool_extract_structured", _BY_LINE, lambda e, p: e.extract_structured(p))
_verb("tool_extract_semantic", _BY_PAGE, lambda e, p: e.extract_semantic(p))
_verb("tool_extract_complete", _BY_LINE, lambda e, p: e.extract_complete(p))


@_register("semantic_groups", _with("SELECT path, count(*) AS n FROM (SELECT path FROM pg UNION ALL SELECT path FROM im UNION ALL SELECT path FROM an) GROUP BY path"))
def semantic_groups(spark, sf_dir):
    found = elements.extract(pages(spark, sf_dir), ExtractConfig(mode="semantic"))
    return _short(tables.semantic_groups(found), library(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@_register("mixed_counts_by_type", _with("""
SELECT path, sum(x)::BIGINT AS text_elements, sum(y)::BIGINT AS image_elements, 0::BIGINT AS vector_elements, 0::BIGINT AS form_elements, sum(z)::BIGINT AS annotation_elements, count(*) AS total_elements
FROM (SELECT path, 1 AS x, 0 AS y, 0 AS z FROM ln UNION ALL SELECT path, 0, 1, 0 FROM im UNION ALL SELECT path, 0, 0, 1 FROM an) GROUP BY path"""))
def mixed_counts_by_type(spark, sf_dir):
    found = elements.extract(pages(spark, sf_dir), ExtractConfig(mode="complete"))
    return _short(query.counts_by_type(found), library(spark, sf_dir))


_NOTED = "SELECT path, type, text FROM (SELECT c, path, 'text' AS type, text FROM ln UNION ALL SELECT c, path, 'annotation', note FROM an) WHERE contains(lower(text), 'note')"


@_register("query_mixed_text", _with(_NOTED))
def query_mixed_text(spark, sf_dir):
    """Texts and notes can contain a text, images never do."""
    found = elements.extract(pages(spark, sf_dir), ExtractConfig(mode="complete"))
    return _short(query.query(found, Query(text="NOTE")), library(spark, sf_dir)).select("path", "type", "text")


@_register("query_mixed_all", _with("""
SELECT path, element_id FROM (
  SELECT path, page_number, 'image_' || page_number || '_' || k AS element_id, 0 AS llx, 0 AS lly, CASE WHEN k = 0 THEN t + 1 ELSE 0 END AS urx, 2 AS ury FROM im
  UNION ALL SELECT path, page_number, 'annotation_' || page_number || '_' || k, CASE WHEN k = 0 THEN 10 ELSE 0 END, CASE WHEN k = 0 THEN 20 ELSE 0 END, CASE WHEN k = 0 THEN 30 ELSE 0 END, CASE WHEN k = 0 THEN 45 ELSE 0 END FROM an)
WHERE page_number IN (1, 3, 5) AND NOT (urx < 2 OR llx > 12 OR ury < 1 OR lly > 25)"""))
def query_mixed_all(spark, sf_dir):
    from ..config import Box

    found = elements.extract(pages(spark, sf_dir), ExtractConfig(mode="complete"))
    q = Query(types=("image", "annotation"), pages=(1, 3, 5), box=Box(2.0, 1.0, 12.0, 25.0), min_confidence=0.9)
    return _short(query.query(found, q), library(spark, sf_dir)).select("path", "element_id")


@_register("tool_query_content", _with(f"SELECT path, type, text FROM ({_NOTED.replace('SELECT path, type, text', 'SELECT c, path, type, text', 1)}) WHERE {ONE}"))
def tool_query_content(spark, sf_dir):
    e, path = _engine(spark, sf_dir)
    return _short(e.query_content(path, '{"text": "note"}'), e.settings.dir).select("path", "type", "text")


# --- tables ---

LOW = TableRules(threshold=0.4)
_FOUND = "fd AS (SELECT * FROM st WHERE n_elements >= 4 AND n_rows >= 2 AND confidence >= 0.5 AND confidence > 0.4)"
_TABLES = f"WITH {ROWS_SQL}, {_FOUND}, n AS (SELECT DISTINCT conv_id AS c FROM conversations) SELECT 'f' || (c % 4) || '/' || {NAME} AS path, n_columns, kept_rows AS n_rows, n_columns * kept_rows AS cell_count, round(confidence, 9) AS confidence FROM fd JOIN n ON fd.path = CAST(c AS VARCHAR) WHERE c % 5 < 3"


@_register("library_tables", _TABLES)
def library_tables(spark, sf_dir):
    found = tables.tables(elements.extract(pages(spark, sf_dir), ExtractConfig(mode="table")), LOW)
    return _short(found, library(spark, sf_dir)).select("path", "n_columns", "n_rows", "cell_count", F.round("confidence", 9).alias("confidence"))


@_register("tool_extract_tables", f"SELECT n_columns, n_rows, cell_count, confidence FROM ({_TABLES} AND {ONE})")
def tool_extract_tables(spark, sf_dir):
    e, path = _engine(spark, sf_dir)
    return e.extract_tables(path, ExtractConfig(mode="table", tables=LOW)).select("n_columns", "n_rows", "cell_count", F.round("confidence", 9).alias("confidence"))


# heights that lie closer than the tolerance, so that where a row begins decides what belongs to it
_SLOPE = "lly - 8.5 * line_idx - 1.25 * (page_number % 3)"


@_register("anchored_rows", f"""
WITH RECURSIVE {LINES_SQL},
y AS (SELECT DISTINCT path, {_SLOPE.replace('lly', '9 * (lly - 720) / 12')} AS y FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY y DESC) AS k FROM y),
f AS (SELECT path, k, y, y AS anchor, 0 AS row_index FROM o WHERE k = 1
      UNION ALL SELECT o.path, o.k, o.y, CASE WHEN f.anchor - o.y > 5 THEN o.y ELSE f.anchor END, f.row_index + CASE WHEN f.anchor - o.y > 5 THEN 1 ELSE 0 END FROM f JOIN o ON o.path = f.path AND o.k = f.k + 1),
e AS (SELECT *, {_SLOPE.replace('lly', '9 * (lly - 720) / 12')} AS y FROM l)
SELECT e.path, e.element_id, f.row_index::INTEGER AS row_index, (row_number() OVER (PARTITION BY e.path, f.row_index ORDER BY e.y DESC, e.page_number, e.line_idx, e.element_id) - 1)::INTEGER AS col_index FROM e JOIN f ON f.path = e.path AND f.y = e.y""")
def anchored_rows(spark, sf_dir):
    """Lines at heights that are no grid: 17.5 points a line, less up to 2.5 by page."""
    y = 9 * (F.col("lly") - 720) / 12 - 8.5 * F.col("line_idx") - 1.25 * (F.col("page_number") % 3)
    rows = tables.anchored_rows(_lines(spark, sf_dir).withColumn("lly", y))
    return rows.select("path", "element_id", F.col("row_index").cast("int").alias("row_index"), F.col("col_index").cast("int").alias("col_index"))


# --- results as text ---


def _as_rows(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


@_register("text_search", _with(f"""
, o AS (SELECT name, row_number() OVER (ORDER BY string_split(path, '/')) AS k, count(*) OVER () AS n FROM fs WHERE {READABLE})
SELECT 0::INTEGER AS line, 'PDF files: ' || max(n) AS text FROM o UNION ALL SELECT k::INTEGER, k || '. ' || name FROM o WHERE k <= 10 UNION ALL SELECT 11, '... and ' || (max(n) - 10) || ' more' FROM o HAVING max(n) > 10""").replace("\n, o AS", ", o AS", 1))
def text_search(spark, sf_dir):
    return _as_rows(spark, render.search(_engine(spark, sf_dir)[0].find_files().select("name")))


@_register("text_query", _with(f"""
, q AS (SELECT path, type, text, page_number, line_idx FROM (SELECT c, path, 'text' AS type, text, page_number, line_idx FROM ln) WHERE {ONE} AND contains(lower(text), 'e')),
o AS (SELECT *, row_number() OVER (ORDER BY page_number, line_idx) AS k, count(*) OVER () AS n, list_max(list_filter(range(0, 101), lambda m: strlen(left(text, m)) <= 100)) AS m FROM q)
SELECT 0::INTEGER AS line, 'Matches: ' || (SELECT count(*) FROM q) AS text UNION ALL SELECT k::INTEGER, k || '. page ' || page_number || ', text: ' || CASE WHEN strlen(text) > 100 THEN left(text, m) || CASE WHEN strlen(left(text, m)) < 100 THEN chr(65533) ELSE '' END || '...' ELSE text END FROM o WHERE k <= 10
UNION ALL SELECT 11, '... and ' || (max(n) - 10) || ' more' FROM o HAVING max(n) > 10""").replace("\n, q AS", ", q AS", 1))
def text_query(spark, sf_dir):
    e, path = _engine(spark, sf_dir)
    return _as_rows(spark, render.matches(e.query_content(path, Query(types=("text",), text="E"))))


@_register("text_directory", _with(f"SELECT 0::INTEGER AS line, 'Directory' AS text UNION ALL SELECT 1, 'Total files: ' || count(*) FROM fs WHERE {READABLE}"))
def text_directory(spark, sf_dir):
    return _as_rows(spark, render.directory(_engine(spark, sf_dir)[0].stats_directory())).where("line < 2")


# --- streams ---


@_register("stream_ingest", _with(f"SELECT path, page_number, 1::BIGINT AS n FROM b UNION ALL SELECT path, NULL, 1 FROM fs WHERE c % 10 = 9"))
def stream_ingest(spark, sf_dir):
    """New files into Parquet, twice over the same folder: the second run finds nothing new."""
    from ..streaming.ingest import ingest

    root, target, checkpoint = library(spark, sf_dir), shared_path(spark, "ingested"), shared_path(spark, "ingest-state")
    for _ in range(2):
        ingest(spark, root, target, checkpoint).awaitTermination()
    local = "^file:/*(?=/)"  # the file stream writes local paths in another way than the listing
    rows = spark.read.parquet(target).withColumn("path", F.regexp_replace(F.url_decode("path"), local, ""))
    return _short(rows, re.sub(local, "", root)).groupBy("path", "page_number").agg(F.count(F.lit(1)).alias("n"))


@_register("stream_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """The windowed counts of a stream, watermark and all, as its last batch leaves them."""
    from ..streaming.ingest import windowed_counts

    target = shared_path(spark, "windows")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = windowed_counts(events)
    stream = counts.writeStream.outputMode("complete").option("checkpointLocation", shared_path(spark, "windows-state")).trigger(availableNow=True)
    stream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target)).start().awaitTermination()
    return spark.read.parquet(target).withColumn("window_start", timestamp_text(F.col("window_start")))
