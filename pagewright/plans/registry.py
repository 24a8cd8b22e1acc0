"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Box, Query, TableRules
from ..functions.formats import FORMATS, estimated_size, image_format
from ..functions.geometry import rectangle
from ..functions.text import name_words, timestamp_text
from ..operators import elements, query, reading, search, stats, tables, validate
from ..sources.adapters import conversation_pages, document_files, part_files, table
from ..sources.shared import shared_path

SIZE_LIMIT = 20_000
TEXT = "the"
BOX = Box(100.0, 500.0, 200.0, 650.0)
BOXES = ((1, 72.0, 700.0, 100.0, 732.0), (2, 0.0, 0.0, 50.0, 50.0), (3, 300.0, 600.0, 540.0, 690.0))
NAMES = ("red", "blue widget", "nonexistent", "-")
GLOBS = ("r*.pdf", "*widget.pdf", "[a-m]*", "?[!x")
PAGES = (3, 1, 1, 9, 0)
TURNS = 4000  # generated files that a task writes

Q = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Q] = {}
_sql: dict[str, str] = {}


def _register(name: str, sql: str | None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Q]:
    from . import library, relations  # noqa: F401  register their own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import library, relations  # noqa: F401

    return dict(_sql)


# --- shared SQL ---

FILES_SQL = "SELECT doc_id, source AS directory, source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.pdf' AS path, lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.pdf' AS name, strlen(coalesce(text, ''))::BIGINT AS size FROM documents"
LINES_SQL = r"""
p AS (SELECT CAST(conv_id AS VARCHAR) AS path, (turn + 1)::INTEGER AS page_number, string_split(text, chr(10)) AS ls FROM conversations),
s AS (SELECT path, page_number, unnest(ls) AS text, unnest(range(len(ls))) AS line_idx FROM p),
l AS (SELECT path, page_number, line_idx::INTEGER AS line_idx, text, 'text' AS type, 'line_' || page_number || '_' || line_idx AS element_id,
             72.0::DOUBLE AS llx, 720 - 12.0::DOUBLE * line_idx AS lly, 540.0::DOUBLE AS urx, 732 - 12.0::DOUBLE * line_idx AS ury, 0.8::DOUBLE AS confidence
      FROM s WHERE regexp_matches(text, '\S'))"""
WORDS_SQL = r"""
w0 AS (SELECT path, page_number, line_idx, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM l),
w AS (SELECT path, page_number, line_idx, len(ws) AS n, unnest(ws) AS text, unnest(range(len(ws)))::INTEGER AS word_idx FROM w0)"""
NAME_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[ _\-.()\[\]]'), lambda x: x <> '')"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.line_elements(conversation_pages(spark, sf_dir))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.word_elements(conversation_pages(spark, sf_dir))


_SHOWN = ["path", "page_number", "element_id", "text"]


# --- flagship ---

FLAGSHIP_SQL = f"WITH {LINES_SQL}, f AS (SELECT * FROM l WHERE contains(lower(text), '{TEXT}')) " + """
SELECT 'type' AS kind, type AS key, count(*) AS n, round(avg(confidence), 9) AS avg_confidence FROM f GROUP BY type
UNION ALL SELECT 'page', CAST(page_number AS VARCHAR), count(*), round(avg(confidence), 9) FROM f GROUP BY page_number
UNION ALL SELECT 'all', '', count(*), coalesce(round(avg(confidence), 9), 0) FROM f"""


@_register("query_summary", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query.query(_lines(spark, sf_dir), Query(text=TEXT))
    return query.summary(found).withColumn("avg_confidence", F.round("avg_confidence", 9))


# --- files ---


@_register("scan_pdf_filter", f"SELECT path, size FROM ({FILES_SQL}) WHERE size BETWEEN 1 AND {SIZE_LIMIT}")
def scan_pdf_filter(spark, sf_dir):
    return search.list_files(document_files(spark, sf_dir), SIZE_LIMIT).select("path", "size")


@_register("validate_message", f"""
SELECT path, m IS NULL AS valid, coalesce(m, '') AS message FROM (
  SELECT path, CASE WHEN size = 0 THEN 'file is empty: ' || path WHEN size > {SIZE_LIMIT} THEN 'file too large: ' || size || ' bytes (max: {SIZE_LIMIT} bytes)' END AS m FROM ({FILES_SQL}))""")
def validate_message(spark, sf_dir):
    return validate.validate(document_files(spark, sf_dir), None, SIZE_LIMIT)


@_register("gates", f"""
SELECT path, size > {SIZE_LIMIT} AS reader_rejects, size = 0 OR size > {SIZE_LIMIT} AS listing_rejects, size > {SIZE_LIMIT} AS extraction_rejects FROM ({FILES_SQL})""")
def gates(spark, sf_dir):
    rejects = lambda c, n: c.isNotNull().alias(n)
    return document_files(spark, sf_dir).select("path", rejects(validate.reader_message(SIZE_LIMIT), "reader_rejects"), rejects(validate.listing_message(SIZE_LIMIT), "listing_rejects"), rejects(validate.extraction_message(SIZE_LIMIT), "extraction_rejects"))


_FUZZY = " UNION ALL ".join(
    f"SELECT '{q}' AS query, p_partkey, name FROM (SELECT p_partkey, p_name || '.pdf' AS name FROM part) WHERE contains(lower(name), '{q}') OR "
    f"len(list_filter({NAME_WORDS.format(repr(q))}, lambda q: len(list_filter({NAME_WORDS.format("regexp_replace(lower(name), '[.]pdf$', '')")}, lambda x: contains(x, q))) = 0)) = 0"
    for q in NAMES
)


@_register("fuzzy_search", _FUZZY)
def fuzzy_search(spark, sf_dir):
    files = part_files(spark, sf_dir)
    parts = [files.where(search.matches(F.col("name"), q)).select(F.lit(q).alias("query"), "p_partkey", "name") for q in NAMES]
    return elements.union_elements(parts)


@_register("glob_search", """
SELECT 'r*.pdf' AS pattern, p_partkey FROM part WHERE p_size > 0 AND p_name || '.pdf' GLOB 'r*.pdf'
UNION ALL SELECT '*widget.pdf', p_partkey FROM part WHERE p_size > 0 AND p_name || '.pdf' GLOB '*widget.pdf'
UNION ALL SELECT '[a-m]*', p_partkey FROM part WHERE p_size > 0 AND p_name || '.pdf' GLOB '[a-m]*'""")
def glob_search(spark, sf_dir):
    files = part_files(spark, sf_dir)
    parts = [search.search_pattern(files, g).select(F.lit(g).alias("pattern"), "p_partkey") for g in GLOBS]
    return elements.union_elements(parts)


@_register("tokenize_names", f"SELECT p_partkey, unnest(ws) AS word, unnest(range(len(ws)))::INTEGER AS idx FROM (SELECT p_partkey, {NAME_WORDS.format('p_name')} AS ws FROM part)")
def tokenize_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(name_words(F.col("p_name"))).alias("idx", "word"))


_STATS = """count(*) AS total_files, coalesce(sum(size), 0)::BIGINT AS total_size, coalesce(max(size), 0) AS largest_size, first(name ORDER BY size DESC, path) AS largest_name,
coalesce(min(size), 0) AS smallest_size, first(name ORDER BY size, path) AS smallest_name, coalesce(sum(size) // count(*), 0)::BIGINT AS average_size"""


@_register("directory_stats", f"SELECT directory, {_STATS} FROM ({FILES_SQL}) WHERE size BETWEEN 1 AND {SIZE_LIMIT} GROUP BY directory")
def directory_stats(spark, sf_dir):
    return stats.directory_stats(search.list_files(document_files(spark, sf_dir), SIZE_LIMIT), ["directory"])


@_register("directory_stats_total", f"SELECT {_STATS} FROM ({FILES_SQL}) WHERE size BETWEEN 1 AND {SIZE_LIMIT}")
def directory_stats_total(spark, sf_dir):
    return stats.directory_stats(search.list_files(document_files(spark, sf_dir), SIZE_LIMIT))


@_register("count_files", f"SELECT count(*) AS n_files FROM ({FILES_SQL}) WHERE size BETWEEN 1 AND {SIZE_LIMIT}")
def count_files(spark, sf_dir):
    return search.count_files(document_files(spark, sf_dir), SIZE_LIMIT)


@_register("walk_order", f"SELECT path, row_number() OVER (ORDER BY string_split(path, '/'))::INTEGER AS place FROM ({FILES_SQL}) ORDER BY place LIMIT 10")
def walk_order(spark, sf_dir):
    from pyspark.sql import Window as W

    first = search.in_walk_order(document_files(spark, sf_dir)).select("path").limit(10)
    return first.select("path", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(search.walk_key(F.col("path")))).alias("place"))


# --- texts ---


@_register("page_counts", "SELECT CAST(conv_id AS VARCHAR) AS path, count(*) AS pages FROM conversations GROUP BY conv_id")
def page_counts(spark, sf_dir):
    return stats.page_counts(conversation_pages(spark, sf_dir))


@_register("read_text_concat", "SELECT CAST(conv_id AS VARCHAR) AS path, count(*) AS pages, string_agg(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def read_text_concat(spark, sf_dir):
    return reading.document_texts(conversation_pages(spark, sf_dir))


@_register("text_cap", """
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS path, (turn + 1)::INTEGER AS page_number, strlen(text) AS b, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM conversations)
SELECT path, page_number, least(b, 600 - (upto - b))::BIGINT AS text_bytes, upto > 600 AS truncated FROM c WHERE upto - b <= 600""")
def text_cap(spark, sf_dir):
    return reading.capped_pages(conversation_pages(spark, sf_dir), 600).select("path", "page_number", F.col("text_bytes").cast("long").alias("text_bytes"), "truncated")


@_register("content_type", r"""
WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS img, strlen(regexp_replace(replace(coalesce(text, ''), '--- Page Break ---', ''), '^\s+|\s+$', '', 'g')) AS b FROM documents)
SELECT doc_id, CASE WHEN b >= 50 AND img THEN 'mixed' WHEN b >= 50 THEN 'text' WHEN img THEN 'scanned_images' ELSE 'no_content' END AS content_type FROM d""")
def content_type(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", reading.content_type(F.col("text"), F.col("doc_id") % 2 == 0).alias("content_type"))


@_register("content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@_register("page_select", "WITH r AS (SELECT unnest([3, 1, 1, 9, 0]) AS asked, unnest(range(5))::INTEGER AS request_idx) SELECT CAST(conv_id AS VARCHAR) AS path, asked AS page_number, request_idx FROM conversations JOIN r ON asked = turn + 1")
def page_select(spark, sf_dir):
    return elements.select_pages(conversation_pages(spark, sf_dir), PAGES).select("path", "page_number", "request_idx")


# --- elements ---


@_register("lines", f"WITH {LINES_SQL} SELECT path, page_number, element_id, text, line_idx, llx, lly, urx, ury, confidence FROM l")
def lines(spark, sf_dir):
    return _lines(spark, sf_dir).select(*_SHOWN, "line_idx", "llx", "lly", "urx", "ury", "confidence")


@_register("rectangles", f"WITH {LINES_SQL} SELECT path, element_id, llx AS x, lly AS y, urx - llx AS width, ury - lly AS height FROM l")
def rectangles(spark, sf_dir):
    box = rectangle(*(F.col(c) for c in ("llx", "lly", "urx", "ury")))
    return _lines(spark, sf_dir).select("path", "element_id", box.alias("r")).select("path", "element_id", "r.*")


@_register("words", f"""WITH {LINES_SQL}, {WORDS_SQL} SELECT path, page_number, 'word_' || page_number || '_' || (line_idx * 1000 + word_idx) AS element_id, 'line_' || page_number || '_' || line_idx AS parent_id, text,
round(72 + word_idx * (468.0::DOUBLE / n), 6) AS llx, round(72 + (word_idx + 1) * (468.0::DOUBLE / n), 6) AS urx, round(468.0::DOUBLE / n, 6) AS width FROM w""")
def words(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return _words(spark, sf_dir).select("path", "page_number", "element_id", "parent_id", "text", r("llx"), r("urx"), r("width"))


@_register("page_elements", r"SELECT CAST(conv_id AS VARCHAR) AS path, (turn + 1)::INTEGER AS page_number, 'text_' || (turn + 1) || '_0' AS element_id, text FROM conversations WHERE regexp_matches(text, '\S')")
def page_elements(spark, sf_dir):
    return elements.page_elements(conversation_pages(spark, sf_dir)).select(*_SHOWN)


@_register("element_parent_join", f"WITH {LINES_SQL}, {WORDS_SQL} SELECT w.path, w.page_number, w.line_idx, w.word_idx, w.text, l.text AS parent_text FROM w JOIN l USING (path, page_number, line_idx)")
def element_parent_join(spark, sf_dir):
    both = elements.union_elements([_lines(spark, sf_dir), _words(spark, sf_dir)])
    return elements.with_parents(both).where("level = 1").select("path", "page_number", "line_idx", "word_idx", "text", "parent_text")


@_register("union_elements", f"WITH {LINES_SQL}, {WORDS_SQL} SELECT level, count(*) AS n, count(DISTINCT path) AS paths FROM (SELECT 0 AS level, path FROM l UNION ALL SELECT 1, path FROM w) GROUP BY level")
def union_elements(spark, sf_dir):
    both = elements.union_elements([_lines(spark, sf_dir), _words(spark, sf_dir)])
    return both.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"))


@_register("top_elements", f"WITH {LINES_SQL} SELECT path, page_number, element_id, text FROM l ORDER BY path, page_number, line_idx LIMIT 5")
def top_elements(spark, sf_dir):
    return elements.first_elements(_lines(spark, sf_dir), 5).select(*_SHOWN)


def _query(name: str, condition: str, q: Query) -> None:
    @_register(name, f"WITH {LINES_SQL} SELECT path, page_number, element_id, text FROM l WHERE {condition}")
    def run(spark, sf_dir):
        return query.query(_lines(spark, sf_dir), q).select(*_SHOWN)


_BOX_SQL = f"NOT (urx < {BOX.llx} OR llx > {BOX.urx} OR ury < {BOX.lly} OR lly > {BOX.ury})"
_query("query_type", "type IN ('text', 'image')", Query(types=("text", "image")))
_query("query_type_none", "type = 'image'", Query(types=("image",)))
_query("query_page", "page_number IN (1, 3)", Query(pages=(1, 3)))
_query("query_confidence", "confidence >= 0.8", Query(min_confidence=0.8))
_query("query_text", f"contains(lower(text), '{TEXT}')", Query(text=TEXT.upper()))
_query("query_bbox", _BOX_SQL, Query(box=BOX))
_query("query_all", f"type = 'text' AND page_number IN (1, 2) AND confidence >= 0.5 AND contains(lower(text), '{TEXT}') AND {_BOX_SQL}", Query(("text",), (1, 2), BOX, TEXT, 0.5))


@_register("bbox_join", f"WITH {LINES_SQL}, b(box_id, a, c, d, e) AS (VALUES {', '.join(map(str, BOXES))}) SELECT box_id, path, element_id FROM l JOIN b ON NOT (urx < a OR llx > d OR ury < c OR lly > e)")
def bbox_join(spark, sf_dir):
    boxes = spark.createDataFrame(list(BOXES), "box_id int, q_llx double, q_lly double, q_urx double, q_ury double")
    return query.box_join(_lines(spark, sf_dir), boxes).select("box_id", "path", "element_id")


@_register("counts_by_type", f"WITH {LINES_SQL} SELECT path, count(*) AS text_elements, 0::BIGINT AS image_elements, 0::BIGINT AS vector_elements, 0::BIGINT AS form_elements, 0::BIGINT AS annotation_elements, count(*) AS total_elements FROM l GROUP BY path")
def counts_by_type(spark, sf_dir):
    return query.counts_by_type(elements.union_elements([_lines(spark, sf_dir), _words(spark, sf_dir)]))


@_register("extraction_summary", f"WITH {LINES_SQL} SELECT path, page_number, type, count(*) AS n, 'medium' AS quality FROM l GROUP BY path, page_number, type")
def extraction_summary(spark, sf_dir):
    return query.extraction_summary(_lines(spark, sf_dir))


# --- tables ---

RULES = TableRules(threshold=0.4)
ROWS_SQL = f"""{LINES_SQL},
g AS (SELECT *, (dense_rank() OVER (PARTITION BY path ORDER BY lly DESC) - 1)::INTEGER AS row_index, (row_number() OVER (PARTITION BY path, lly ORDER BY page_number, line_idx) - 1)::INTEGER AS col_index FROM l),
wd AS (SELECT path, row_index, count(*) AS width FROM g GROUP BY path, row_index),
fq AS (SELECT path, width, count(*) AS freq FROM wd GROUP BY path, width),
st AS (SELECT path, first(width ORDER BY freq DESC, width) AS n_columns, max(freq) AS kept_rows, sum(freq) AS n_rows, sum(freq * width) AS n_elements, max(freq)::DOUBLE / sum(freq) AS confidence FROM fq GROUP BY path)"""
FOUND_SQL = "fd AS (SELECT * FROM st WHERE n_elements >= 4 AND n_rows >= 2 AND confidence >= 0.5 AND confidence > {})"


@_register("row_clusters", f"WITH {ROWS_SQL} SELECT path, row_index, width FROM wd")
def row_clusters(spark, sf_dir):
    rows = tables.anchored_rows(_lines(spark, sf_dir), RULES)
    return tables.row_widths(rows, RULES).select("path", F.col("row_index").cast("int").alias("row_index"), "width")


@_register("row_width_mode", f"WITH {ROWS_SQL} SELECT path, n_columns, kept_rows, n_rows::BIGINT AS n_rows, round(confidence, 9) AS confidence FROM st")
def row_width_mode(spark, sf_dir):
    found = tables.structure(tables.grid_rows(_lines(spark, sf_dir), RULES), RULES)
    return found.select("path", "n_columns", "kept_rows", "n_rows", F.round("confidence", 9).alias("confidence"))


@_register("tables", f"WITH {ROWS_SQL}, {FOUND_SQL.format(0.4)} SELECT path, n_columns, kept_rows AS n_rows, n_columns * kept_rows AS cell_count, true AS has_headers, round(confidence, 9) AS confidence FROM fd")
def find_tables(spark, sf_dir):
    return tables.tables(_lines(spark, sf_dir), RULES, grid=True).withColumn("confidence", F.round("confidence", 9))


def _cells(name: str, threshold: float) -> None:
    @_register(name, f"WITH {ROWS_SQL}, {FOUND_SQL.format(threshold)} SELECT g.path, g.row_index, g.col_index, g.row_index = 0 AS is_header, g.text AS content FROM g JOIN wd USING (path, row_index) JOIN fd ON fd.path = g.path AND wd.width = fd.n_columns")
    def run(spark, sf_dir):
        return tables.cells(_lines(spark, sf_dir), TableRules(threshold=threshold), grid=True).select("path", "row_index", "col_index", "is_header", "content")


_cells("table_cells", 0.4)
_cells("table_cells_strict", 0.7)

# --- images ---

FILTERS = (*FORMATS, "UnknownFilter", "")


@_register("image_format_map", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{FORMATS.get(k, k or 'unknown')}')" for k in FILTERS) + ") AS t(filter, format)")
def image_format_map(spark, sf_dir):
    rows = spark.createDataFrame([(f,) for f in FILTERS], "filter string")
    return rows.select("filter", image_format(F.col("filter")).alias("format"))


@_register("image_size_estimate", "SELECT p_partkey, (p_size * 10)::BIGINT * p_size * 3 * ((1 + p_partkey % 20) // 8) AS size FROM part")
def image_size_estimate(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", estimated_size(F.col("p_size") * 10, F.col("p_size"), 1 + F.col("p_partkey") % 20).alias("size"))


@_register("event_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from ..streaming.ingest import windowed_counts

    counts = windowed_counts(table(spark, sf_dir, "events"))
    return counts.withColumn("window_start", timestamp_text(F.col("window_start")))


# --- files of bytes: every turn as a generated file, read back by the parser ---


_turns_made: dict[tuple[str, str], str] = {}


def _turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content: one page with the turn's text, an image and a note."""

    def run(batches):
        import pandas as pd

        from ..sources.pdf_writer import Page, write

        for batch in batches:
            made = []
            for path, turn, text in zip(batch["path"], batch["turn"], batch["text"]):
                turn = int(turn)
                image = (turn + 1, 2, ("DCTDecode", "FlateDecode")[turn % 2], "DeviceRGB", (8, 1)[turn % 2], b"x" * 6)
                page = Page(text, [image], [("Text", f"note {path}", (1, 2, 11, 22))], rotate=90 * (turn % 2))
                made.append(write([page], {"Title": f" turn {path} ", "Keywords": "a, b"}, packed=turn % 2 == 1))
            yield pd.DataFrame({"path": batch["path"], "content": made})

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _turns_made:  # made once a session
        turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), "turn", "text")
        at = shared_path(spark, "turn-files")
        turns = turns.repartition(max(1, -(-turns.count() // TURNS)), "path")  # a table may be a single row group
        turns.mapInPandas(run, "path string, content binary").write.parquet(at)
        _turns_made[key] = at
    return spark.read.parquet(_turns_made[key])


_TURN = "CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)"


@_register("pdf_text", f"SELECT {_TURN} AS path, 1::INTEGER AS page_number, rtrim(text, chr(10)) AS text FROM conversations")
def pdf_text(spark, sf_dir):
    from ..sources.pdf import parse

    return parse(_turn_files(spark, sf_dir), ("text",)).select("path", "page_number", F.regexp_replace("text", r"\n+$", "").alias("text"))


@_register("pdf_images", f"SELECT {_TURN} AS path, (turn + 1)::INTEGER AS width, CASE WHEN turn % 2 = 0 THEN 'JPEG' ELSE 'PNG/Deflate' END AS format, (turn + 1) * 2 * 3 * (1 - turn % 2) AS size FROM conversations")
def pdf_images(spark, sf_dir):
    from ..operators.documents import images
    from ..sources.pdf import parse

    return images(parse(_turn_files(spark, sf_dir), ("images",))).select("path", "width", "format", "size")


@_register("pdf_annotations", f"SELECT {_TURN} AS path, 'annotation_1_0' AS element_id, 'note ' || {_TURN} AS text, 'Text' AS detail, 10.0::DOUBLE AS width, 20.0::DOUBLE AS height FROM conversations")
def pdf_annotations(spark, sf_dir):
    from ..sources.pdf import parse

    return elements.annotation_elements(parse(_turn_files(spark, sf_dir), ("annotations",))).select("path", "element_id", "text", "detail", "width", "height")


@_register("pdf_page_info", f"SELECT {_TURN} AS path, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, (90 * (turn % 2))::INTEGER AS rotation FROM conversations")
def pdf_page_info(spark, sf_dir):
    from ..operators.documents import page_info
    from ..sources.pdf import parse

    return page_info(parse(_turn_files(spark, sf_dir), ())).select("path", "width", "height", "rotation")


@_register("pdf_metadata", f"SELECT {_TURN} AS path, 'turn ' || {_TURN} AS title, 2::INTEGER AS n_keywords, 1::INTEGER AS pages FROM conversations")
def pdf_metadata(spark, sf_dir):
    from ..operators.documents import metadata
    from ..sources.pdf import parse

    return metadata(parse(_turn_files(spark, sf_dir), ("info",))).select("path", "title", F.size("keywords").alias("n_keywords"), "pages")


@_register("pdf_read_document", f"SELECT {_TURN} AS path, CASE WHEN strlen(trim(text)) >= 50 THEN 'mixed' ELSE 'scanned_images' END AS content_type, 1::BIGINT AS image_count FROM conversations")
def pdf_read_document(spark, sf_dir):
    from ..sources.pdf import parse

    return reading.read_documents(parse(_turn_files(spark, sf_dir), ("text", "images"))).select("path", "content_type", "image_count")


@_register("pdf_validate", f"SELECT {_TURN} AS path, turn % 3 <> 0 AS valid FROM conversations")
def pdf_validate(spark, sf_dir):
    """Every third file is cut off after its header."""
    from ..sources.pdf import parse

    turn = F.element_at(F.split("path", "/"), 2).cast("int")
    cut = _turn_files(spark, sf_dir).withColumn("content", F.when(turn % 3 == 0, F.substring("content", F.lit(1), F.lit(12))).otherwise(F.col("content")))
    opened = parse(cut, ())
    return opened.groupBy("path").agg(F.max("error").isNull().alias("valid"))
