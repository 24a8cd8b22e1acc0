"""Queries over relations between elements, files and names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Query, TableRules
from ..functions.text import name_words
from ..functions import table_functions
from ..functions.text import timestamp_text
from ..operators import asof, batch_search, documents, elements, paging, properties, proximity, query, reading, reports, search, sketches, stats, tables, validate
from ..sources import files, pdf, report_sink
from ..sources.adapters import document_files, table
from ..sources.library import library, listed
from ..sources.library import pages as library_pages
from ..sources.shared import shared_path, written
from .library import FORMAT, _short, _with
from .registry import FILES_SQL, FOUND_SQL, LINES_SQL, NAME_WORDS, ROWS_SQL, SIZE_LIMIT, _lines, _register, _turn_files

# --- proximity ---

DOC_LINES_SQL = r"""
dl AS (SELECT CAST(doc_id AS VARCHAR) AS path, 1 AS page_number, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS k FROM documents),
el AS (SELECT path, page_number, 'line_1_' || k AS id, text, 72.0::DOUBLE AS llx, 720 - 12.0::DOUBLE * k AS lly, 540.0::DOUBLE AS urx, 732 - 12.0::DOUBLE * k AS ury FROM dl WHERE regexp_matches(text, '\S')
       UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'annotation_1_0', 'quality ' || quality, 545.0::DOUBLE + 40 * toxic, 700.0::DOUBLE - 60 * quality, 555.0::DOUBLE + 40 * toxic, 710.0::DOUBLE - 60 * quality FROM labels)"""
GROUPS_SQL = f"""{DOC_LINES_SQL},
bx AS (SELECT DISTINCT path, llx, lly, urx, ury FROM el),
nd AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY llx, lly, urx, ury) AS n FROM bx),
nr AS (SELECT a.path, a.n AS a, b.n AS b FROM nd a JOIN nd b ON a.path = b.path AND a.n <> b.n
       AND greatest(0, a.llx - b.urx, b.llx - a.urx) ** 2 + greatest(0, a.lly - b.ury, b.lly - a.ury) ** 2 <= 400),
rc AS (SELECT path, n AS a, n AS b FROM nd UNION SELECT rc.path, rc.a, nr.b FROM rc JOIN nr ON rc.path = nr.path AND rc.b = nr.a),
gr AS (SELECT path, a AS n, min(b) AS g FROM rc GROUP BY path, a),
eg AS (SELECT el.*, gr.g FROM el JOIN nd USING (path, llx, lly, urx, ury) JOIN gr USING (path, n)),
gs AS (SELECT path, g, min(id) AS group_id, count(*) AS group_size FROM eg GROUP BY path, g)"""


def _document_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as one page each, and a note for each label beside or away from them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("page_number"), "text")
    note = F.array(*[F.struct(F.lit("Text").alias("subtype"), F.concat(F.lit("quality "), F.col("quality")).alias("contents"), F.array(
        F.lit(545.0) + 40 * F.col("toxic"), F.lit(700.0) - 60 * F.col("quality"), F.lit(555.0) + 40 * F.col("toxic"), F.lit(710.0) - 60 * F.col("quality")).alias("rect"))])
    notes = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("page_number"), note.alias("annotations"))
    return elements.union_elements([elements.line_elements(docs), elements.annotation_elements(notes)])


@_register("proximity_groups", f"WITH RECURSIVE {GROUPS_SQL} SELECT path, page_number, id AS element_id, group_id, group_size FROM eg JOIN gs USING (path, g)")
def proximity_groups(spark, sf_dir):
    return proximity.groups(_document_elements(spark, sf_dir)).select("path", "page_number", "element_id", "group_id", "group_size")


@_register("proximity_regions", f"""WITH RECURSIVE {GROUPS_SQL}
SELECT path, page_number, group_id, count(*) AS n_elements, min(llx) AS llx, min(lly) AS lly, max(urx) AS urx, max(ury) AS ury, sha256(string_agg(text, chr(10) ORDER BY -ury, llx, id)) AS text_sha256
FROM eg JOIN gs USING (path, g) GROUP BY path, page_number, g, group_id""")
def proximity_regions(spark, sf_dir):
    found = proximity.regions(proximity.groups(_document_elements(spark, sf_dir)))
    return found.select("path", "page_number", "group_id", "n_elements", "llx", "lly", "urx", "ury", F.sha2("text", 256).alias("text_sha256"))


# --- complete mode: elements, the tables among them, and the groups they form ---

COMPLETE = TableRules(threshold=0.4)


@_register("complete_tables", f"""WITH {ROWS_SQL}, {FOUND_SQL.format(0.4)},
kept AS (SELECT g.*, fd.n_columns, fd.kept_rows, fd.confidence AS sure FROM g JOIN wd USING (path, row_index) JOIN fd ON fd.path = g.path AND wd.width = fd.n_columns)
SELECT path, 'text' AS type, element_id, min(llx) AS llx, min(lly) AS lly, max(urx) AS urx, max(ury) AS ury, 0::BIGINT AS cells FROM l GROUP BY path, element_id
UNION ALL SELECT path, 'table', 'table_' || min(page_number) || '_0', min(llx), min(lly), max(urx), max(ury), max(n_columns * kept_rows)::BIGINT FROM kept GROUP BY path""")
def complete_tables(spark, sf_dir):
    found = tables.with_tables(_lines(spark, sf_dir), COMPLETE, grid=True)
    cells = F.when(F.col("type") == "table", F.get_json_object("detail", "$.cells").cast("long")).otherwise(F.lit(0).cast("long"))
    return found.groupBy("path", "type", "element_id").agg(F.min("llx").alias("llx"), F.min("lly").alias("lly"), F.max("urx").alias("urx"), F.max("ury").alias("ury"), F.max(cells).alias("cells"))


# --- many queries, many names ---

BATCH_SQL = f"""
nm AS (SELECT doc_id, replace(substr(text, 1, 40), chr(10), '_') || '.pdf' AS name FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(text, '[^a-zA-Z]+'), lambda x: x <> '') AS ws FROM benchmark),
qs AS (SELECT item_id, k, substr(ws[k], 1, 3) || ' ' || substr(ws[k + 1], 2, 3) AS query FROM (SELECT *, unnest(range(1, 7)) AS k FROM bw)
       UNION ALL SELECT item_id, 0, CASE item_id % 4 WHEN 0 THEN upper(ws[1]) || ' pdf' WHEN 1 THEN ' - ' WHEN 2 THEN substr(ws[1], 1, 2) || '.' ELSE 'nonexistent ' || ws[1] END FROM bw)"""


@_register("fuzzy_search_batch", f"""WITH {BATCH_SQL}
SELECT item_id, k::INTEGER AS k, doc_id FROM qs JOIN nm ON contains(lower(name), lower(trim(query))) OR
len(list_filter({NAME_WORDS.format('trim(query)')}, lambda q: len(list_filter({NAME_WORDS.format("regexp_replace(lower(name), '[.]pdf$', '')")}, lambda x: contains(x, q))) = 0)) = 0""")
def fuzzy_search_batch(spark, sf_dir):
    """Fragments of every benchmark text, looked for in the beginnings of all documents."""
    names = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.translate(F.substring("text", 1, 40), "\n", "_"), F.lit(".pdf")).alias("name"))
    words = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split("text", "[^a-zA-Z]+"), lambda w: w != "").alias("ws"))
    word = lambda k: F.coalesce(F.get("ws", k), F.lit(""))
    some = words.select("item_id", "ws", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"))
    some = some.select("item_id", "k", F.concat(F.substring(word(F.col("k") - 1), 1, 3), F.lit(" "), F.substring(word(F.col("k")), 2, 3)).alias("query"))
    first, kind = word(F.lit(0)), F.col("item_id") % 4
    other = F.when(kind == 0, F.concat(F.upper(first), F.lit(" pdf"))).when(kind == 1, " - ").when(kind == 2, F.concat(F.substring(first, 1, 2), F.lit("."))).otherwise(F.concat(F.lit("nonexistent "), first))
    queries = some.unionByName(words.select("item_id", F.lit(0).alias("k"), other.alias("query")))
    return batch_search.search_many(names, queries).select("item_id", "k", "doc_id")


# --- properties ---

PROPERTY_SQL = """
js AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE json_object('lang', lang, 'size', json_object('chars', n_chars, 'mean', n_chars / 2), 'label',
       CASE WHEN quality IS NULL THEN NULL ELSE json_object('good', quality = 1, 'toxic', toxic) END, 'tags', json_array(source, CAST(doc_id % 3 AS VARCHAR))) END AS j FROM documents LEFT JOIN labels USING (doc_id))"""
_PROPERTIES = {
    "text": (properties.Property("detail.lang", "in", ("en", "de")), "json_type(j, '$.lang') = 'VARCHAR' AND json_extract_string(j, '$.lang') IN ('en', 'de')"),
    "starts": (properties.Property("detail.tags[0]", "starts", "src1"), "json_extract_string(j, '$.tags[0]') LIKE 'src1%'"),
    "number": (properties.Property("detail.size.chars", "gt", 2000), "CAST(json_extract(j, '$.size.chars') AS DOUBLE) > 2000"),
    "fraction": (properties.Property("detail.size.mean", "le", 100.5), "CAST(json_extract(j, '$.size.mean') AS DOUBLE) <= 100.5"),
    "boolean": (properties.Property("detail.label.good", "eq", True), "json_extract(j, '$.label.good') = 'true'"),
    "number_is_no_text": (properties.Property("detail.tags[1]", "eq", 1), "false"),
    "missing": (properties.Property("detail.label.good", "missing"), "j IS NULL OR json_extract(j, '$.label.good') IS NULL"),
    "null": (properties.Property("detail.label", "null"), "json_type(j, '$.label') = 'NULL'"),
    "not_in": (properties.Property("detail.label.toxic", "not_in", (1, 2)), "json_type(j, '$.label.toxic') IS NOT NULL AND CAST(json_extract(j, '$.label.toxic') AS INTEGER) NOT IN (1, 2)"),
}


@_register("element_properties", f"WITH {PROPERTY_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS condition, doc_id FROM js WHERE {sql}" for k, (_, sql) in _PROPERTIES.items()))
def element_properties(spark, sf_dir):
    """Page elements of documents whose detail tells their language, sizes, labels and tags; all conditions are asked in one scan."""
    good = F.struct((F.col("quality") == 1).alias("good"), F.col("toxic"))
    label = F.when(F.col("quality").isNotNull(), good)
    told = F.to_json(F.struct("lang", F.struct(F.col("n_chars").alias("chars"), (F.col("n_chars") / 2).alias("mean")).alias("size"), label.alias("label"), F.array("source", (F.col("doc_id") % 3).cast("string")).alias("tags")), {"ignoreNullFields": "false"})
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id"), F.col("doc_id") == F.col("l_id"), "left")
    pages = docs.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("page_number"), F.concat(F.lit("document "), F.col("doc_id")).alias("text"), F.when(F.col("doc_id") % 11 != 0, told).alias("told"))
    found = elements.page_elements(pages).drop("detail").join(pages.select(F.col("path").alias("t_path"), F.col("told").alias("detail"), "doc_id"), F.col("path") == F.col("t_path")).drop("t_path")
    asked = properties.with_properties(found)
    met = F.array(*[properties.condition(p) for p, _ in _PROPERTIES.values()])
    names = F.array(*map(F.lit, _PROPERTIES))
    # the outer form, as Spark would put the conditions once more into a filter before the other one
    each = asked.select("doc_id", F.posexplode_outer(met).alias("k", "met")).where("met")
    return each.select(F.get(names, F.col("k")).alias("condition"), "doc_id")


@_register("image_properties", _with("SELECT path, page_number, k::INTEGER AS image_idx FROM im WHERE k = 0 AND t % 4 IN (0, 1)"))
def image_properties(spark, sf_dir):
    """Images of the library by format and depth."""
    found = _short(elements.image_elements(library_pages(spark, sf_dir)), library(spark, sf_dir))
    chosen = properties.where(found, [properties.Property("detail.format", "in", ("JPEG", "JPEG2000")), properties.Property("detail.bits_per_component", "ge", 8), properties.Property("detail.size", "gt", 0), properties.Property("box.height", "eq", 2)])
    return chosen.select("path", "page_number", F.split("element_id", "_")[2].cast("int").alias("image_idx"))


# --- listings whose predicates the source takes ---


@_register("library_listing_by_name", _with("SELECT path, name FROM fs WHERE c % 5 = 1"))
def library_listing_by_name(spark, sf_dir):
    found = listed(spark, sf_dir).where(F.col("name").startswith("summary") & F.col("name").endswith(".PDF") & (F.col("size") > 0))
    return _short(found, library(spark, sf_dir)).select("path", "name")


@_register("library_listing_by_folder", _with("SELECT path, name FROM fs WHERE c % 4 IN (1, 2) AND c % 10 <> 4"))
def library_listing_by_folder(spark, sf_dir):
    root = library(spark, sf_dir)
    found = elements.union_elements([listed(spark, sf_dir).where(F.col("path").startswith(f"{root}/f{k}/") & (F.col("size") > 0)) for k in (1, 2)])
    return _short(found, root).select("path", "name")


# --- reports: formats as lines, written by path and read back ---


def _reported(spark: SparkSession, lines: DataFrame, name: str) -> DataFrame:
    at = shared_path(spark, name)
    report_sink.write_reports(lines, at)
    return report_sink.read_reports(spark, at)


_ITEMS = """, n AS (SELECT path, count(*) AS n FROM i GROUP BY path)
SELECT path, 0::INTEGER AS line, '{title}: ' || n AS text FROM n UNION ALL SELECT path, k::INTEGER, k || '. ' || item FROM i WHERE k <= 10 UNION ALL SELECT path, 11, '... and ' || (n - 10) || ' more' FROM n WHERE n > 10"""


@_register("report_assets", _with(f""", i AS (SELECT path, 'page ' || page_number || ', width ' || (t + 1) || ', height 2, format ' || {FORMAT} || ', bytes ' || CASE WHEN t % 2 = 0 THEN (t + 1) * 6 ELSE 0 END AS item,
row_number() OVER (PARTITION BY path ORDER BY page_number) AS k FROM im WHERE k = 0){_ITEMS.format(title='Images')}""").replace(" , i AS", ", i AS", 1))
def report_assets(spark, sf_dir):
    images = _short(documents.images(library_pages(spark, sf_dir)), library(spark, sf_dir))
    return _reported(spark, reports.assets(images), "report-assets")


@_register("report_matches", f"""WITH {DOC_LINES_SQL},
m AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k) AS r FROM dl WHERE contains(lower(text), 'the')),
i AS (SELECT path, 'page 1, text: ' || CASE WHEN strlen(text) > 100 THEN left(text, list_max(list_filter(range(0, 101), lambda x: strlen(left(text, x)) <= 100))) || CASE WHEN strlen(left(text, list_max(list_filter(range(0, 101), lambda x: strlen(left(text, x)) <= 100)))) < 100 THEN chr(65533) ELSE '' END || '...' ELSE text END AS item, r AS k FROM m){_ITEMS.format(title='Matches')}""")
def report_matches(spark, sf_dir):
    """Lines of all documents with a word, as a report a document."""
    found = query.query(_document_elements(spark, sf_dir), Query(types=("text",), text="the"))
    return _reported(spark, reports.matches(found), "report-matches")


@_register("report_validation", f"SELECT path, 0::INTEGER AS line, path || CASE WHEN size = 0 THEN ' is not valid: file is empty: ' || path WHEN size > {SIZE_LIMIT} THEN ' is not valid: file too large: ' || size || ' bytes (max: {SIZE_LIMIT} bytes)' ELSE ' is valid' END AS text FROM ({FILES_SQL})")
def report_validation(spark, sf_dir):
    return _reported(spark, reports.validation(validate.validate(document_files(spark, sf_dir), None, SIZE_LIMIT)), "report-validation")


@_register("report_extraction", f"WITH {LINES_SQL}, c AS (SELECT path, count(*) AS n FROM l GROUP BY path) SELECT path, unnest(range(7))::INTEGER AS line, unnest(['Elements', 'Text elements: ' || n, 'Image elements: 0', 'Vector elements: 0', 'Form elements: 0', 'Annotation elements: 0', 'Total elements: ' || n]) AS text FROM c")
def report_extraction(spark, sf_dir):
    return _reported(spark, reports.extraction(query.counts_by_type(_lines(spark, sf_dir))), "report-extraction")


@_register("report_directory", f"""WITH s AS (SELECT directory AS path, count(*) AS a, sum(size)::BIGINT AS b, max(size) AS c, first(name ORDER BY size DESC, path) AS d, min(size) AS e, first(name ORDER BY size, path) AS f, (sum(size) // count(*))::BIGINT AS g
FROM ({FILES_SQL}) WHERE size BETWEEN 1 AND {SIZE_LIMIT} GROUP BY directory)
SELECT path, unnest(range(8))::INTEGER AS line, unnest(['Directory', 'Total files: ' || a, 'Total size: ' || b, 'Largest size: ' || c, 'Largest name: ' || d, 'Smallest size: ' || e, 'Smallest name: ' || f, 'Average size: ' || g]) AS text FROM s""")
def report_directory(spark, sf_dir):
    found = stats.directory_stats(search.list_files(document_files(spark, sf_dir), SIZE_LIMIT), ["directory"])
    return _reported(spark, reports.directory(found), "report-directory")


@_register("report_document", r"""SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS path, unnest(range(len(x)))::INTEGER AS line, unnest(x) AS text FROM (
SELECT conv_id, turn, list_concat(['File: ' || conv_id || '/' || turn, 'Pages: 1', 'Content type: ' || CASE WHEN strlen(trim(text)) >= 50 THEN 'mixed' ELSE 'scanned_images' END, 'Images: 1',
CASE WHEN strlen(trim(text)) >= 50 THEN 'Text and images; the images may matter as well.' ELSE 'Mostly scanned images; look at the images instead.' END, ''], string_split(rtrim(text, chr(10)), chr(10))) AS x FROM conversations)""")
def report_document(spark, sf_dir):
    """Every generated file of a turn as a report, its text included; sizes are left out, as they are the writer's."""
    read = reading.read_documents(pdf.parse(_turn_files(spark, sf_dir), ("text", "images")))
    trimmed = read.withColumn("size", F.lit(None).cast("long")).withColumn("content", F.regexp_replace("content", r"\n+$", ""))
    return _reported(spark, reports.document(trimmed), "report-document")


# --- as-of join ---


def _asof(name: str, key: str) -> None:
    @_register(name, f"""SELECT e.event_id, e.{key}, v.event_id AS last_event_id, v.value AS last_value FROM (SELECT * FROM events WHERE event_type <> 'click') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') v ON e.{key} = v.{key} AND e.ts >= v.ts""" if key != "kind" else """
SELECT e.event_id, e.kind, v.event_id AS last_event_id, v.value AS last_value FROM (SELECT *, 'all' AS kind FROM events WHERE event_type <> 'click') e
ASOF LEFT JOIN (SELECT *, 'all' AS kind FROM events WHERE event_type = 'click') v ON e.kind = v.kind AND e.ts >= v.ts""")
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "events").withColumn("kind", F.lit("all"))
        clicks = rows.where("event_type = 'click'").select("event_id", key, "ts", "value")
        return asof.asof_join(rows.where("event_type <> 'click'"), clicks, [key], "ts", "ts").select("event_id", key, "last_event_id", "last_value")


_asof("asof_by_user", "user_id")
_asof("asof_hot_key", "kind")


# --- paging ---


@_register("paging", """WITH o AS (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS place, count(*) OVER () AS n FROM events)
SELECT event_id, value, place FROM o WHERE place < 25 OR place >= n // 2 AND place < n // 2 + 25 OR place >= n - 10""")
def paging_pages(spark, sf_dir):
    """The first page of all events by value, one from the middle, and the last, which is short."""
    found = paging.pages(table(spark, sf_dir, "events").select("event_id", "value"), [("value", False), "event_id"])
    return elements.union_elements([found.page(0, 25), found.page(found.total // 2, 25), found.page(found.total - 10, 25)])


@_register("paging_after", "SELECT event_id, value FROM events WHERE value < 20 OR value = 20 AND event_id > 100 ORDER BY value DESC, event_id LIMIT 30")
def paging_after(spark, sf_dir):
    found = paging.pages(table(spark, sf_dir, "events").select("event_id", "value"), [("value", False), "event_id"])
    return found.after([20.0, 100], 30)


# --- stateful streams ---


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _landed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream appends until nothing more comes."""
    target = shared_path(spark, name)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", shared_path(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


@_register("stream_versions", """WITH a AS (SELECT 'user' || user_id AS path, ts, event_id, CAST(floor(value / 20)::BIGINT AS VARCHAR) AS hash FROM events),
c AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY ts, hash) AS before, row_number() OVER (PARTITION BY path ORDER BY ts, hash) AS k FROM a)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY ts, hash) AS version, hash, strftime(ts, '%Y-%m-%d %H:%M:%S') AS since FROM c WHERE k = 1 OR hash <> before""")
def stream_versions(spark, sf_dir):
    """Every user's content by the value of their events: a new version where it changes."""
    from ..streaming.ingest import versions

    content = F.floor(F.col("value") / 20).cast("string")
    arrivals = _streamed(spark, sf_dir, "events").select(F.concat(F.lit("user"), F.col("user_id")).alias("path"), content.alias("hash"), F.col("ts").alias("at"))
    return _landed(spark, versions(arrivals, "3650 days"), "versions").withColumn("since", timestamp_text(F.col("since")))


@_register("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf_dir):
    """Users' sessions with gaps of less than six hours; those that may still grow at the end of the stream have not come out."""
    from ..streaming.ingest import sessions

    out = _landed(spark, sessions(_streamed(spark, sf_dir, "events"), "6 hours"), "sessions")
    return out.select("user_id", timestamp_text(F.col("start")).alias("start"), timestamp_text(F.col("end")).alias("end"), "n")


# --- sketches ---


@_register("sketch_rollup", """WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, value FROM events)
SELECT coalesce(event_type, '') AS event_type, coalesce(day, '') AS day, count(*) AS n, true AS distinct_ok, true AS median_ok, true AS p95_ok FROM e GROUP BY GROUPING SETS ((event_type, day), (event_type), ())""")
def sketch_rollup(spark, sf_dir):
    """Stored sketches by type and day, merged by type and over all, and whether each estimate is within its bound."""
    rows = table(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value", "user_id")
    by, sets = ["event_type", "day"], [["event_type", "day"], ["event_type"], []]
    stored, _ = written(sketches.build(rows, by, "value", "user_id"), "sketches")
    told = sketches.estimates(sketches.rollup(stored, sets, by))
    near = F.percentile("value", F.array(*[F.lit(q + d) for q in (0.5, 0.95) for d in (-sketches.RANK_ERROR, sketches.RANK_ERROR)]))
    exact = rows.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.count_distinct("user_id").alias("exact"), near.alias("near"))
    exact = exact.select(*[F.col(c).alias(f"x_{c}") for c in by], "exact", "near")
    met = told.join(exact, F.col("event_type").eqNullSafe(F.col("x_event_type")) & F.col("day").eqNullSafe(F.col("x_day")))
    between = lambda q, k: F.col(q).between(F.get("near", F.lit(k)), F.get("near", F.lit(k + 1)))
    return met.select(F.coalesce("event_type", F.lit("")).alias("event_type"), F.coalesce("day", F.lit("")).alias("day"), "n", sketches.within(F.col("distinct"), F.col("exact")).alias("distinct_ok"), between("q50", 0).alias("median_ok"), between("q95", 2).alias("p95_ok"))


# --- table functions in SQL text ---


@_register("sql_anchored_rows", f"WITH {ROWS_SQL} SELECT path, row_index, width FROM wd")
def sql_anchored_rows(spark, sf_dir):
    table_functions.register(spark)
    _lines(spark, sf_dir).select("path", "page_number", "element_id", "lly").createOrReplaceTempView("pagewright_lines")
    return spark.sql("SELECT path, row_index, count(*) AS width FROM anchored_rows(TABLE(pagewright_lines), 5.0) GROUP BY path, row_index")


@_register("sql_glob_matches", "SELECT doc_id, g AS pattern FROM (SELECT doc_id, source || '_' || lang || '.pdf' AS name FROM documents) JOIN (SELECT unnest(['src1*', '*_en.pdf', 'src[2-4]_??.pdf', '*[!x']) AS g) ON name GLOB g AND g <> '*[!x'")
def sql_glob_matches(spark, sf_dir):
    table_functions.register(spark)
    table(spark, sf_dir, "documents").selectExpr("doc_id", "source || '_' || lang || '.pdf' AS name").createOrReplaceTempView("pagewright_names")
    return spark.sql("SELECT doc_id, pattern FROM pagewright_names, LATERAL glob_matches(name, array('src1*', '*_en.pdf', 'src[2-4]_??.pdf', '*[!x'))")


@_register("stream_listing", _with("SELECT path, name, c % 10 = 4 AS empty, 1::BIGINT AS n FROM fs"))
def stream_listing(spark, sf_dir):
    """The library's files as they are met by a listing stream, started twice: each once."""
    root, target, state = library(spark, sf_dir), shared_path(spark, "listed"), shared_path(spark, "listed-state")
    for _ in range(2):
        found = files.listing_stream(spark, root)
        found.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = _short(spark.read.schema(found.schema).parquet(target), root)
    return rows.groupBy("path", "name", (F.col("size") == 0).alias("empty")).agg(F.count(F.lit(1)).alias("n"))
