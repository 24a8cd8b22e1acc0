"""The fourteen verbs over files and directories, each a DataFrame."""

from __future__ import annotations

import os

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ExtractConfig, Query, Settings, check_file_limit
from .functions.formats import SUPPORTED
from .operators import documents, elements, proximity, query, reading, search, stats, tables, validate
from .sources import files, pdf, store

# The names under which the verbs are known to clients.
TOOLS = {
    "pdf_read_file": "text, content type and image count of a file",
    "pdf_assets_file": "images of a file",
    "pdf_validate_file": "whether a file is a readable PDF, and why not",
    "pdf_stats_file": "size, pages, dates and document information of a file",
    "pdf_search_directory": "PDF files below a directory, by name",
    "pdf_stats_directory": "number and sizes of the PDF files below a directory",
    "pdf_server_info": "this catalogue, the limits and the default directory's files",
    "pdf_extract_structured": "lines, words, images and annotations with their boxes",
    "pdf_extract_tables": "tables and their cells",
    "pdf_extract_semantic": "elements grouped by meaning",
    "pdf_extract_complete": "all elements; their tables come from pdf_extract_tables",
    "pdf_query_content": "elements that meet conditions",
    "pdf_get_page_info": "page sizes",
    "pdf_get_metadata": "document information",
}


class Engine:
    """Binds a session and settings; every method returns a lazy DataFrame."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None) -> None:
        self.spark = spark
        self.settings = settings or Settings.from_spark(spark)
        self.limit = check_file_limit(self.settings.max_file_size)

    # --- files ---

    def _listed(self, path: str) -> DataFrame:
        """The listing row of one path; a null size where there is nothing."""
        found = store.info(path) if path else None
        exists, is_dir = bool(found and found.type is not FileType.NotFound), bool(found and found.type is FileType.Directory)
        size = found.size if exists and not is_dir else None
        at = F.timestamp_seconds(F.lit(found.mtime_ns / 1e9)) if exists and found.mtime_ns else F.lit(None).cast("timestamp")
        return self.spark.range(1).select(F.lit(path).alias("path"), F.lit(os.path.basename(path)).alias("name"), F.lit(size).cast("long").alias("size"), at.alias("modified_time"), F.lit(is_dir).alias("is_dir"))

    def _checked(self, path: str, gate) -> DataFrame:
        """The listing row, or the gate's error raised when the plan is built."""
        listed = self._listed(path)
        text = validate.message(F.col("path"), F.col("size"), F.col("is_dir"), self.limit, check_path=True, require_ext=False, allow_empty=True)
        got = listed.select(F.coalesce(text, gate).alias("m")).first()["m"]
        if got:
            raise ValueError(got)
        return listed

    def parsed(self, path: str, fields=pdf.ALL, pages=()) -> DataFrame:
        listed = self._checked(path, validate.extraction_message(self.limit))
        return pdf.parse(files.content_of(listed), fields, pages)

    def read_file(self, path: str) -> DataFrame:
        listed = self._checked(path, validate.reader_message(self.limit))
        return reading.read_documents(pdf.parse(files.content_of(listed), ("text", "images"), image_data=False))

    def assets_file(self, path: str) -> DataFrame:
        return documents.images(self.parsed(path, ("images",)))

    def validate_file(self, path: str) -> DataFrame:
        listed = self._listed(path)
        readable = listed.where(validate.listing_message(self.limit).isNull() & F.col("size").isNotNull())
        return validate.validate(listed, pdf.parse(files.content_of(readable), ()), self.limit)

    def stats_file(self, path: str) -> DataFrame:
        listed = self._checked(path, validate.extraction_message(self.limit))
        return stats.file_stats(listed, pdf.parse(files.content_of(listed), ("info",)))

    # --- directories ---

    def _directory(self, directory: str) -> DataFrame:
        """What all verbs on directories begin with; none lists files that are empty or too large."""
        return files.readable(files.listing(self.spark, directory or self.settings.dir), self.limit)

    def search_directory(self, directory: str = "", text: str = "") -> DataFrame:
        return search.in_walk_order(search.search(self._directory(directory), text, self.limit))

    def search_pattern(self, directory: str, pattern: str) -> DataFrame:
        """A missing directory gives no rows here."""
        try:
            listed = self._directory(directory)
        except FileNotFoundError:
            listed = self._listed("").where(F.lit(False))
        return search.in_walk_order(search.search_pattern(listed, pattern, self.limit))

    def find_files(self, directory: str = "") -> DataFrame:
        return self.search_directory(directory)

    def count_files(self, directory: str = "") -> DataFrame:
        return search.count_files(self._directory(directory), self.limit)

    def stats_directory(self, directory: str = "") -> DataFrame:
        return stats.directory_stats(search.list_files(self._directory(directory), self.limit))

    def server_info(self) -> DataFrame:
        """(section, key, value): tools, limits, image formats, and the default directory's first ten files."""
        rows = [("tool", k, v) for k, v in TOOLS.items()]
        rows += [("limit", "max_file_size", str(self.limit)), ("limit", "dir", self.settings.dir)]
        rows += [("image_format", f, "") for f in SUPPORTED]
        catalogue = self.spark.createDataFrame(rows, "section string, key string, value string")
        try:
            listed = search.in_walk_order(search.list_files(self._directory(""), self.limit)).limit(10)
        except FileNotFoundError:
            return catalogue
        return catalogue.unionByName(listed.select(F.lit("file").alias("section"), F.col("name").alias("key"), F.col("size").cast("string").alias("value")))

    # --- contents ---

    def extract(self, path: str, config: ExtractConfig = ExtractConfig()) -> DataFrame:
        found = elements.extract(self.parsed(path), config)
        return tables.semantic_groups(found) if config.mode == "semantic" else found

    def extract_structured(self, path: str, **options) -> DataFrame:
        return self.extract(path, ExtractConfig(**{"mode": "structured"} | options))

    def extract_semantic(self, path: str, **options) -> DataFrame:
        return self.extract(path, ExtractConfig(**{"mode": "semantic"} | options))

    def extract_complete(self, path: str, **options) -> DataFrame:
        return self.extract(path, ExtractConfig(**{"mode": "complete"} | options))

    def complete(self, path: str, **options) -> DataFrame:
        """Complete mode with what it finds: elements, and their tables as elements, with the group that each is near to."""
        config = ExtractConfig(**{"mode": "complete"} | options)
        found = elements.extract(self.parsed(path), config)
        return proximity.groups(tables.with_tables(found, config.tables))

    def extract_tables(self, path: str, config: ExtractConfig = ExtractConfig(mode="table")) -> DataFrame:
        """Tables; none in modes that look for none."""
        found = tables.tables(elements.extract(self.parsed(path, ("text",)), config), config.tables)
        return found if config.finds_tables else found.where(F.lit(False))

    def table_cells(self, path: str, config: ExtractConfig = ExtractConfig(mode="table")) -> DataFrame:
        return tables.cells(elements.extract(self.parsed(path, ("text",)), config), config.tables)

    def query_content(self, path: str, conditions: Query | str, config: ExtractConfig = ExtractConfig(mode="complete")) -> DataFrame:
        q = Query.from_json(conditions) if isinstance(conditions, str) else conditions
        return query.query(elements.extract(self.parsed(path), config), q)

    def query_summary(self, path: str, conditions: Query | str) -> DataFrame:
        return query.summary(self.query_content(path, conditions))

    def page_info(self, path: str) -> DataFrame:
        return documents.page_info(self.parsed(path, ()))

    def metadata(self, path: str) -> DataFrame:
        return documents.metadata(self.parsed(path, ("info",)))
