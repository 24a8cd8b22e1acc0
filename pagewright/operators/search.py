"""File discovery: predicates over listings, fuzzy and shell-pattern name search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MIB
from ..functions.text import glob_ends, glob_regex, name_words
from .validate import listing_message

DEFAULT_LIMIT = 100 * MIB


def is_pdf(name: Column) -> Column:
    return F.endswith(F.lower(name), F.lit(".pdf"))


def walk_key(path: Column) -> Column:
    """Sorts paths level by level, as a lexical directory walk meets them."""
    return F.split(path, "/")


def matches(name: Column, query: str | Column) -> Column:
    """Whether the query is part of the name, or each of its words part of some word of the name."""
    q = F.lit(query) if isinstance(query, str) else query
    q = F.lower(F.trim(q))
    low = F.lower(name)
    stem = F.regexp_replace(low, r"\.pdf$", "")
    words, wanted = name_words(stem), name_words(q)
    by_word = F.forall(wanted, lambda w: F.exists(words, lambda x: F.contains(x, w)))
    return (q == "") | F.contains(low, q) | F.contains(stem, q) | by_word


def list_files(files: DataFrame, max_file_size: int = DEFAULT_LIMIT) -> DataFrame:
    """Listed files that look like readable PDFs, without opening them."""
    return files.where(listing_message(max_file_size).isNull())


def search(files: DataFrame, query: str = "", max_file_size: int = DEFAULT_LIMIT) -> DataFrame:
    found = list_files(files, max_file_size)
    return found.where(matches(F.col("name"), query)) if query.strip() else found


def search_pattern(files: DataFrame, pattern: str = "", max_file_size: int = DEFAULT_LIMIT) -> DataFrame:
    """By a case-sensitive shell pattern over the whole name; a malformed one finds nothing."""
    found = list_files(files, max_file_size)
    if not pattern:
        return found
    regex = glob_regex(pattern)
    if regex is None:
        return found.where(F.lit(False))
    first, last = glob_ends(pattern)  # plain beginnings and ends are predicates that a source can take
    return found.where(F.col("name").startswith(first) & F.col("name").endswith(last) & F.col("name").rlike(regex))


def in_walk_order(files: DataFrame) -> DataFrame:
    return files.orderBy(walk_key(F.col("path")))


def count_files(files: DataFrame, max_file_size: int = DEFAULT_LIMIT) -> DataFrame:
    return list_files(files, max_file_size).agg(F.count(F.lit(1)).alias("n_files"))
