"""Fuzzy name search for a table of queries: each name is looked at once, whatever the number of queries.

A query finds a name if it is part of it, or if each of its words is part of some word of the name
(``search.matches``).  Either way every word of the query is part of some word of the name, so:

1. Distinct words of all names make a vocabulary, and its words' grams (of one to three letters) an index.
2. A query word looks up the rarest of its grams, and keeps the words that hold it whole.
3. Of a query's words the one whose words stand in the fewest names leads; names with such a word
   are candidates, and the exact condition decides.

Names and queries are distinct in all this, and met with their rows at the end.  A query without
words finds every name, as it does alone.

Defined cases: null names are found by no query, null queries find nothing; equal names and equal
queries are found as often as they are there; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_words
from ..sources.shared import written
from .search import matches

LONGEST = 3  # letters of a gram


def grams(word: Column, size: Column) -> Column:
    """The distinct runs of ``size`` letters of a word."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda k: F.substring(word, k, size)))


def name_index(files: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names by word, number of names of each word, words by gram), as tables in the shared folder."""
    names = files.select(F.lower(F.col(f"`{name}`")).alias("low")).where("low is not null").distinct()
    by_word, _ = written(names.select("low", F.explode(F.array_distinct(name_words(F.col("low")))).alias("word")), "names-by-word")
    words, _ = written(by_word.groupBy("word").agg(F.count(F.lit(1)).alias("n_names")), "name-words")
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("word"))))
    by_gram, _ = written(words.select("word", "n_names", sizes.alias("size")).select("word", "n_names", F.explode(grams(F.col("word"), F.col("size"))).alias("gram")), "words-by-gram")
    return by_word, words, by_gram


def words_holding(wanted: DataFrame, by_gram: DataFrame) -> DataFrame:
    """(w, word, n_names): the words of names that hold each wanted word w, looked up by its rarest gram."""
    size = F.least(F.lit(LONGEST), F.length("w"))
    asked = wanted.select("w", F.explode(grams(F.col("w"), size)).alias("g"))
    counts = by_gram.groupBy("gram").agg(F.count(F.lit(1)).alias("n_words"))
    met = asked.join(counts, F.col("g") == F.col("gram"), "left").groupBy("w")
    # a gram that no name has: no name has the word
    rarest = met.agg(F.min_by("g", F.struct("n_words", "g")).alias("rarest"), F.min(F.col("n_words").isNotNull()).alias("all")).where("all")
    return rarest.join(by_gram, F.col("rarest") == F.col("gram")).where(F.contains("word", F.col("w"))).select("w", "word", "n_names")


def search_many(files: DataFrame, queries: DataFrame, name: str = "name", query: str = "query") -> DataFrame:
    """Columns of files and queries for every name a query finds; their columns must have different names."""
    by_word, _, by_gram = name_index(files, name)
    asked = queries.select(F.lower(F.trim(F.col(f"`{query}`"))).alias("q")).where("q is not null").distinct()
    asked = asked.select("q", F.array_distinct(name_words(F.col("q"))).alias("words"))
    by_query = asked.select("q", F.size("words").alias("n"), F.explode("words").alias("q_w"))
    holding, _ = written(words_holding(by_query.select(F.col("q_w").alias("w")).distinct(), by_gram), "words-holding")
    weights = holding.groupBy("w").agg(F.sum("n_names").alias("weight"))
    lead = by_query.join(weights, F.col("q_w") == F.col("w")).groupBy("q").agg(F.min_by("w", F.struct("weight", "w")).alias("lead"), F.count(F.lit(1)).alias("held"), F.first("n").alias("n"))
    lead = lead.where("held = n").select("q", "lead")
    at = holding.select("w", F.col("word").alias("h_word"))
    candidates = lead.join(at, F.col("lead") == F.col("w")).select("q", "h_word").join(by_word, F.col("h_word") == F.col("word")).select("q", "low").distinct()
    found = candidates.where(matches(F.col("low"), F.col("q"))).select(F.col("q").alias("__q"), F.col("low").alias("__low"))
    key_of = F.lower(F.trim(F.col(f"`{query}`")))
    with_words = queries.where(F.size(name_words(key_of)) > 0)
    some = found.join(with_words, F.col("__q") == key_of).join(files, F.col("__low") == F.lower(F.col(f"`{name}`")))
    shown = [*[F.col(f"`{c}`") for c in queries.columns], *[F.col(f"`{c}`") for c in files.columns]]
    # every name for each query without words is the result itself; names are dealt evenly, and every share meets these queries
    shares = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blank = queries.where((F.size(name_words(key_of)) == 0) & F.col(f"`{query}`").isNotNull()).withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    every = files.where(F.col(f"`{name}`").isNotNull()).withColumn("__share", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in files.columns]), F.lit(shares)).cast("int"))
    return some.select(*shown).unionByName(every.join(blank, F.col("__share") == F.col("__of")).select(*shown))
