"""Fuzzy search of many names by many queries: against the condition for one name and one query."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import batch_search, search

# fixed values: names, queries, and whether the query finds the name
CASES = [
    ("machine_learning.pdf", "machine", True), ("Machine_Learning.pdf", "machine", True), ("research_paper.pdf", "research", True), ("RESEARCH_PAPER.pdf", "research", True), ("document.pdf", "document", True),
    ("machine_learning_guide.pdf", "learning", True), ("artificial_intelligence.pdf", "intel", True), ("deep_learning_tutorial.pdf", "deep tutorial", True), ("machine_learning_basics.pdf", "machine basics", True),
    ("document.pdf", "nonexistent", False), ("research.pdf", "machine", False), ("anything.pdf", "", True), ("report-2023.pdf", "2023", True), ("summary (final).pdf", "final", True), ("data[backup].pdf", "backup", True), ("any.pdf", "-", True),
]


def test_known_cases(spark):
    names = spark.createDataFrame(sorted({(n,) for n, _, _ in CASES}), "name string")
    queries = spark.createDataFrame(sorted({(q,) for _, q, _ in CASES}), "query string")
    got = {(r.name, r.query) for r in batch_search.search_many(names, queries).collect()}
    assert all(((n, q) in got) == found for n, q, found in CASES)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_query_at_a_time(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé1") for _ in range(rng.randint(1, 6)))
    gap = lambda: rng.choice(["_", " ", "-", ".", "(", ")", "[x]", "--"])
    names = [(k, "".join(word() + gap() for _ in range(rng.randint(0, 4))) + rng.choice([".pdf", ".PDF", ".txt", ""])) for k in range(300)] + [(900, None), (901, ""), (902, "same.pdf"), (902, "same.pdf")]
    queries = ["".join(word()[: rng.randint(1, 4)] + rng.choice([" ", "_", "", ".p"]) for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["", " ", "-", "._", ".pdf", "PDF", " same ", None, "same", "same", "df"]
    n = spark.createDataFrame(names, "k long, name string")
    q = spark.createDataFrame(list(enumerate(queries)), "number int, `query` string")
    got = sorted((r.number, r.k, r.name) for r in batch_search.search_many(n, q).collect())
    want = sorted((r.number, r.k, r.name) for r in n.where("name is not null").join(q, F.coalesce(search.matches(F.col("name"), F.col("query")), F.lit(False))).collect())
    assert got == want and len(got) > 500


def test_only_candidates_are_looked_at(spark):
    names = spark.createDataFrame([(f"common_{k:05d}.pdf",) for k in range(3000)], "name string")
    _, words, by_gram = batch_search.name_index(names)
    assert words.count() == 3002 and words.where("word in ('common', 'pdf')").agg(F.min("n_names")).first()[0] == 3000
    held = {(r.w, r.word) for r in batch_search.words_holding(spark.createDataFrame([("01234",), ("omm",), ("zzz",), ("0123x",)], "w string"), by_gram).collect()}
    assert held == {("01234", "01234"), ("omm", "common")}
    found = batch_search.search_many(names, spark.createDataFrame([("common 01234",), ("common zzz",)], "query string"))
    assert [(r.query, r.name) for r in found.collect()] == [("common 01234", "common_01234.pdf")]


def test_empty_tables(spark):
    names, queries = spark.createDataFrame([("a.pdf",)], "name string"), spark.createDataFrame([("a",), ("",)], "query string")
    assert batch_search.search_many(names.limit(0), queries).count() == 0 and batch_search.search_many(names, queries.limit(0)).count() == 0
