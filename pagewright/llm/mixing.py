"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 48-bit hash.  A source whose target is T words of its S words
is taken floor(T / S) times as a whole, and the rest r < S once more from those of its
documents whose hash lies below a threshold.  The threshold is found without sorting:
words are summed by source and hash bucket (4096 buckets), the running sum names the
bucket in which r is reached, and only that boundary bucket is summed again by the next
twelve bits, down to one hash value.  Thresholds nest: a larger target takes a superset.

Sources weigh by their rank in code point order (null is a source, and last).  Targets
share the budget by weight, stop at ``max_repeat`` times the source's words, and what is
cut off there is shared anew by weight until no target is above.

Defined cases: a null text has size 0; of rows equal in id and text, which share a hash,
only as many are taken as come nearest to the target; a source that needs no rest has no
threshold, so no row is taken more often than its whole copies say; an empty table gives an
empty result; further columns are kept, whatever their names (working columns carry the
prefix ``__mx_``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_hash, shuffle_partitions, written

BITS, LEVEL_BITS = 48, 12
CHUNK = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """48 bits of md5 over id and text (nulls count as empty)."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("long")


def source_targets(per_source: DataFrame, weights: Sequence[int], max_repeat: int, budget: float) -> DataFrame:
    """(source, size) to (source, size, target).  One row a source, so this is small.

    Sorted by cap / weight, the capped sources are a prefix: the level of the rest is
    (budget - caps before) / (weights from here on), valid at the first source whose
    cap is not below it.
    """
    everything = W.partitionBy(F.lit(1))
    ranked = per_source.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", (F.lit(max_repeat) * F.col("size")).cast("long"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = everything.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = ranked.withColumns({
        "left": F.lit(float(budget)) * F.sum("size").over(everything) - (F.sum("cap").over(upto) - F.col("cap")),
        "shares": F.sum("weight").over(everything) - (F.sum("weight").over(upto) - F.col("weight")),
    })
    ranked = ranked.withColumn("level", F.col("left") / F.col("shares"))
    settled = F.col("level") <= F.col("ratio")
    ranked = ranked.withColumn("final", F.min_by(F.when(settled, F.col("level")), F.when(settled, F.struct("ratio", "rank"))).over(everything))
    return ranked.select("source", "size", F.when(F.col("final").isNull() | (F.col("cap") <= F.col("final") * F.col("weight")), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, budget: float = 1.0,
) -> tuple[DataFrame, list[str]]:
    """Decisions, one row a document: source, doc_id, hash, size, source_size, target, copies.

    Returns them with the paths of the written tables they stand on.
    """
    sized, thresholds, paths = _decide(docs, doc_id, text, source, weights, max_repeat, budget)
    decided = _with_copies(sized, thresholds)
    some = _equal_rows(sized, thresholds)
    if some is not None:
        split = _times(some, "__mx_rows").withColumn("__mx_more", (F.col("__mx_copy") <= F.col("__mx_quota")).cast("long")).select(*sized.columns, "__mx_more")
        split = _with_copies(split, thresholds).withColumn("copies", F.col("copies") + F.col("__mx_more")).drop("__mx_more")
        decided = decided.filter((F.col("extra") == 0) | (F.col("hash") != F.col("threshold"))).unionByName(split)
    return decided.select("doc_id", "source", "hash", "size", "source_size", "target", "copies"), paths


def _equal_rows(rows: DataFrame, thresholds: DataFrame, source: str = "source", hashed: str = "hash") -> DataFrame | None:
    """Of hashes of which some rows are taken, each different row once, how often it occurs and how many of it are taken.

    Counted before the shuffle: a hot row is one row here.  None where no hash is split.
    """
    split = thresholds.filter("extra > 0").select(F.col("source").alias("__mx_s"), F.col("threshold").alias("__mx_at"), F.col("extra").alias("__mx_extra"))
    if split.isEmpty():
        return None
    inside = rows.withColumn("__mx_row", row_hash(rows)).join(split, F.col(source).eqNullSafe(F.col("__mx_s")) & (F.col(hashed) == F.col("__mx_at")))
    each = inside.groupBy("__mx_s", "__mx_row").agg(F.first("__mx_extra").alias("__mx_extra"), F.count(F.lit(1)).alias("__mx_rows"), F.first(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("__mx_whole_row"))
    before = F.sum("__mx_rows").over(W.partitionBy("__mx_s").orderBy("__mx_row")) - F.col("__mx_rows")
    each = each.withColumn("__mx_quota", F.greatest(F.lit(0), F.least(F.col("__mx_rows"), F.col("__mx_extra") - before)))
    return each.select("__mx_whole_row.*", "__mx_rows", "__mx_quota")


def _times(rows: DataFrame, n: str) -> DataFrame:
    """Each row n times, numbered from 1; chunks of a row go to many tasks."""
    parts = rows.filter(F.col(n) > 0).withColumn("__mx_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK))))
    parts = parts.repartition(shuffle_partitions(rows.sparkSession))
    return parts.withColumn("__mx_copy", F.explode(F.sequence(F.col("__mx_part") * CHUNK + 1, F.least(F.col(n), (F.col("__mx_part") + 1) * CHUNK))))


def _decide(docs: DataFrame, doc_id: str, text: str, source: str, weights: Sequence[int], max_repeat: int, budget: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sizes and hashes of all documents, and the threshold of each source, as written tables."""
    sized, p1 = written(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            document_hash(F.col(doc_id), F.col(text)).alias("hash"),
        ), "mix-sizes",
    )
    thresholds, p2 = written(_thresholds(sized, weights, max_repeat, budget), "mix-thresholds")
    return sized, thresholds, [p1, p2]


def _with_copies(rows: DataFrame, thresholds: DataFrame, source: str = "source", hashed: str = "hash") -> DataFrame:
    """rows with their source's figures and copies.  The right side has a row a source; Spark broadcasts it if it is small."""
    t = thresholds.withColumnRenamed("source", "__mx_of")
    joined = rows.join(t, F.col(source).eqNullSafe(F.col("__mx_of")), "left")
    return joined.withColumn("copies", F.col("whole") + (F.col(hashed) < F.col("threshold")).cast("long"))


def _thresholds(sized: DataFrame, weights: Sequence[int], max_repeat: int, budget: float) -> DataFrame:
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"))
    state = source_targets(per_source, weights, max_repeat, budget).withColumnRenamed("size", "source_size")
    state = state.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    state = state.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    base = state.select("source", "source_size", "target", "whole")
    state = state.filter("rest > 0").select("source", "rest", "prefix")  # else no threshold: only whole copies
    for level in range(1, BITS // LEVEL_BITS + 1):
        shift = BITS - LEVEL_BITS * level
        s = state.select(F.col("source").alias("s_source"), "rest", "prefix")
        bucket = F.shiftright("hash", shift)
        hist = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        if level > 1:  # only the boundary bucket of each source is summed again
            inside = F.col("source").eqNullSafe(F.col("s_source")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
            hist = sized.join(s.select("s_source", "prefix"), inside).groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        hist = hist.withColumn("upto", F.sum("words").over(run))
        state = (
            hist.join(s.select("s_source", "rest"), F.col("source").eqNullSafe(F.col("s_source")))
            .filter(F.col("upto") > F.col("rest"))
            .groupBy("source").agg(F.min(F.struct("bucket", "words", "upto", "rest", "n")).alias("b"))
            .select("source", (F.col("b.rest") - (F.col("b.upto") - F.col("b.words"))).alias("rest"), F.col("b.bucket").alias("prefix"), F.col("b.words").alias("words"), F.col("b.n").alias("n"))
        )
    # the last bucket is one hash value: so many of its rows are taken as come nearest to the target
    nearest = F.ceil(F.col("rest") * F.col("n") / F.col("words") - 0.5)
    state = state.withColumn("some", F.greatest(F.lit(0), F.least(F.col("n"), nearest)).cast("long"))
    cut = state.select(
        F.col("source").alias("c_source"), (F.col("prefix") + (F.col("some") == F.col("n")).cast("long")).alias("threshold"),
        F.when(F.col("some") < F.col("n"), F.col("some")).otherwise(F.lit(0)).alias("extra"),
    )
    return base.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").select(
        "source", "source_size", "target", "whole", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("threshold", "extra")]
    )


def take(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, budget: float = 1.0) -> DataFrame:
    """The mixed rows themselves: each row of docs as often as its decision says."""
    _, thresholds, _ = _decide(docs, doc_id, text, source, weights, max_repeat, budget)
    renamed = thresholds.select(F.col("source").alias("__mx_of"), F.col("whole").alias("__mx_whole"), F.col("threshold").alias("__mx_threshold"))
    keyed = docs.withColumn("__mx_hash", document_hash(F.col(doc_id), F.col(text)))
    joined = keyed.join(renamed, F.col(source).eqNullSafe(F.col("__mx_of")))
    copies = F.col("__mx_whole") + (F.col("__mx_hash") < F.col("__mx_threshold")).cast("long")
    repeated = joined.withColumn("__mx_copies", copies.cast("int")).filter("__mx_copies > 0").withColumn("__mx_copy", F.explode(F.sequence(F.lit(1), F.col("__mx_copies"))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    some = _equal_rows(keyed, thresholds, source, "__mx_hash")
    return repeated.select(*columns) if some is None else repeated.select(*columns).unionByName(_times(some, "__mx_quota").select(*columns))


def _digest(spark, sf_dir):
    decided, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return decided.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, 1 + (rk - 1) % 3 AS w, 3 * s AS cap, (3 * s)::DOUBLE / (1 + (rk - 1) % 3) AS ratio FROM r),
c AS (SELECT *, ((SELECT sum(s) FROM w)::DOUBLE - (sum(cap) OVER o - cap)::DOUBLE) / ((SELECT sum(w) FROM w) - (sum(w) OVER o - w))::DOUBLE AS lev
      FROM w WINDOW o AS (ORDER BY ratio, rk ROWS UNBOUNDED PRECEDING)),
f AS (SELECT lev AS fin FROM c WHERE lev <= ratio ORDER BY ratio, rk LIMIT 1),
t AS (SELECT source, s, CASE WHEN cap <= (SELECT fin FROM f) * w THEN cap::DOUBLE ELSE coalesce((SELECT fin FROM f) * w, 0.0) END AS target FROM c),
u AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, u.s, u.target, u.whole, u.target - u.whole * u.s AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(d.size) OVER h AS own, count(*) OVER h AS n, row_number() OVER (PARTITION BY d.source, d.h ORDER BY d.doc_id) AS k
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source WINDOW h AS (PARTITION BY d.source, d.h)),
y AS (SELECT *, whole + CASE WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN 1 WHEN upto - own > rest OR own = 0 THEN 0
                             WHEN k <= ceil((rest - (upto - own)) * n / own - 0.5) THEN 1 ELSE 0 END AS copies FROM x)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM y
"""
