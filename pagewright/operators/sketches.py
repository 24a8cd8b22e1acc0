"""Stored sketches of numbers and distinct values, merged into any coarser grouping.

A table of sketches has a row for each finest group: exact counts and sums, a HyperLogLog sketch of the
distinct values of one column and a KLL sketch of the quantiles of another.  Coarser groups merge
rows of that table, so the data are read once however many groupings are asked for, and new data add rows.
Groups combine before the shuffle, so a group that holds most rows is no burden.

Bounds: with ``LG_K`` the estimated distinct number is within 5 % of the true one in 99 of 100 cases
(relative standard error 1.04 / sqrt(2^LG_K), 1.6 %), and with ``KLL_K`` the rank of an
estimated quantile is within ``RANK_ERROR`` of the one asked for; ``within`` says so against exact results.

Defined cases: nulls are counted in ``n`` alone; a group without values has no quantiles and no
distinct ones; the groups of null keys stay apart from subtotals, which ``level`` tells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K, RANK_ERROR = 12, 400, 0.02


def build(df: DataFrame, by: Sequence[str], value: str, distinct: str) -> DataFrame:
    """(by, n, total, distinct_sketch, quantile_sketch), a row a finest group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("total"),
        F.hll_sketch_agg(F.col(distinct), F.lit(LG_K)).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("quantile_sketch"),
    )


def rollup(sketches: DataFrame, sets: Sequence[Sequence[str]], by: Sequence[str]) -> DataFrame:
    """Sketches merged by grouping sets; ``level`` is the number of keys of a row's set."""
    level = sum(((1 - F.grouping(c)).cast("int") for c in by), F.lit(0))
    return sketches.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(
        level.alias("level"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def estimates(sketches: DataFrame, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """The sketches' numbers: distinct, and q50, q95 and so on."""
    some = F.kll_sketch_get_n_double("quantile_sketch") > 0
    found = [F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q))).alias(f"q{round(100 * q)}") for q in quantiles]
    return sketches.select(
        *[c for c in sketches.columns if not c.endswith("_sketch")], F.hll_sketch_estimate("distinct_sketch").alias("distinct"), *found
    )


def within(estimate: Column, exact: Column, share: float = 0.05) -> Column:
    """Whether an estimated number is as near to the exact one as is stated."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), share * exact)
