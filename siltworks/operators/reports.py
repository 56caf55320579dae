"""Aggregates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_stats(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """count, mean, median, p25, p75, p90, p95, max with linear interpolation; nulls, not NaN, where there is no value."""
    v = value.cast("double")
    quantiles = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    return df.groupBy(*(by or [])).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), *(F.percentile(v, q).alias(n) for n, q in quantiles.items()), F.max(v).alias("max"))


def facet_counts(df: DataFrame, facets: list[list[str]]) -> DataFrame:
    """Counts of several groupings and the total from one pass; columns that a row does not group by are null."""
    names = list(dict.fromkeys(c for f in facets for c in f))
    sets = [[F.col(c) for c in f] for f in facets] + [[]]
    return df.groupingSets(sets, *names).agg(F.grouping_id().alias("facet"), F.count("*").alias("n"))


def facet_means(df: DataFrame, value: Column, facets: list[list[str]]) -> DataFrame:
    """Rows and the mean of a value for several groupings and in total, from one pass."""
    names = list(dict.fromkeys(c for f in facets for c in f))
    sets = [[F.col(c) for c in f] for f in facets] + [[]]
    return df.groupingSets(sets, *names).agg(F.grouping_id().alias("facet"), F.count("*").alias("n"), F.avg(value).alias("mean"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased estimate 1 - C(n - c, k) / C(n, k); null where n < k."""
    factors = F.transform(F.sequence(n - c + 1, n), lambda i: 1 - F.lit(float(k)) / i)
    miss = F.aggregate(factors, F.lit(1.0), lambda p, x: p * x)
    return F.when(n < k, None).when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - miss)


def binned(value: Column, edges: list[float]) -> Column:
    """The number of the half-open bin between edges; the last bin has its upper edge too."""
    out = None
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        inside = (value >= a) & ((value <= b) if i == len(edges) - 2 else (value < b))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def rate(passed: Column) -> Column:
    return F.avg(F.when(passed, 1.0).otherwise(0.0))
