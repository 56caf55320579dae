"""Duplicates by key: keep the first or the last, check keys, resume, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in the order; a null key is a key, null order values come first.

    An aggregate, not a window: each task sends at most one row a key, so a hot key costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("first__")
    return df.groupBy(*keys).agg(best).select(*(F.col(c) if c in keys else F.col(f"first__.{c}") for c in df.columns))


def keep_last(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """Last write wins: one aggregate with map-side combine, no sort of the log."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), order).alias("last__")
    return df.groupBy(*keys).agg(best).select(*keys, "last__.*")


def remove_known(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Anti join on keys; the known side is made distinct first, and the optimiser broadcasts it only if it is small."""
    return df.join(known.select(*keys).distinct(), keys, "left_anti")


def keep_known(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(known.select(*keys).distinct(), keys, "left_semi")


def inner_or_fail(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The inner join in which every wanted key must have a row: the job fails and names a key that has none, without a job before it."""
    marked = wanted.join(df.withColumn("there__", F.lit(True)), key, "left")
    checked = F.when(F.col("there__"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"missing {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(wanted.schema[key].dataType))
    return marked.withColumn(key, checked).drop("there__")


def ordered_subset(df: DataFrame, ids: DataFrame, key: str, tolerant: bool = False) -> DataFrame:
    """Rows of the listed ids with their place in the list; an id without a row fails the job unless the subset is tolerant."""
    return df.join(ids, key) if tolerant else inner_or_fail(ids, df, key)


def missing_keys(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fails with the first few repeated keys."""
    bad = repeated_keys(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"repeated keys: {bad}")
    return df


def require_all(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    bad = missing_keys(wanted, df, key).limit(5).collect()
    if bad:
        raise ValueError(f"missing keys: {bad}")
    return df
