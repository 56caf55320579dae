"""Row filters as named rules, with accounting in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row fails the rule where `drop` is true; null counts as false."""

    name: str
    drop: Column


def first_failure(rules: list[Rule], kept: str = "kept") -> Column:
    """The name of the first rule a row fails."""
    out = None
    for r in rules:
        out = F.when(r.drop, r.name) if out is None else out.when(r.drop, r.name)
    return F.lit(kept) if out is None else out.otherwise(kept)


def apply_rules(df: DataFrame, rules: list[Rule], column: str = "charged_to") -> DataFrame:
    return df.withColumn(column, first_failure(rules))


def rule_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, reached, dropped, rate): rows that reach each rule and rows charged to it; every rule has a row, 0 included."""
    charged = df.select(first_failure(rules).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    order = df.sparkSession.createDataFrame([(r.name, i) for i, r in enumerate(rules)] + [("kept", len(rules))], "rule string, place int")
    both = order.join(charged, "rule", "left").na.fill(0, ["n"])
    later = both.alias("a").join(both.alias("b"), F.col("b.place") >= F.col("a.place")).groupBy("a.rule", "a.place", "a.n").agg(F.sum("b.n").alias("reached"))
    return later.select("rule", "place", "reached", F.col("n").alias("dropped"), F.try_divide("n", "reached").alias("rate"))


def score_at_least(score: Column, least: float, keep_nan: bool) -> Column:
    """A score in text at or over a bound; text that is no number fails, NaN as told."""
    x = score.try_cast("double")
    return F.coalesce(F.when(F.isnan(x), F.lit(keep_nan)).otherwise(x >= least), F.lit(False))


def in_half_open(c: Column, low: float, high: float) -> Column:
    return (c >= low) & (c < high)


def length_window(question: Column, answer: Column, shortest: int = 50, longest: int = 12_000, longest_question: int = 0) -> Column:
    """Both filled, the answer long enough and both together short enough; a bound of 0 or less is no bound."""
    q, a = F.coalesce(F.length(question), F.lit(0)), F.coalesce(F.length(answer), F.lit(0))
    kept = (q > 0) & (a > 0)
    for bound, holds in ((shortest, a >= shortest), (longest, q + a <= longest), (longest_question, q <= longest_question)):
        if bound > 0:
            kept = kept & holds
    return kept
